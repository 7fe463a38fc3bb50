"""Transcription-factor ranks inside nuclei and how they spread over nuclei.

``tf_pct`` is long (grp, subtype, nucleus, tf, pct); a missing pair is zero.
All zeros of a nucleus share one average rank, so only positive pairs are
stored: a sum over nuclei is the sum of zero ranks plus, for each positive
pair, its difference to the zero rank of its nucleus.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regspan.functions.coords import tf_short
from regspan.functions.stats import mann_whitney_p
from regspan.operators.pairwise import fdr_bh
from regspan.operators.presence import win_topn_per_group
from regspan.operators.scale import checked_broadcast, each_of, hashed_places, salted_join
from regspan.session import durable

NUCLEUS = ["grp", "subtype", "nucleus"]
SUB = ["grp", "subtype"]
#: Samples of the null distribution of a size, and the least difference that counts when a coefficient is compared with it.
NULL_DRAWS, NULL_TIE = 999, 1e-9
#: Factors that mix (place, sample, size), and those of the two rounds after it.
NULL_MIX = (2654435761, 2246822519, 3266489917, 2246822507, 3266489909)


def tf_names(tf_pct: DataFrame) -> DataFrame:
    """The TF vocabulary, a dimension."""
    return checked_broadcast(tf_pct.select("tf").distinct())


def zero_ranks(tf_pct: DataFrame, names: DataFrame) -> DataFrame:
    """Per nucleus: positive TFs and the average rank all its zero TFs share."""
    n = tf_pct.groupBy(*NUCLEUS).agg(F.count_if(F.col("pct") > 0).alias("nnz"))
    return n.withColumn("n_tf", F.lit(names.count())).withColumn("zero_rank", (F.col("nnz") + F.col("n_tf") + 1) / 2.0)


def positive_ranks(tf_pct: DataFrame) -> DataFrame:
    """Average rank of each positive TF inside its nucleus, largest percent first."""
    pos = tf_pct.where("pct > 0")
    w = W.partitionBy(*NUCLEUS)
    rank = F.rank().over(w.orderBy(F.desc("pct"))) + (F.count("*").over(W.partitionBy(*NUCLEUS, "pct")) - 1) / 2.0
    return pos.select(*NUCLEUS, "tf", "pct", rank.alias("rank"))


def win_rank_within_nucleus(tf_pct: DataFrame) -> DataFrame:
    """Rank of every TF of the vocabulary in every nucleus, zeros included."""
    names = tf_names(tf_pct)
    every = each_of(zero_ranks(tf_pct, names).select(*NUCLEUS, "zero_rank"), names, "tf")
    return every.join(positive_ranks(tf_pct), [*NUCLEUS, "tf"], "left").select(
        *NUCLEUS, "tf", F.coalesce("pct", F.lit(0.0)).alias("pct"), F.coalesce("rank", "zero_rank").alias("rank"))


def _power_sums(tf_pct: DataFrame, names: DataFrame, powers: int) -> DataFrame:
    """Sums over nuclei of (rank - mean rank)^k per (subtype, tf), k up to ``powers``."""
    zero = zero_ranks(tf_pct, names).withColumn("mid", (F.col("n_tf") + 1) / 2.0)
    pos = positive_ranks(tf_pct).join(zero.select(*NUCLEUS, "zero_rank", "mid"), NUCLEUS)
    r, z, mid = F.col("rank"), F.col("zero_rank"), F.col("mid")
    ks = range(1, powers + 1)
    extra = pos.groupBy(*SUB, "tf").agg(
        *[F.sum(F.pow(r - mid, F.lit(k)) - F.pow(z - mid, F.lit(k))).alias(f"x{k}") for k in ks],
        F.count("*").alias("held"))
    base = zero.groupBy(*SUB).agg(*[F.sum(F.pow(z - mid, F.lit(k))).alias(f"b{k}") for k in ks],
                                  F.count("*").alias("n_nuclei"), F.max("mid").alias("mid"),
                                  F.max("n_tf").alias("n_tf"))
    d = each_of(base, names, "tf").join(extra, [*SUB, "tf"], "left")
    return d.select(*SUB, "tf", "n_nuclei", "n_tf", "mid", F.coalesce("held", F.lit(0)).alias("held"),
                    *[(F.col(f"b{k}") + F.coalesce(f"x{k}", F.lit(0.0))).alias(f"s{k}") for k in ks])


def win_divergence(tf_pct: DataFrame) -> DataFrame:
    """Per (subtype, TF): SD and mean of the rank over nuclei, CV, occupancy."""
    s = _power_sums(tf_pct, tf_names(tf_pct), 2)
    n = F.col("n_nuclei")
    var = F.try_divide(F.col("s2") - F.col("s1") ** 2 / n, n - 1)
    d = s.select(*SUB, "tf", "n_nuclei", "n_tf",
                 F.sqrt(F.greatest(var, F.lit(0.0))).alias("divergence_std"),
                 (F.col("mid") + F.col("s1") / n).alias("mean_rank"), (F.col("held") / n).alias("occupancy"))
    return d.withColumn("cv", F.when(F.col("mean_rank") > 0, F.col("divergence_std") / F.col("mean_rank")).otherwise(
        0.0)).withColumn("tf_short", tf_short("tf"))


def _sarle(n: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> Column:
    """Sarle's bimodality coefficient with sample corrections, from power sums about any one point."""
    a = s1 / n
    m2 = s2 / n - a ** 2
    m3 = s3 / n - a * 3 * s2 / n + F.pow(a, F.lit(3)) * 2
    m4 = s4 / n - a * 4 * s3 / n + F.pow(a, F.lit(2)) * 6 * s2 / n - F.pow(a, F.lit(4)) * 3
    skew = m3 / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)
    return F.when(m2 > 1e-9, (skew ** 2 + 1) / (kurt + F.pow(n - 1, F.lit(2)) * 3 / ((n - 2) * (n - 3))))


def null_values(n: int, draw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Seeded even values in [0, 1), one per (sample, place): three whole numbers mixed to 32 bits."""
    low, step = np.uint64(0xFFFFFFFF), np.uint64
    h = (at.astype(np.uint64)[None, :] * step(NULL_MIX[0]) + draw.astype(np.uint64)[:, None] * step(NULL_MIX[1]) + step(n * NULL_MIX[2])) & low
    h ^= h >> step(16)
    h = h * step(NULL_MIX[3]) & low
    h ^= h >> step(13)
    h = h * step(NULL_MIX[4]) & low
    h ^= h >> step(16)
    return h.astype(np.float64) / 2.0 ** 32


def unimodal_null(sizes: DataFrame, draws: int = NULL_DRAWS) -> DataFrame:
    """(n, null): for every size ``n`` of ``sizes``, the bimodality coefficients of ``draws`` seeded even samples of n values.

    An even spread is the unimodal shape closest to two modes, the one that the dip test compares with as well. Samples
    are drawn in tasks, some draws of one size at a time; a size keeps its sorted coefficients only.
    """
    per = 50

    def run(batches):
        for b in batches:
            out_n, out_s = [], [[] for _ in range(4)]
            for n, lo in zip(b.column("n").to_pylist(), b.column("lo").to_pylist()):
                draw = np.arange(lo, min(lo + per, draws))
                sums = np.zeros((4, len(draw)))
                for at in range(0, n, 1 << 14):
                    x = null_values(n, draw, np.arange(at, min(at + (1 << 14), n))) - 0.5
                    sums += [(x ** k).sum(axis=1) for k in range(1, 5)]
                out_n += [n] * len(draw)
                for k in range(4):
                    out_s[k] += sums[k].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_n, pa.int64()), *[pa.array(c, pa.float64()) for c in out_s]], ["n", "s1", "s2", "s3", "s4"])

    blocks = F.explode(F.array(*[F.lit(lo) for lo in range(0, draws, per)])).alias("lo")
    todo = sizes.select(F.col("n").cast("bigint").alias("n")).distinct().select("n", blocks)
    drawn = todo.repartition("n", "lo").mapInArrow(run, "n bigint, s1 double, s2 double, s3 double, s4 double")
    coef = _sarle(F.col("n").cast("double"), *[F.col(f"s{k}") for k in range(1, 5)])
    return drawn.select("n", coef.alias("c")).groupBy("n").agg(F.array_sort(F.collect_list("c")).alias("null"))


def screen_bimodal(tf_pct: DataFrame, min_nuclei: int = 20, draws: int = NULL_DRAWS, alpha: float = 0.05) -> DataFrame:
    """Sarle's bimodality coefficient of the rank per (subtype, TF), its p, the FDR over the TFs of a subtype, and the flag.

    p is the share of seeded unimodal samples of as many nuclei that reach the coefficient. TFs whose rank does not vary
    and subtypes below ``min_nuclei`` have no coefficient and p = 1. A screen of its own; not the dip test.
    """
    s = _power_sums(tf_pct, tf_names(tf_pct), 4)
    coef = _sarle(F.col("n_nuclei").cast("double"), *[F.col(f"s{k}") for k in range(1, 5)])
    found = durable(s.select(*SUB, "tf", "n_nuclei", F.when(F.col("n_nuclei") >= min_nuclei, coef).alias("bimodality")))
    null = unimodal_null(found.where("bimodality IS NOT NULL").select(F.col("n_nuclei").alias("n")), draws)
    # a size is one row of as many doubles as draws, and there are no more sizes than subtypes
    reached = F.size(F.filter("null", lambda c: c >= F.col("bimodality") - NULL_TIE))
    p = F.when(F.col("null").isNull() | F.col("bimodality").isNull(), 1.0).otherwise((reached + 1) / (draws + 1.0))
    tested = found.join(checked_broadcast(null), found.n_nuclei == F.col("n"), "left").select(*SUB, "tf", "n_nuclei", "bimodality", p.alias("p_value"))
    return fdr_bh(tested, "p_value", SUB).withColumn("bimodal", F.col("fdr") < alpha)


def tf_subtype_summary(div: DataFrame, flags: DataFrame, n: int = 50) -> DataFrame:
    """Per subtype: nuclei, mean SD of the top TFs, median SD, flagged TFs."""
    w = W.partitionBy(*SUB).orderBy(F.desc("divergence_std"), "tf")
    d = div.withColumn("_r", F.row_number().over(w)).join(flags.select(*SUB, "tf", "bimodal"), [*SUB, "tf"], "left")
    return d.groupBy(*SUB).agg(
        F.max("n_nuclei").alias("n_nuclei"), F.avg(F.when(F.col("_r") <= n, F.col("divergence_std"))).alias("mean_top_std"),
        F.percentile("divergence_std", F.lit(0.5)).alias("median_std"), F.count_if("bimodal").alias("n_bimodal"))


def tf_node_spread(div: DataFrame, nodes: DataFrame) -> DataFrame:
    """Quartiles of the SD per subtype and parent node; ``nodes`` has subtype and node."""
    q = lambda p: F.percentile("divergence_std", F.lit(p))
    return div.join(checked_broadcast(nodes), "subtype").groupBy("node", *SUB).agg(
        F.count("*").alias("n"), F.min("divergence_std").alias("q0"), q(0.25).alias("q1"), q(0.5).alias("q2"),
        q(0.75).alias("q3"), F.max("divergence_std").alias("q4"))


def tf_between_rank(div: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per TF: mean, SD and range of the within-subtype SD over subtypes, highest and lowest subtype."""
    v = "divergence_std"
    return div.groupBy(*(by or []), "tf").agg(
        F.count("*").alias("n_subtypes"), F.avg(v).alias("mean_std"), F.stddev_samp(v).alias("between_std"),
        (F.max(v) - F.min(v)).alias("between_range"),
        F.min_by("subtype", F.struct((-F.col(v)).alias("x"), F.col("subtype").alias("y"))).alias("max_subtype"),
        F.min_by("subtype", F.struct(F.col(v).alias("x"), F.col("subtype").alias("y"))).alias("min_subtype"),
    ).withColumn("tf_short", tf_short("tf"))


def top_shared(div: DataFrame, n: int = 25, min_subtypes: int = 1) -> DataFrame:
    """TFs by the number of subtypes whose top list holds them."""
    top = win_topn_per_group(div, SUB, "divergence_std", n, ["tf"])
    c = top.groupBy(tf_short("tf").alias("tf_short")).agg(F.count("*").alias("n_subtypes"))
    return c.where(F.col("n_subtypes") >= min_subtypes)


def cmp_top_lists(a: DataFrame, b: DataFrame, item: str, score: str, n: int = 15) -> DataFrame:
    """Items in the first ``n`` of both lists."""
    def first(df: DataFrame, name: str) -> DataFrame:
        return df.orderBy(F.desc(score), item).limit(n).select(item, F.col(score).alias(name))
    return first(a, "score_a").join(first(b, "score_b"), item)


def win_zscore_rows(df: DataFrame, row: str, value: str) -> DataFrame:
    """(x - mean) / SD of ``value`` along each row; a constant row gives zeros."""
    w = W.partitionBy(row)
    sd = F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.when(sd > 1e-12, sd).otherwise(1.0))


# ---------------------------------------------------------------- Mann-Whitney contrasts

def rank_sums(values: DataFrame, key: list[str], inside: str, value: str, n1: int, n2: int) -> DataFrame:
    """U of the in-group and tie term per key; members without a positive value are zeros.

    ``values`` holds at most one row per (key, member), so a key has at most
    ``n1 + n2`` rows.
    """
    pos = values.where(F.col(value) > 0)
    ties = F.count("*").over(W.partitionBy(*key, value))
    r = F.rank().over(W.partitionBy(*key).orderBy(value)) + (ties - 1) / 2.0
    d = pos.select(*key, inside, r.alias("r"), ties.alias("t"))
    s = d.groupBy(*key).agg(
        F.count("*").alias("nnz"), F.count_if(F.col(inside)).alias("nin"),
        F.coalesce(F.sum(F.when(F.col(inside), F.col("r"))), F.lit(0.0)).alias("rin"),
        F.sum(F.col("t") * F.col("t") - 1).alias("tt"))
    z = F.lit(n1 + n2) - F.col("nnz")
    r1 = F.col("rin") + F.col("nin") * z + (F.lit(n1) - F.col("nin")) * (z + 1) / 2.0
    return s.select(*key, (r1 - n1 * (n1 + 1) / 2.0).alias("u1"), (F.col("tt") + z * z * z - z).cast("double").alias("ties"))


def mann_whitney(values: DataFrame, key: list[str], inside: str, value: str, n1: int, n2: int) -> DataFrame:
    """Two-sided p per key; computed once per distinct (U, tie term)."""
    u = rank_sums(values, key, inside, value, n1, n2)
    p = u.select("u1", "ties").distinct().withColumn("mwu_p", mann_whitney_p(F.col("u1"), n1, n2, F.col("ties")))
    return salted_join(u, p, ["u1", "ties"])


def test_mwu_tf(div: DataFrame, in_subtypes: list[str], ref_subtypes: list[str]) -> DataFrame:
    """TF dominance (vocabulary size - mean rank) of in-group against reference subtypes."""
    d = div.where(F.col("subtype").isin(in_subtypes + ref_subtypes)).select(
        "tf", "subtype", F.col("subtype").isin(in_subtypes).alias("inside"),
        F.round(F.col("n_tf") - F.col("mean_rank"), 9).alias("dominance"), "occupancy")
    n1, n2 = len(in_subtypes), len(ref_subtypes)
    side = lambda c, yes: F.avg(F.when(F.col("inside") == yes, F.col(c)))
    m = d.groupBy("tf").agg(
        side("dominance", True).alias("in_dominance"), side("dominance", False).alias("ref_dominance"),
        (side("occupancy", True) * 100).alias("in_occ_pct"), (side("occupancy", False) * 100).alias("ref_occ_pct"))
    p = durable(mann_whitney(d, ["tf"], "inside", "dominance", n1, n2).withColumn("_k", F.lit(0)))
    fdr = fdr_bh(p, "mwu_p", ["_k"], out="mwu_fdr").select("tf", "mwu_p", "mwu_fdr")
    delta = F.col("in_dominance") - F.col("ref_dominance")
    return m.join(fdr, "tf").withColumn("delta", delta).withColumn(
        "side", F.when(F.col("delta") > 0, "higher").when(F.col("delta") < 0, "lower").otherwise("equal"))


# ---------------------------------------------------------------- permutation test

#: Nuclei whose ranks a task holds at once, and permutations that it orders, passes on and adds up at once.
NUCLEI_HELD, PERM_BLOCK, PERMS_HELD, PERMS_ADDED = 4096, 100, 25, 16


def _label_bytes(nuclei: DataFrame, perms: int, seed: int) -> DataFrame:
    """(grp, nucleus, labels, n_grp): subtype numbers of every nucleus as little-endian 16-bit numbers, its own first, then
    the shuffled one of every permutation.

    Subtype sizes are kept. Nuclei of a group are put in the order of a hash of nucleus, permutation and seed; the first
    places take the first label, and so on. A task gets the ids of a group and orders them for a block of permutations, so
    nuclei never become one row per permutation.
    """
    size = nuclei.groupBy("grp", "subtype").agg(F.count("*").alias("n"))
    upto = W.partitionBy("grp").orderBy("subtype").rowsBetween(W.unboundedPreceding, 0)
    bounds = checked_broadcast(size.select("grp", "subtype", F.sum("n").over(upto).alias("hi")).groupBy("grp").agg(
        F.sort_array(F.collect_list("hi")).alias("bounds"), F.max("hi").alias("n_grp"),
        F.sort_array(F.collect_list("subtype")).alias("subtypes")))
    own = nuclei.join(bounds.select("grp", "subtypes"), "grp").select(
        "grp", F.struct("nucleus", (F.array_position("subtypes", F.col("subtype")) - 1).cast("int").alias("label")).alias("x"))
    roster = own.groupBy("grp").agg(F.array_sort(F.collect_list("x")).alias("x")).join(bounds.select("grp", "bounds"), "grp")
    starts = list(range(1, perms + 1, PERM_BLOCK)) or [1]
    todo = roster.select("grp", "bounds", F.col("x.nucleus").alias("ids"), F.col("x.label").alias("own"),
                         F.explode(F.array(*map(F.lit, starts))).alias("lo")).repartition(8 * len(starts), "grp", "lo")
    kind = nuclei.schema["nucleus"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for grp, bounds, ids, own, lo in zip(*[b.column(c).to_pylist() for c in ("grp", "bounds", "ids", "own", "lo")]):
                heads = [f"{x}|".encode() for x in ids]
                rows = [np.array(own, "<u2")] if lo == 1 else []
                for perm in range(lo, min(lo + PERM_BLOCK, perms + 1)):
                    tail = f"{perm}|{seed}".encode()
                    mix = np.frombuffer(b"".join([md5(h + tail).digest() for h in heads]), ">u8")[::2] >> np.uint64(4)
                    place = np.empty(len(ids), np.int64)
                    place[np.argsort(mix, kind="stable")] = np.arange(len(ids))
                    rows.append(np.searchsorted(bounds, place, side="right").astype("<u2"))
                each = np.ascontiguousarray(np.array(rows, "<u2").T)
                for at in range(0, len(ids), NUCLEI_HELD):
                    part = each[at:at + NUCLEI_HELD]
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(grp, len(part)), pa.array(ids[at:at + NUCLEI_HELD], b.schema.field("ids").type.value_type),
                         pa.array(np.full(len(part), lo, np.int32)), pa.array([x.tobytes() for x in part], pa.binary())], ["grp", "nucleus", "lo", "part"])

    parts = todo.mapInArrow(run, f"grp string, nucleus {kind}, lo int, part binary")
    whole = parts.groupBy("grp", "nucleus").agg(*[F.max(F.when(F.col("lo") == lo, F.col("part"))).alias(f"p{lo}") for lo in starts])
    return whole.select("grp", "nucleus", F.concat(*[f"p{lo}" for lo in starts]).alias("labels")).join(bounds.select("grp", "n_grp"), "grp")


def permuted_labels(nuclei: DataFrame, perms: int, seed: int) -> DataFrame:
    """``_label_bytes`` with the labels as an array of numbers."""
    kind = nuclei.schema["nucleus"].dataType.simpleString()

    def run(batches):
        for b in batches:
            labels = [np.frombuffer(x, "<u2").astype(np.int32) for x in b.column("labels").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("nucleus"), pa.array(labels, pa.list_(pa.int32())), b.column("n_grp")],
                                             ["grp", "nucleus", "labels", "n_grp"])

    return _label_bytes(nuclei, perms, seed).select("grp", "nucleus", "labels", "n_grp").mapInArrow(
        run, f"grp string, nucleus {kind}, labels array<int>, n_grp bigint")


def _sums_by_label(n_tf: int):
    """Sums of the ranks and their squares of the nuclei that a task holds: one row per permutation and label, TFs as an array."""

    def of_group(grp: str, rows: list[pa.RecordBatch]):
        cols = {c: pa.chunked_array([r.column(c) for r in rows]).combine_chunks() for c in ("z", "at", "rank", "labels")}
        n = len(cols["z"])
        ranks = np.repeat(cols["z"].to_numpy()[:, None], n_tf, axis=1)
        ranks[np.repeat(np.arange(n), cols["at"].value_lengths().to_numpy()), cols["at"].flatten().to_numpy()] = cols["rank"].flatten().to_numpy()
        both = np.hstack([ranks, ranks * ranks])
        label = np.frombuffer(b"".join(cols["labels"].to_pylist()), "<u2").reshape(n, -1)
        numbers = np.arange(label.max() + 1)
        for lo in range(0, label.shape[1], PERMS_HELD):
            member = (label[:, lo:lo + PERMS_HELD].T[:, None, :] == numbers[None, :, None]).astype(float).reshape(-1, n)
            sums, held = member @ both, member.sum(axis=1).astype(np.int64)
            here = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(grp, len(here)), pa.array((lo + here // len(numbers)).astype(np.int32)),
                pa.array((here % len(numbers)).astype(np.int32)), pa.array(held[here]),
                pa.array(list(sums[here]), pa.list_(pa.float64()))], ["grp", "perm", "label", "n", "sums"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of one group, over the borders of batches
        for b in batches:
            grp = b.column("grp").to_pylist()
            cuts = [i for i in range(1, len(grp)) if grp[i] != grp[i - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(grp)]):
                if held and held[0].column("grp")[0].as_py() != grp[lo]:
                    yield from of_group(held[0].column("grp")[0].as_py(), held)
                    held = []
                while lo < hi:
                    take = min(hi - lo, NUCLEI_HELD - sum(r.num_rows for r in held))
                    held.append(b.slice(lo, take))
                    lo += take
                    if sum(r.num_rows for r in held) == NUCLEI_HELD:
                        yield from of_group(grp[lo - 1], held)
                        held = []
        if held:
            yield from of_group(held[0].column("grp")[0].as_py(), held)

    return run


def _spread_of_sds(n_tf: int):
    """T per permutation and TF, from the sums of a group's nuclei, block of permutations by block."""

    def run(table: pa.Table) -> pa.Table:
        perm, label = table.column("perm").to_numpy(), table.column("label").to_numpy()
        perms, p = np.unique(perm, return_inverse=True)
        k = label.max() + 1
        n = np.zeros((len(perms), k))
        sums = np.zeros((len(perms), k, 2 * n_tf))
        np.add.at(n, (p, label), table.column("n").to_numpy())
        np.add.at(sums, (p, label), table.column("sums").combine_chunks().flatten().to_numpy().reshape(len(p), -1))
        with np.errstate(invalid="ignore", divide="ignore"):
            var = (sums[:, :, n_tf:] - sums[:, :, :n_tf] ** 2 / n[:, :, None]) / np.maximum(n - 1, 1)[:, :, None]
        sd = np.sqrt(np.maximum(var, 0.0))
        t = np.array([sd[i, n[i] > 0].std(axis=0, ddof=1) if (n[i] > 0).sum() > 1 else np.full(n_tf, np.nan) for i in range(len(perms))])
        return pa.table({"grp": pa.repeat(table.column("grp")[0].as_py(), len(perms)), "perm": pa.array(perms.astype(np.int32)),
                         "t": pa.array(list(t), pa.list_(pa.float64()))})

    return run


def test_permutation(tf_pct: DataFrame, perms: int = 2000, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """Is the SD of TF ranks spread between subtypes more than under shuffled subtypes?

    T is the SD over subtypes of the SD over nuclei. A nucleus is one row: its ranks beside its labels in all
    permutations. Tasks multiply blocks of nuclei and pass on sums per (permutation, label, TF), so nuclei never meet
    permutations and TFs as joined rows. Permutation 0 holds the labels as they are.
    """
    names = tf_names(tf_pct)
    words = names.where("tf IS NOT NULL").agg(F.sort_array(F.collect_set("tf"))).first()[0]
    listed = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    zero = zero_ranks(tf_pct, names).withColumn("mid", (F.col("n_tf") + 1) / 2.0)
    many = zero.groupBy("grp").agg(F.count_distinct("subtype").alias("k")).where("k >= 2")
    zero = durable(zero.join(checked_broadcast(many.select("grp")), "grp", "left_semi").select(
        *NUCLEUS, (F.col("zero_rank") - F.col("mid")).alias("z"), "mid"))
    pos = positive_ranks(tf_pct).where("tf IS NOT NULL").withColumn("at", (F.array_position(listed, F.col("tf")) - 1).cast("int"))
    held = pos.groupBy("grp", "nucleus").agg(F.collect_list(F.struct("at", "rank")).alias("held"))
    lists = zero.join(held, ["grp", "nucleus"], "left").select(
        "grp", "nucleus", "z", F.coalesce("held.at", F.array().cast("array<int>")).alias("at"),
        F.coalesce(F.transform("held", lambda x: x["rank"] - F.col("mid")), F.array().cast("array<double>")).alias("rank"))
    labels = _label_bytes(zero, perms, seed)
    shard = F.pmod(F.xxhash64("nucleus"), F.floor(F.col("n_grp") / NUCLEI_HELD) + 1)
    rows = lists.join(labels, ["grp", "nucleus"]).withColumn("shard", shard).repartition("grp", "shard").sortWithinPartitions(
        "grp", "shard").select("grp", "z", "at", "rank", "labels")
    sums = rows.mapInArrow(_sums_by_label(len(words)), "grp string, perm int, label int, n bigint, sums array<double>")
    each = sums.withColumn("_block", F.expr(f"perm div {PERMS_ADDED}")).groupBy("grp", "_block").applyInArrow(
        _spread_of_sds(len(words)), "grp string, perm int, t array<double>")
    spread = durable(each.select("grp", "perm", F.posexplode("t").alias("at", "t")).withColumn("t", F.nanvl("t", F.lit(None).cast("double"))))
    observed = spread.where("perm = 0").select("grp", "at", F.col("t").alias("t_obs"))
    d = spread.where("perm > 0").join(observed, ["grp", "at"]).groupBy("grp", "at", "t_obs").agg(
        F.count_if(F.col("t") >= F.col("t_obs") - 1e-9).alias("n_ge"), F.avg("t").alias("null_mean"),
        F.stddev_pop("t").alias("null_sd"))
    d = durable(d.select("grp", F.element_at(listed, F.col("at") + 1).alias("tf"), "t_obs", "n_ge", "null_mean", "null_sd",
                         ((F.col("n_ge") + 1) / F.lit(float(perms + 1))).alias("perm_p")))
    z = F.when(F.col("null_sd") > 1e-9, (F.col("t_obs") - F.col("null_mean")) / F.col("null_sd")).otherwise(0.0)
    out = fdr_bh(d, "perm_p", ["grp"], out="perm_fdr").withColumn("z_score", z)
    return out.withColumn("significant", F.col("perm_fdr") < alpha)
