"""Comparison of subtypes across groups on their most variable regions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from regspan.functions import recode as R
from regspan.operators.presence import SPAN, member_pairs, pattern_counts, win_topn_per_group
from regspan.operators.scale import numbered_names, salted_join
from regspan.session import durable

TOP_PER_GROUP = 500
# ---- fixed values: classes whose diversity the presence form measures ----
DIVERSITY_CLASSES = ["enhancer", "silencer", "promoter", "uncharacterized", "insulator", "other_regulatory"]
# ---- end of fixed values ----


def label(grp: str = "grp", subtype: str = "subtype"):
    return F.concat(F.col(grp), F.lit("__"), F.col(subtype))


def fingerprint(master: DataFrame, n: int = TOP_PER_GROUP) -> DataFrame:
    """The ``n`` regions of each group whose presence differs most between its subtypes."""
    return win_topn_per_group(master, ["grp"], "diff_pct", n, ["region_id"])


def profiles(joint: DataFrame, top: DataFrame) -> DataFrame:
    """Percent of each subtype in the fingerprint regions of its group; an absent row is zero."""
    ids = top.select("grp", *SPAN, "region_class", "region_id")
    return joint.join(ids, ["grp", *SPAN, "region_class"]).where("pct > 0").select(
        "grp", "subtype", label().alias("member"), "region_id", "pct")


def _pairs_of(members: DataFrame, member: str) -> DataFrame:
    """Each unordered pair of a short list of members."""
    one = members.select(member).distinct().groupBy(F.lit(0).alias("k")).agg(
        F.sort_array(F.collect_set(member)).alias("pattern"), F.lit(0).alias("n"))
    return member_pairs(one, ["k"]).select("a", "b")


def centred_ranks(values: DataFrame, member: str, value: str, n_elements: int) -> DataFrame:
    """Average ranks of positive values, shifted so that the rank of a zero is 0.

    Correlation does not see the shift, so zeros need no rows. Ranks come from
    the distinct values of a member and their counts. ``n_elements`` is the
    number of all elements.
    """
    dist = values.groupBy(member, value).agg(F.count("*").alias("m"))
    below = W.partitionBy(member).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(member)
    ranked = dist.select(
        member, value,
        (F.coalesce(F.sum("m").over(below), F.lit(0)) + (F.col("m") + 1) / 2).alias("r"),
        F.sum("m").over(whole).alias("nnz"))
    zeros = F.lit(n_elements) - F.col("nnz")
    centred = ranked.select(member, value, (F.col("r") + (zeros - 1) / 2).alias("s"))
    return salted_join(values, centred, [member, value])


def div_spearman(values: DataFrame, members: DataFrame, n_elements: int, member: str = "member",
                 element: str = "region_id", value: str = "pct", undefined_as_zero: bool = False) -> DataFrame:
    """1 - Spearman between members over all elements, absent values being zero.

    Only positive values are stored and shuffled: sums over zeros vanish
    because the ranks are centred on the rank of a zero. A constant member has
    no correlation: NULL, or zero correlation with ``undefined_as_zero``.
    """
    s = centred_ranks(values, member, value, n_elements)
    own = s.groupBy(member).agg(F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    bag = s.groupBy(element).agg(F.sort_array(F.collect_list(F.struct(F.col(member).alias("m"), "s"))).alias("bag"))
    prod = F.flatten(F.transform("bag", lambda one_entry, one_at: F.transform(
        F.slice("bag", one_at + 2, F.size("bag")), lambda two_entry: F.struct(
            one_entry["m"].alias("a"), two_entry["m"].alias("b"), (one_entry["s"] * two_entry["s"]).alias("x")))))
    cross = bag.select(F.inline(prod)).groupBy("a", "b").agg(F.sum("x").alias("sab"))
    side = lambda x: own.select(F.col(member).alias(x), F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"))
    d = _pairs_of(members, member).join(cross, ["a", "b"], "left").join(side("a"), "a", "left").join(side("b"), "b", "left")
    n = F.lit(float(n_elements))
    va, vb = n * F.col("a2") - F.col("a1") ** 2, n * F.col("b2") - F.col("b1") ** 2
    cov = n * F.coalesce("sab", F.lit(0.0)) - F.col("a1") * F.col("b1")
    rho = F.when((va > 1e-9) & (vb > 1e-9), cov / F.sqrt(va * vb))
    if undefined_as_zero:
        rho = F.coalesce(rho, F.lit(0.0))
    return d.select("a", "b", (F.lit(1.0) - rho).alias("divergence"))


def count_elements(df: DataFrame, element: str = "region_id") -> int:
    return df.agg(F.count_distinct(element)).first()[0]


def div_intra_inter(div: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs marked as within one group or between groups; ``groups`` has member and grp."""
    g = lambda x: groups.select(F.col("member").alias(x), F.col("grp").alias(f"grp_{x}"))
    return div.join(g("a"), "a").join(g("b"), "b").select(
        "a", "grp_a", "b", "grp_b", "divergence",
        F.when(F.col("grp_a") == F.col("grp_b"), "intra").otherwise("inter").alias("pair_type"))


def comp_class_pct(master: DataFrame, sizes: DataFrame) -> DataFrame:
    """Class share of the whole group table, repeated for each of its subtypes."""
    n = master.groupBy("grp", "region_class").agg(F.count("*").alias("n"))
    d = n.select("*", (F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("grp"))).alias("pct"))
    return sizes.select("grp", "subtype").join(d, "grp").select("grp", "subtype", "region_class", "n", "pct")


def comp_active_classes(counts: DataFrame) -> DataFrame:
    """Class share of the regions a subtype actually holds, six classes."""
    n = counts.where("cnt > 0").groupBy("grp", "subtype", R.recode_simplify_type("region_type").alias(
        "region_class")).agg(F.count("*").alias("n")).where(F.col("region_class").isin(DIVERSITY_CLASSES))
    return n.select("*", (F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("grp", "subtype"))).alias("pct"))


def div_shannon(composition: DataFrame, base: float = math.e) -> DataFrame:
    """Entropy of the class shares of a subtype."""
    p = F.col("pct") / 100.0
    return composition.where("n > 0").groupBy("grp", "subtype").agg(
        (-F.sum(p * F.log(p)) / math.log(base)).alias("shannon"), F.sum("n").alias("n_regions"))


def complexity_index(counts: DataFrame, prof: DataFrame, top: DataFrame, sizes: DataFrame) -> DataFrame:
    """Active regions and entropy (base 2) over six classes, and presence in the fingerprint of the group.

    Mean and median cover every fingerprint region, zeros included. The median
    comes from distinct values and their counts.
    """
    ent = div_shannon(comp_active_classes(counts), 2.0)
    size = top.groupBy("grp").agg(F.count("*").alias("n_top"))
    v = prof.groupBy("grp", "subtype", "pct").agg(F.count("*").alias("m"))
    base = sizes.select("grp", "subtype", "n_cells").join(size, "grp")
    held = v.groupBy("grp", "subtype").agg(F.sum("m").alias("held"))
    zeros = base.join(held, ["grp", "subtype"], "left").select(
        "grp", "subtype", F.lit(0.0).alias("pct"), (F.col("n_top") - F.coalesce("held", F.lit(0))).alias("m"))
    pres = v.unionByName(zeros.where("m > 0")).groupBy("grp", "subtype").agg(
        (F.sum(F.col("pct") * F.col("m")) / F.sum("m")).alias("mean_presence_pct"),
        F.percentile("pct", F.lit(0.5), F.col("m")).alias("median_presence_pct"),
        F.sum(F.when(F.col("pct") > 10, F.col("m")).otherwise(0)).alias("regions_gt10pct"))
    return base.join(ent, ["grp", "subtype"], "left").join(pres, ["grp", "subtype"], "left").select(
        "grp", "subtype", "n_cells", F.coalesce("n_regions", F.lit(0)).alias("total_active_regions"),
        F.coalesce("shannon", F.lit(0.0)).alias("shannon"), "mean_presence_pct", "median_presence_pct",
        "regions_gt10pct")


def conserved_classes(prof: DataFrame, top: DataFrame, n_members: int, min_pct: float = 5.0,
                      whole_bounds: bool = False) -> DataFrame:
    """Regions by the number of subtypes that hold them at more than ``min_pct``.

    Bounds are 80 and 20 percent of the subtypes, both inclusive to the middle
    class; with ``whole_bounds`` they are cut to whole numbers and the upper
    one belongs to the universal class.
    """
    breadth = prof.where(F.col("pct") > min_pct).groupBy("region_id").agg(
        F.count_distinct("member").alias("breadth"))
    every = top.select("region_id").distinct().join(breadth, "region_id", "left").select(
        "region_id", F.coalesce("breadth", F.lit(0)).alias("breadth"))
    b = F.col("breadth")
    if whole_bounds:
        hi, lo = int(n_members * 0.8), int(n_members * 0.2)
        universal, specific = b >= hi, (b < lo) & (b < hi)
    else:
        universal, specific = b > 0.8 * n_members, b < 0.2 * n_members
    cat = F.when(universal, "universal").when(specific, "specific").otherwise("shared")
    return every.groupBy(cat.alias("category")).agg(F.count("*").alias("n_regions"))


def novel_fraction(top: DataFrame) -> DataFrame:
    return top.groupBy("grp").agg((F.count_if(F.col("basket") == "novel") / F.count("*")).alias("novel_fraction"))


def fingerprint_composition(top: DataFrame) -> DataFrame:
    return top.groupBy("grp", "region_class").agg(F.count("*").alias("n_regions"))


def win_cumulative_novel(master: DataFrame, n: int = 2000) -> DataFrame:
    """Novel share of the first k regions by difference, k up to ``n``."""
    top = win_topn_per_group(master, ["grp"], "diff_pct", n, ["region_id"])
    w = W.partitionBy("grp").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    novel = F.when(F.col("basket") == "novel", 1.0).otherwise(0.0)
    return top.select("grp", "rank", (F.sum(novel).over(w) * 100.0 / F.col("rank")).alias("cumulative_novel_pct"))


def set_concordance(sig: DataFrame, by: str = "grp", element: list[str] | None = None) -> DataFrame:
    """Shared significant regions for every pair of groups; the diagonal is the size. No row means none shared."""
    pat = pattern_counts(sig.withColumn("_k", F.lit(0)), ["_k"], element or SPAN, by)
    half = member_pairs(pat, ["_k"], with_self=True).select("a", "b", "n_shared")
    other = half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n_shared")
    return half.unionByName(other)


#: Members up to which their products are summed whole (32 MB); more are reduced without them, pass by pass.
GRAM_MEMBERS, MOST_PASSES = 2048, 300


def _member_rows(prof: DataFrame, names: DataFrame) -> DataFrame:
    """One row per region: the places of the members that have it, and their percents."""
    d = salted_join(prof.select("region_id", "member", "pct"), names, ["member"], spread=["region_id"])
    return d.groupBy("region_id").agg(F.collect_list(F.struct("idx", "pct")).alias("e")).select(
        F.col("e.idx").alias("at"), F.col("e.pct").alias("pct"))


def _products(rows: DataFrame, k: int, q: np.ndarray | None = None) -> np.ndarray:
    """X'X of the region x member matrix X, or X'(XQ); each task adds up its regions in blocks and hands on k short rows."""
    wide = k if q is None else q.shape[1]

    def run(batches):
        total = np.zeros((k, wide))
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = np.zeros((part.num_rows, k))
                for i, (at, pct) in enumerate(zip(part.column("at").to_pylist(), part.column("pct").to_pylist())):
                    x[i, at] = pct
                total += x.T @ (x if q is None else x @ q)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    part = rows.mapInArrow(run, "i bigint, row array<double>")
    add = F.aggregate(F.collect_list("row"), F.array_repeat(F.lit(0.0), wide), lambda x, y: F.zip_with(x, y, lambda u, v: u + v))
    found = part.groupBy("i").agg(add.alias("row")).orderBy("i").toArrow()
    out = np.zeros((k, wide))
    for i, row in zip(found["i"].to_pylist(), found["row"].to_pylist()):
        out[i] = row
    return out


def _eigen(rows: DataFrame, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` largest eigenvalues and vectors of the centred products of ``k`` members.

    Up to ``GRAM_MEMBERS`` members these are summed in one pass. Beyond, a subspace of a few vectors more than ``n`` is
    turned by one pass over the regions after another until its values stand still; k times that width is all that ever
    leaves a task.
    """
    if k <= GRAM_MEMBERS:
        gram = _products(rows, k)
        centred = gram - gram.mean(axis=0) - gram.mean(axis=1)[:, None] + gram.mean()
        val, vec = np.linalg.eigh((centred + centred.T) / 2)
        order = np.argsort(val)[::-1][:n]
        return val[order], vec[:, order]
    rows = durable(rows)
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(k, min(k, 2 * n + 8))))[0]
    last = np.zeros(0)
    for _ in range(MOST_PASSES):
        z = _products(rows, k, q - q.mean(axis=0))
        z -= z.mean(axis=0)
        val, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        order = np.argsort(val)[::-1]
        now, vec = val[order][:n], q @ turn[:, order][:, :n]
        if len(last) and np.all(np.abs(now - last) <= 1e-12 * max(now[0], 1e-300)):
            return now, vec
        last, q = now, np.linalg.qr(z)[0]
    raise RuntimeError(f"principal components did not settle in {MOST_PASSES} passes")


def reduce_pca(prof: DataFrame, members: DataFrame, n_components: int = 2) -> DataFrame:
    """Principal coordinates of subtypes, pc1 to pc<n>.

    The region x subtype matrix stays in Spark. Each component is signed so that its largest coordinate is positive.
    """
    names = durable(numbered_names(members, "member"))
    k = names.count()
    n = min(n_components, k)
    val, vec = _eigen(_member_rows(prof, names), k, n)
    co = vec * np.sqrt(np.clip(val, 0, None))
    co = co * np.where(co[np.abs(co).argmax(axis=0), range(co.shape[1])] < 0, -1.0, 1.0) if k else co
    at = prof.sparkSession.createDataFrame([(i, *map(float, row)) for i, row in enumerate(co)], "idx bigint, " + ", ".join(f"pc{j + 1} double" for j in range(n)))
    return names.join(at, "idx").drop("idx")


def pca_distances(coords: DataFrame) -> DataFrame:
    """Squared distance of each pair of members over all coordinates of ``reduce_pca``; with all components, that of their profiles."""
    pcs = [c for c in coords.columns if c.startswith("pc")]
    one = coords.select("member", F.array(*pcs).alias("x"))
    other = one.select(F.col("member").alias("b"), F.col("x").alias("y"))
    gap = F.aggregate(F.zip_with("x", "y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda total, d: total + d)
    return one.join(other, F.col("member") < F.col("b")).select(F.col("member").alias("a"), "b", gap.alias("distance2"))


def pca_variance(coords: DataFrame) -> DataFrame:
    """Variance of each component, long (component, total): the sum of its squared coordinates."""
    pcs = [c for c in coords.columns if c.startswith("pc")]
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.pow(c, F.lit(2)).alias("x")) for c in pcs])
    return coords.select(F.inline(rows)).groupBy("component").agg(F.sum("x").alias("total"))


def group_centres(coords: DataFrame, groups: DataFrame) -> DataFrame:
    return coords.join(groups, "member").groupBy("grp").agg(F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))
