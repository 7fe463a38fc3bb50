"""Frequent sets of TFs that are jointly unbound in the nuclei of a subtype."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regspan.functions.coords import tf_short
from regspan.operators.scale import checked_broadcast
from regspan.session import durable

SUB = ["grp", "subtype"]
TOP_TF = 50
#: TFs that one long of a bit pattern holds.
WORD_BITS = 62
#: Patterns of a subtype that one shard holds.
SHARD_PATTERNS = 4096
ZERO_LOW, ZERO_HIGH = 0.05, 0.95
MIN_SUPPORT_N, MIN_SUPPORT_SHARE = 10, 0.02


def _nuclei(tf_pct: DataFrame) -> DataFrame:
    return tf_pct.groupBy(*SUB).agg(F.count_distinct("nucleus").alias("n_cell"))


def fim_informative(tf_pct: DataFrame, top: int = TOP_TF, low: float = ZERO_LOW, high: float = ZERO_HIGH) -> DataFrame:
    """TFs unbound in 5 to 95 percent of nuclei, the ``top`` by variance of that state.

    A TF that no nucleus of the subtype binds is unbound everywhere and drops out.
    ``idx`` is the place in variance order.
    """
    held = tf_pct.where("pct > 0").groupBy(*SUB, "tf").agg(F.count("*").alias("held"))
    n = checked_broadcast(_nuclei(tf_pct))
    n_zero = F.col("n_cell") - F.col("held")
    d = held.join(n, SUB).select(*SUB, "tf", "n_cell", n_zero.alias("n_zero"),
                                 (n_zero / F.col("n_cell")).alias("zero_rate")).where((F.col("zero_rate") >= low) & (F.col("zero_rate") <= high))
    var = F.round(F.col("zero_rate") * (1 - F.col("zero_rate")), 12)
    w = W.partitionBy(*SUB).orderBy(F.desc(var), "tf")
    return d.withColumn("idx", F.row_number().over(w) - 1).where(F.col("idx") < top)


def zero_masks(tf_pct: DataFrame, informative: DataFrame, top: int = TOP_TF) -> DataFrame:
    """Distinct patterns of unbound informative TFs with the number of nuclei that show each.

    A pattern is an array of longs, as many as ``top`` TFs need. Nuclei collapse to patterns before any set is counted.
    """
    words = range(-(-top // WORD_BITS))
    inf = checked_broadcast(informative.select(*SUB, "tf", "idx"))
    bit = lambda w: F.when(F.expr(f"idx div {WORD_BITS}") == w, F.expr(f"shiftleft(1L, CAST(idx % {WORD_BITS} AS INT))"))
    bound = tf_pct.where("pct > 0").join(inf, [*SUB, "tf"]).groupBy(*SUB, "nucleus").agg(*[F.bit_or(bit(w)).alias(f"bits{w}") for w in words])
    width = checked_broadcast(informative.groupBy(*SUB).agg(F.count("*").alias("k")))
    every = tf_pct.select(*SUB, "nucleus").distinct().join(width, SUB)

    def unbound(w: int) -> Column:
        here = f"CAST(least(greatest(k - {w * WORD_BITS}, 0), {WORD_BITS}) AS INT)"
        return F.expr(f"shiftleft(1L, {here}) - 1").bitwiseAND(F.bitwise_not(F.coalesce(f"bits{w}", F.lit(0).cast("bigint"))))

    return every.join(bound, [*SUB, "nucleus"], "left").select(*SUB, F.array(*map(unbound, words)).alias("mask")).groupBy(
        *SUB, "mask").agg(F.count("*").alias("w"))


def _pairs_in(z: np.ndarray, w: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = (z * w[:, None]).T @ z
    i, j = np.triu_indices(len(place), 1)
    return np.stack([place[i], place[j]]), n[i, j]


def _triples_in(z: np.ndarray, w: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sets, counts = [np.zeros((3, 0), dtype=np.int64)], [np.zeros(0)]
    for first in range(len(place) - 2):
        rest = slice(first + 1, None)
        pair, n = _pairs_in(z[:, rest], w * z[:, first], place[rest])
        sets.append(np.vstack([np.full(pair.shape[1], place[first]), pair]))
        counts.append(n)
    return np.concatenate(sets, axis=1), np.concatenate(counts)


def _unpacked(masks: list) -> np.ndarray:
    """Patterns as a 0/1 matrix, one column per place."""
    words = np.array([list(m) for m in masks], dtype=np.int64)
    return ((words[:, :, None] >> np.arange(WORD_BITS)) & 1).reshape(len(words), -1).astype(np.float64)


def _count_sets(masks: DataFrame, size: int) -> DataFrame:
    """Nuclei per set (i, j) or (i, j, k) of jointly unbound TFs, by their places.

    Each task multiplies the bit matrix of its patterns and hands on one count
    per set (at most 19,600 of 50 TFs) and subtype; the counts are then added
    up. A task gets whole shards of a subtype, as many as its patterns ask for,
    so that counts handed on grow with the patterns and not with the cores.
    """
    count, names = {2: (_pairs_in, ["i", "j"]), 3: (_triples_in, ["i", "j", "k"])}[size]

    def in_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (grp, subtype), part in batch.groupby(SUB, sort=False):
                z = _unpacked(part["mask"].tolist())
                used = np.flatnonzero(z.any(axis=0))
                sets, n = count(z[:, used], part["w"].to_numpy(dtype=np.float64), used)
                hit = n > 0
                yield pd.DataFrame({"grp": grp, "subtype": subtype, **dict(zip(names, sets[:, hit].astype(np.int32))), "n": n[hit].astype(np.int64)})

    shards = checked_broadcast(masks.groupBy(*SUB).agg(F.floor(F.count("*") / SHARD_PATTERNS + 1).alias("shards")))
    dealt = masks.join(shards, SUB).withColumn("shard", F.pmod(F.xxhash64("mask"), F.col("shards"))).repartition(
        *SUB, "shard").sortWithinPartitions(*SUB, "shard").select(*masks.columns)
    typed = ", ".join(f"{c} int" for c in names)
    return dealt.mapInPandas(in_batches, f"grp string, subtype string, {typed}, n bigint").groupBy(*SUB, *names).agg(
        F.sum("n").alias("support_count"))


def fim_cozero(tf_pct: DataFrame, top: int = TOP_TF) -> DataFrame:
    """Frequent co-unbound sets of one to three TFs per subtype.

    Support is at least ``max(10, 2 % of nuclei)``, the share rounded half to
    even. Candidates per subtype are bounded by the 50 informative TFs; only
    triples whose pairs are all frequent are named.
    """
    inf = durable(fim_informative(tf_pct, top))
    masks = durable(zero_masks(tf_pct, inf, top))
    low = F.greatest(F.lit(MIN_SUPPORT_N), F.bround(F.col("n_cell") * MIN_SUPPORT_SHARE, 0).cast("bigint"))
    one = inf.withColumn("min_support", low).where("n_zero >= min_support")
    item = lambda x: one.select(*SUB, F.col("idx").alias(x), F.col("tf").alias(f"t{x}"),
                                *(["n_cell", "min_support"] if x == "i" else []))
    cand2 = item("i").join(item("j"), SUB).where("i < j")
    pairs = durable(cand2.join(_count_sets(masks, 2), [*SUB, "i", "j"]).where("support_count >= min_support"))
    right = pairs.select(*SUB, F.col("i").alias("j"), F.col("j").alias("k"), F.col("tj").alias("tk"))
    close = pairs.select(*SUB, "i", F.col("j").alias("k"))
    cand3 = pairs.select(*SUB, "i", "j", "ti", "tj", "n_cell", "min_support").join(
        right, [*SUB, "j"]).join(close, [*SUB, "i", "k"], "left_semi")
    triples = cand3.join(_count_sets(masks, 3), [*SUB, "i", "j", "k"]).where("support_count >= min_support")
    names = lambda *t: F.array_join(F.array(*[tf_short(x) for x in t]), " + ")
    out = lambda df, size, *t: df.select(*SUB, F.lit(size).alias("size"), names(*t).alias("tfs"), "support_count",
                                         (F.col("support_count") * 100.0 / F.col("n_cell")).alias("support_pct"))
    singles = one.withColumn("support_count", F.col("n_zero"))
    return out(singles, 1, "tf").unionByName(out(pairs, 2, "ti", "tj")).unionByName(out(triples, 3, "ti", "tj", "tk"))


def fim_pair_prevalence(items: DataFrame) -> DataFrame:
    """Subtypes that share a frequent pair, with mean and largest support."""
    pair = F.array_join(F.sort_array(F.split("tfs", r" \+ ")), " + ")
    return items.where("size = 2").groupBy(pair.alias("tf_pair")).agg(
        F.count("*").alias("n_subtypes"), F.avg("support_pct").alias("mean_support_pct"),
        F.max("support_pct").alias("max_support_pct"))


def fim_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(*SUB).agg(F.count("*").alias("n_itemsets"), F.count_if(F.col("size") == 2).alias("n_pairs"),
                                   F.count_if(F.col("size") == 3).alias("n_triples"))


def fim_pair_matrix(tf_pct: DataFrame, top: int = TOP_TF) -> DataFrame:
    """Percent of nuclei in which two informative TFs are both unbound; the diagonal is the zero rate."""
    inf = durable(fim_informative(tf_pct, top))
    masks = zero_masks(tf_pct, inf, top)
    item = lambda x: inf.select(*SUB, F.col("idx").alias(x), F.col("tf").alias(f"tf_{x}"), "n_cell", "n_zero")
    cand = item("i").join(item("j").drop("n_cell", "n_zero"), SUB).where("i <= j")
    both = F.when(F.col("i") == F.col("j"), F.col("n_zero")).otherwise(F.coalesce("support_count", F.lit(0)))
    return cand.join(_count_sets(masks, 2), [*SUB, "i", "j"], "left").select(
        *SUB, tf_short("tf_i").alias("tf_i"), tf_short("tf_j").alias("tf_j"),
        (both * 100.0 / F.col("n_cell")).alias("cozero_pct"))
