"""The labelled peak corpus and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from regspan.functions import recode as R
from regspan.functions.coords import clean_number
from regspan.operators.scale import numbered_names

PEAK = ["chrom", "peak_start", "peak_end"]


def filter_std_chroms(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    return df.where(F.col(chrom).isin(R.STANDARD_CHROMS))


def agg_peak_corpus(rows: DataFrame) -> DataFrame:
    """One row per peak: labels, the label of highest priority, TF count, score maxima and means.

    One grouping, so that rows are shuffled once at most: a task hands on one row per peak it holds, with the peak's TFs
    and labels as sets, however many cells the peak is seen in.
    """
    return rows.groupBy(*PEAK).agg(
        F.sort_array(F.collect_set("label")).alias("all_labels"),
        R.priority_label(F.min(R.priority_rank("label"))).alias("primary_label"),
        F.size(F.collect_set("tf_motif")).cast("bigint").alias("n_tfs"),
        F.max("motif_score").alias("max_motif_score"), F.max("fp_score").alias("max_fp_score"),
        F.try_divide(F.sum("motif_score"), F.count("motif_score")).alias("mean_motif_score"),
        F.try_divide(F.sum("fp_score"), F.count("fp_score")).alias("mean_fp_score"))


def agg_class_distribution(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("primary_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "primary_label")


def multilabel_flags(corpus: DataFrame) -> DataFrame:
    has = lambda x: F.array_contains("all_labels", x).cast("int")
    return corpus.select(*PEAK, has("enhancer").alias("is_enhancer"), has("promoter").alias("is_promoter"),
                         has("genic").alias("is_genic"), has("silencer").alias("is_silencer"))


def multilabel_stats(flags: DataFrame) -> DataFrame:
    """Positives per label, both and neither of the two regulatory labels."""
    both = (F.col("is_enhancer") == 1) & (F.col("is_silencer") == 1)
    none = (F.col("is_enhancer") == 0) & (F.col("is_silencer") == 0)
    return flags.agg(
        F.count("*").alias("n_total"), F.sum("is_enhancer").alias("n_enhancer"),
        F.sum("is_silencer").alias("n_silencer"), F.count_if(both).alias("n_both"),
        F.count_if(none).alias("n_neither"), F.sum("is_promoter").alias("n_promoter"),
        F.sum("is_genic").alias("n_genic"))


def vocabulary(rows: DataFrame, col: str, name: str = "name") -> DataFrame:
    """Sorted distinct names with a zero-based index."""
    return numbered_names(rows.select(F.col(col).alias(name)), name).select(name, F.col("idx").cast("int").alias("idx"))


def join_tf_lookup(peaks: DataFrame, rows: DataFrame) -> DataFrame:
    """TF set of each peak. The chromosome is part of the key."""
    tf = rows.groupBy(*PEAK).agg(F.sort_array(F.collect_set("tf_motif")).alias("tfs"))
    return peaks.join(tf, PEAK, "left")


def agg_peak_predict(footprints: DataFrame) -> DataFrame:
    """Per cell and peak: TF set, score maxima and means, TF count; missing scores count as zero."""
    f = footprints.select("cell_id", *PEAK, "tf_motif", clean_number("motif_score").alias("ms"),
                          clean_number("fp_score").alias("fs"))
    return f.groupBy("cell_id", *PEAK).agg(
        F.sort_array(F.collect_set("tf_motif")).alias("tfs"),
        F.max("ms").alias("max_motif_score"), F.max("fs").alias("max_fp_score"),
        F.avg("ms").alias("mean_motif_score"), F.avg("fs").alias("mean_fp_score"),
        F.count_distinct("tf_motif").alias("n_tfs"))


def high_confidence(scores: DataFrame, classes: list[str], threshold: float = 0.8) -> DataFrame:
    """Best class of a probability array ``probs``, its confidence and a YES/NO flag; first class wins ties."""
    top = F.array_max("probs")
    cls = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("probs", top).cast("int"))
    return scores.select("*", cls.alias("predicted_class"), top.alias("confidence"),
                         F.when(top >= threshold, "YES").otherwise("NO").alias("high_confidence"))


def high_confidence_totals(called: DataFrame) -> DataFrame:
    return called.groupBy("predicted_class").agg(
        F.count("*").alias("n"), F.count_if(F.col("high_confidence") == "YES").alias("n_high"))


def agg_class_weights(counts: DataFrame) -> DataFrame:
    """Weights from ``counts`` (label, n): inverse counts scaled to the class number, and balanced weights."""
    w = W.partitionBy(F.lit(0))
    inv = F.lit(1.0) / F.greatest(F.col("n"), F.lit(1))
    total = F.sum("n").over(w)
    k = F.count("*").over(w)
    return counts.select("label", "n", (inv / F.sum(inv).over(w) * k).alias("inverse_weight"),
                         (total / (k * F.greatest(F.col("n"), F.lit(1)))).alias("balanced_weight"))


def head_weights(flags: DataFrame, heads: list[str], cap: float | None = None) -> DataFrame:
    """Per head: positives, negatives over positives (capped on request) and balanced 0/1 weights."""
    rows = F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).cast("int").alias("y")) for h in heads])
    c = flags.select(F.inline(rows)).groupBy("head").agg(
        F.sum("y").cast("bigint").alias("n_pos"), (F.count("*") - F.sum("y")).cast("bigint").alias("n_neg"))
    one = lambda x: F.greatest(F.col(x), F.lit(1))
    raw = F.col("n_neg") / one("n_pos")
    total = F.col("n_pos") + F.col("n_neg")
    return c.select("*", (F.least(raw, F.lit(float(cap))) if cap else raw).alias("pos_weight"),
                    (total / (one("n_neg") * 2)).alias("weight_0"), (total / (one("n_pos") * 2)).alias("weight_1"))
