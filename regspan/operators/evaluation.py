"""Evaluation of classifier scores: curves, thresholds, calibration, histograms.

``scored`` is long: the ``by`` columns (model, head), ``y`` (0/1) and ``p``.
Curves are built from one row per distinct score with running totals carried
across score buckets, so no task holds all scores of a head.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regspan.functions import recode as R
from regspan.operators.scale import checked_broadcast, each_of, hashed_places, running_totals, unit_bucket

HEAD = ["head"]
THRESHOLDS = [float(t) for t in np.linspace(0.05, 0.95, 19)]
SHARED_HEADS = ["is_enhancer", "is_silencer"]
EDGES = [float(e) for e in np.linspace(0.0, 1.0, 11)]


def score_table(scored: DataFrame, by: Sequence[str] = HEAD) -> DataFrame:
    """Per distinct score: positives, negatives, and those at or above it (tp, fp) and below it."""
    d = scored.groupBy(*by, "p").agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg"))
    t = running_totals(d, by, "p", unit_bucket("p"), ["pos", "neg"])
    return t.select(*by, "p", "pos", "neg", F.col("all_pos").alias("n_pos"), F.col("all_neg").alias("n_neg"),
                    (F.col("cum_neg") - F.col("neg")).alias("neg_below"),
                    (F.col("all_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
                    (F.col("all_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"))


def _none_is_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def eval_auroc(table: DataFrame, by: Sequence[str] = HEAD) -> DataFrame:
    """Rank-sum form; 0 when a class is missing."""
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
    pairs = (F.max("n_pos") * F.max("n_neg")).cast("double")
    return table.groupBy(*by).agg(_none_is_zero(F.try_divide(won, pairs)).alias("auroc"),
                                  F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))


def eval_auprc(table: DataFrame, by: Sequence[str] = HEAD) -> DataFrame:
    """Average precision: recall steps times precision."""
    step = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return table.groupBy(*by).agg(_none_is_zero(F.try_divide(step, F.max("n_pos").cast("double"))).alias("auprc"))


def _prf(tp: Column, pred: Column, real: Column) -> dict[str, Column]:
    p = _none_is_zero(F.try_divide(tp, pred))
    r = _none_is_zero(F.try_divide(tp, real))
    return {"precision": p, "recall": r, "f1": _none_is_zero(F.try_divide(tp * 2, pred + real))}


def eval_f1_at(scored: DataFrame, by: Sequence[str] = HEAD, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 at a threshold; a zero divisor gives 0."""
    hit = F.col("p") >= threshold
    d = scored.groupBy(*by).agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit).alias("pred"),
                                F.sum("y").cast("bigint").alias("real"))
    return d.select(*by, *[v.alias(k) for k, v in _prf(F.col("tp"), F.col("pred"), F.col("real")).items()])


def f1_sweep(scored: DataFrame, by: Sequence[str] = HEAD, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """F1 at every threshold. Rows first collapse to how many thresholds they pass."""
    ts = F.array(*[F.lit(t) for t in thresholds])
    passed = F.size(F.filter(ts, lambda cut_value: cut_value <= F.col("p")))
    d = scored.groupBy(*by, passed.alias("k")).agg(F.sum("y").cast("bigint").alias("pos"), F.count("*").alias("n"))
    spread = d.select(*by, "k", "pos", "n", F.posexplode(ts).alias("i", "threshold"))
    in_k = F.col("i") < F.col("k")
    s = spread.groupBy(*by, "i", "threshold").agg(
        F.sum(F.when(in_k, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(in_k, F.col("n")).otherwise(0)).alias("pred"),
        F.sum("pos").alias("real"), F.sum("n").alias("total"))
    return s.where((F.col("real") > 0) & (F.col("real") < F.col("total"))).select(
        *by, "i", "threshold", _prf(F.col("tp"), F.col("pred"), F.col("real"))["f1"].alias("f1"))


def eval_f1_best(scored: DataFrame, by: Sequence[str] = HEAD) -> DataFrame:
    """Best of the 19 thresholds per label (the lowest wins ties) beside F1 at 0.5; labels with one class drop out."""
    best = f1_sweep(scored, by).groupBy(*by).agg(
        F.min_by(F.struct("threshold", "f1"), F.struct((-F.col("f1")).alias("x"), "i")).alias("b"))
    at = eval_f1_at(scored, by).select(*by, F.col("f1").alias("f1_at_half"))
    return best.join(at, list(by)).select(*by, "f1_at_half", F.col("b.threshold").alias("best_threshold"),
                                          F.col("b.f1").alias("f1_at_best"))


def f1_macros(best: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over all labels, without the gene-body label, and over the two regulatory labels (both needed)."""
    b, h = F.col("f1_at_best"), F.col("head")
    shared = h.isin(SHARED_HEADS)
    return best.groupBy(*by).agg(
        F.count("*").alias("n_labels"), F.avg("f1_at_half").alias("macro_f1_at_half"), F.avg(b).alias("macro_f1_at_best"),
        F.avg(F.when(h != "is_genic", b)).alias("macro_f1_no_genic"),
        F.when(F.count_if(shared) == 2, F.avg(F.when(shared, b))).alias("macro_f1_shared"))


def eval_threshold_max_f1(table: DataFrame, by: Sequence[str] = HEAD) -> DataFrame:
    """Observed score with the best F1, the lowest of equals; 0.5 when there are no positives."""
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = _none_is_zero(F.try_divide(F.col("tp"), F.col("n_pos")))
    f1 = prec * rec * 2 / F.greatest(prec + rec, F.lit(1e-12))
    d = table.select(*by, "p", "n_pos", F.round(f1, 12).alias("f1"))
    return d.groupBy(*by).agg(
        F.when(F.max("n_pos") == 0, 0.5).otherwise(F.min_by("p", F.struct((-F.col("f1")).alias("x"), "p"))).alias("threshold"),
        F.when(F.max("n_pos") == 0, 0.0).otherwise(F.max("f1")).alias("f1"))


def eval_confusion(called: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (truth, prediction); absent pairs are zero."""
    return called.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))


def class_report(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table."""
    both = confusion.select(*by, F.inline(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("real"), F.lit(0).cast("bigint").alias("pred")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("real"), F.col("n").alias("pred")))))
    tot = both.groupBy(*by, "cls").agg(F.sum("real").alias("support"), F.sum("pred").alias("n_pred"))
    hit = confusion.where("y = pred").select(*by, F.col("y").alias("cls"), F.col("n").alias("tp"))
    d = tot.join(hit, [*by, "cls"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return d.select(*by, "cls", "support", *[v.alias(k) for k, v in _prf(F.col("tp"), F.col("n_pred"), F.col("support")).items()])


def report_averages(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    w = F.col("support")
    return report.groupBy(*by).agg(F.avg("f1").alias("macro_f1"),
                                   (F.sum(F.col("f1") * w) / F.sum(w)).alias("weighted_f1"))


def eval_prob_or(scored: DataFrame, heads: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Probability that any of the heads holds, and whether any does in truth; one row per row_id."""
    d = scored.where(F.col("head").isin(list(heads))).groupBy(*by, "row_id").agg(
        F.sort_array(F.collect_list(F.struct("head", "p"))).alias("ps"), F.max("y").alias("y"))
    miss = F.aggregate("ps", F.lit(1.0), lambda miss_so_far, head_score: miss_so_far * (1.0 - head_score["p"]))
    return d.select(*by, "row_id", "y", (1.0 - miss).alias("p"))


# ---------------------------------------------------------------- calibration

def calib_prior(scores: DataFrame, n_classes: int) -> DataFrame:
    """Class probabilities moved from balanced training priors to the observed ones and renormalised."""
    n = scores.agg(*[F.count_if(F.col("y") == c) for c in range(n_classes)]).first()
    factors = F.array(*[F.lit(x / sum(n) * n_classes) for x in n])
    d = scores.withColumn("_m", F.zip_with("probs", factors, lambda one_prob, one_factor: one_prob * one_factor))
    total = F.aggregate("_m", F.lit(0.0), lambda sum_so_far, one_prob: sum_so_far + one_prob)
    d = d.withColumn("_t", F.when(total <= 0, 1.0).otherwise(total))
    return d.withColumn("corrected", F.transform("_m", lambda one_prob: one_prob / F.col("_t"))).drop("_m", "_t")


def calib_margin_argmax(scores: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Class with the largest margin over its threshold; the first wins ties."""
    cut = F.array(*[F.lit(float(t)) for t in thresholds])
    d = scores.withColumn("_m", F.zip_with("probs", cut, lambda one_prob, one_cut: one_prob - one_cut))
    return d.withColumn("pred", (F.array_position("_m", F.array_max("_m")) - 1).cast("int")).drop("_m")


def calib_reliability(scored: DataFrame, by: Sequence[str] = HEAD) -> DataFrame:
    """Mean score and observed share in ten equal bins; a score of exactly 1 belongs to none."""
    edges = F.array(*[F.lit(e) for e in EDGES])
    b = F.size(F.filter(edges, lambda edge_value: edge_value <= F.col("p"))) - 1
    d = scored.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < 10))
    return d.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


# ---------------------------------------------------------------- histograms

def histogram(df: DataFrame, value: str, by: Sequence[str], bins: int) -> DataFrame:
    """Counts in equal bins between the smallest and largest value of each group."""
    by = list(by)
    ends = [F.min(value).alias("lo"), F.max(value).alias("hi")]
    if by:
        d = df.join(checked_broadcast(df.groupBy(*by).agg(*ends)), by)
    else:
        lo, hi = df.agg(*ends).first()
        d = df.withColumns({"lo": F.lit(lo), "hi": F.lit(hi)})
    at = F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    b = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    return d.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def eval_confidence(called: DataFrame) -> DataFrame:
    """Confidence histograms: 50 bins over all calls, 30 bins per class."""
    whole = histogram(called, "confidence", [], 50).select(F.lit("all").alias("predicted_class"), "bin", "n")
    return whole.unionByName(histogram(called, "confidence", ["predicted_class"], 30))


def eval_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """Score histogram per head and truth."""
    return histogram(scored, "p", ["head", "y"], bins)


def eval_joint_histogram(wide: DataFrame, a: str, b: str, bins: int = 50) -> DataFrame:
    """Counts on square cells of two scores in [0, 1]."""
    cell = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    return wide.groupBy(cell(a).alias("bin_a"), cell(b).alias("bin_b")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- models, folds, splits

def head_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUROC, average precision and F1 at 0.5 per ``by``."""
    t = score_table(scored, by)
    return eval_auroc(t, by).join(eval_auprc(t, by), list(by)).join(
        eval_f1_at(scored, by).select(*by, "f1"), list(by))


def macro_metrics(per_head: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    shared = F.col("head").isin(SHARED_HEADS)
    both = lambda c: F.when(F.count_if(shared) == 2, F.avg(F.when(shared, F.col(c))))
    return per_head.groupBy(*by).agg(
        F.avg("auroc").alias("macro_auroc"), F.avg("auprc").alias("macro_auprc"), F.avg("f1").alias("macro_f1"),
        both("auroc").alias("macro_auroc_shared"), both("auprc").alias("macro_auprc_shared"))


def eval_compare_models(scored: DataFrame, reg_heads: Sequence[str] = SHARED_HEADS) -> DataFrame:
    """One row per model: macro and shared-label metrics, and metrics of "any regulatory head", best first."""
    macro = macro_metrics(head_metrics(scored, ["model", "head"]))
    reg = head_metrics(eval_prob_or(scored, reg_heads, ["model"]), ["model"]).select(
        "model", F.col("auroc").alias("reg_auroc"), F.col("auprc").alias("reg_auprc"), F.col("f1").alias("reg_f1"))
    key = F.coalesce("reg_auroc", "macro_auroc", F.lit(0.0))
    return macro.join(reg, "model", "left").orderBy(key.desc(), "model")


def agg_fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample SD of each metric over folds; NaN is skipped, one fold has SD 0."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return folds.groupBy("metric").agg(F.count(v).alias("n_folds"), F.avg(v).alias("mean"),
                                       F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"))


def split_chrom(chrom: str = "chrom") -> Column:
    c = F.col(chrom)
    return (F.when(c.isin(R.TRAIN_CHROMS), "train").when(c.isin(R.VALID_CHROMS), "val")
            .when(c.isin(R.TEST_CHROMS), "test"))


def loco_folds(n_folds: int = 10) -> dict[str, int]:
    """Chromosomes dealt in order of size to the folds in turn."""
    return {c: i % n_folds for i, c in enumerate(R.CHROMS_BY_SIZE)}


def split_loco(df: DataFrame, fold: int, n_folds: int = 10) -> DataFrame:
    """One fold tests, the next validates, the others train; other chromosomes have no part."""
    of = R.lookup("chrom", loco_folds(n_folds))
    part = (F.when(F.col("fold") == fold, "test").when(F.col("fold") == (fold + 1) % n_folds, "val")
            .when(F.col("fold").isNotNull(), "train"))
    return df.withColumn("fold", of).withColumn("split", part)


def sample_balanced(rows: DataFrame, label: str, key: Sequence[str], draws: int, seed: int = 0) -> DataFrame:
    """``draws`` rows with replacement: a class drawn evenly, then a row drawn evenly inside it.

    Every draw is a hash of its number and the seed. Rows get a position in
    their class from buckets of a key digest, so a large class is not numbered
    by one task.
    """
    spark = rows.sparkSession
    mix = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    pool = hashed_places(rows.withColumn("_h", mix), [label], "_h", *key).withColumnRenamed("place", "_pos").drop("_h")
    classes = rows.groupBy(label).agg(F.count("*").alias("n_class"))
    classes = checked_broadcast(classes.select(
        label, "n_class", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(label)) - 1).alias("_c"),
        F.count("*").over(W.partitionBy(F.lit(0))).alias("_k")))
    k = classes.count()
    number = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(
        "|", F.col("draw").cast("string"), F.lit(salt), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    picks = spark.range(draws).withColumnRenamed("id", "draw").withColumn("_c", (number("class") % k).cast("int"))
    picks = picks.join(classes, "_c").withColumn("_pos", number("row") % F.col("n_class")).select("draw", label, "_pos")
    return picks.join(pool, [label, "_pos"]).drop("_pos")


def softmax_weights(f1: DataFrame, temperature: float = 10.0) -> DataFrame:
    """Model weights: softmax of ten times the macro F1."""
    e = F.exp(F.col("macro_f1") * temperature)
    return f1.select("model", (e / F.sum(e).over(W.partitionBy(F.lit(0)))).alias("weight"))


def score_ensemble(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the models' scores per row and head, weights renormalised."""
    d = scored.join(checked_broadcast(weights), "model")
    return d.groupBy("row_id", "head").agg(
        F.max("y").alias("y"), (F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p"))


def agg_tf_enrichment(corpus_tfs: DataFrame, min_freq: float = 0.001, eps: float = 1e-6) -> DataFrame:
    """log2 of TF frequency in a category over the overall frequency.

    ``corpus_tfs`` has category and tfs (array) per peak. TFs seen in no more
    than ``min_freq`` of all peaks are dropped; ``score`` is the largest
    absolute value over categories, those without the TF included.
    """
    cat = checked_broadcast(corpus_tfs.groupBy("category").agg(F.count("*").alias("n_cat")))
    n = corpus_tfs.select("category", F.explode(F.array_distinct("tfs")).alias("tf")).groupBy("tf", "category").agg(
        F.count("*").alias("n"))
    n_all = cat.agg(F.sum("n_cat")).first()[0]
    tf = n.groupBy("tf").agg(F.sum("n").alias("n_tf"))
    d = each_of(tf, cat, "category").join(cat, "category").join(n, ["tf", "category"], "left")
    overall = F.col("n_tf") / n_all
    freq = F.coalesce("n", F.lit(0)) / F.col("n_cat")
    d = d.where(overall > min_freq).select("tf", "category", F.log2((freq + eps) / (overall + eps)).alias("log2fc"))
    return d.withColumn("score", F.max(F.abs("log2fc")).over(W.partitionBy("tf")))
