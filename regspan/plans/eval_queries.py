"""Queries: scores, calibration, splits, sequences, baselines and the cell stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspan.functions import sequence as Q, recode as R
from regspan.functions.coords import clean_number, coord, parse_coord
from regspan.operators import corpus as K, evaluation as E, sequence as G, training as L
from regspan.operators.scale import tasks_for
from regspan.plans.corpus_queries import CALL_SQL, CLASSES, CLASS_SQL, FLAGS_SQL, class_scores
from regspan.plans.presence_queries import rounded
from regspan.plans.registry import query
from regspan.plans.views import add_views
from regspan.session import durable, scratch_path
from regspan.streaming.incremental import incr_new_cells, read_counts

add_views({
    "models": """
SELECT 'm1' AS model, * FROM scored_long UNION ALL SELECT 'm2', row_id, head, y, 1 - p FROM scored_long
UNION ALL SELECT 'm3', row_id, head, y, floor(p * 10) / 10 FROM scored_long""",
    "curve": """
SELECT model, head, p, SUM(y) AS pos, SUM(1 - y) AS neg, SUM(SUM(y)) OVER (PARTITION BY model, head) AS n_pos,
       SUM(SUM(1 - y)) OVER (PARTITION BY model, head) AS n_neg,
       SUM(SUM(y)) OVER (PARTITION BY model, head ORDER BY p DESC) AS tp,
       SUM(SUM(1 - y)) OVER (PARTITION BY model, head ORDER BY p DESC) AS fp,
       SUM(SUM(1 - y)) OVER (PARTITION BY model, head ORDER BY p) - SUM(1 - y) AS neg_below
FROM models GROUP BY 1, 2, 3""",
    "any_head": """
SELECT model, row_id, MAX(y) AS y, 1 - (1 - MAX(p) FILTER (head = 'is_enhancer')) * (1 - MAX(p) FILTER (
  head = 'is_silencer')) AS p FROM models GROUP BY 1, 2""",
    "heads": """
SELECT c.model, c.head, SUM(pos * (neg_below + neg * 0.5::DOUBLE)) / (MAX(n_pos) * MAX(n_neg))::DOUBLE AS auroc,
       SUM(pos * (tp / (tp + fp)::DOUBLE)) / MAX(n_pos)::DOUBLE AS auprc, MAX(f1) AS f1
FROM curve c JOIN (SELECT model, head, 2 * COUNT(*) FILTER (p >= 0.5 AND y = 1) / (COUNT(*) FILTER (p >= 0.5)
                   + SUM(y))::DOUBLE AS f1 FROM models GROUP BY 1, 2) f ON f.model = c.model AND f.head = c.head
GROUP BY 1, 2""",
    "sweep": f"""
SELECT head, i, t, 2 * COUNT(*) FILTER (p >= t AND y = 1) / (COUNT(*) FILTER (p >= t) + SUM(y))::DOUBLE AS f1
FROM scored_long, (SELECT unnest(range(0, 19)) AS i, unnest([{', '.join(f'{t!r}::DOUBLE' for t in E.THRESHOLDS)}]) AS t)
GROUP BY 1, 2, 3""",
    "calls": f"SELECT * FROM ({CALL_SQL})",
})


def _models(fx):
    s = fx.scored_long
    mk = lambda name, p: s.select(F.lit(name).alias("model"), "row_id", "head", "y", p.alias("p"))
    return mk("m1", F.col("p")).unionByName(mk("m2", 1 - F.col("p"))).unionByName(mk("m3", F.floor(F.col("p") * 10) / 10.0))


MH = ["model", "head"]


@query("eval_auroc", """
SELECT model, head, round(auroc, 8) AS auroc, n_pos, n_neg FROM heads JOIN (
  SELECT model, head, CAST(MAX(n_pos) AS BIGINT) AS n_pos, CAST(MAX(n_neg) AS BIGINT) AS n_neg FROM curve GROUP BY 1, 2)
USING (model, head)""")
def _(fx):
    return rounded(E.eval_auroc(E.score_table(_models(fx), MH), MH), ["auroc"], 8)


@query("eval_auprc", "SELECT model, head, round(auprc, 8) AS auprc FROM heads")
def _(fx):
    return rounded(E.eval_auprc(E.score_table(_models(fx), MH), MH), ["auprc"], 8)


@query("eval_f1_at", """
SELECT model, head, round(COALESCE(tp / NULLIF(pred, 0)::DOUBLE, 0), 9) AS precision,
       round(tp / real::DOUBLE, 9) AS recall, round(2 * tp / (pred + real)::DOUBLE, 9) AS f1
FROM (SELECT model, head, COUNT(*) FILTER (p >= 0.5 AND y = 1) AS tp, COUNT(*) FILTER (p >= 0.5) AS pred, SUM(y) AS real
      FROM models GROUP BY 1, 2)""")
def _(fx):
    return rounded(E.eval_f1_at(_models(fx), MH), ["precision", "recall", "f1"])


BEST_SQL = """
SELECT s.head, MAX(h.f1) AS f1_at_half, first(t ORDER BY s.f1 DESC, i) AS best_threshold, MAX(s.f1) AS f1_at_best
FROM sweep s JOIN (SELECT head, f1 FROM heads WHERE model = 'm1') h ON h.head = s.head GROUP BY 1"""


@query("eval_f1_best", f"""
SELECT head, round(f1_at_half, 9) AS f1_at_half, best_threshold, round(f1_at_best, 9) AS f1_at_best FROM ({BEST_SQL})""")
def _(fx):
    return rounded(E.eval_f1_best(fx.scored_long), ["f1_at_half", "f1_at_best"])


@query("f1_macros", f"""
SELECT COUNT(*) AS n_labels, round(AVG(f1_at_half), 9) AS macro_f1_at_half, round(AVG(f1_at_best), 9) AS macro_f1_at_best,
       round(AVG(f1_at_best) FILTER (head <> 'is_genic'), 9) AS macro_f1_no_genic,
       round(AVG(f1_at_best), 9) AS macro_f1_shared FROM ({BEST_SQL})""")
def _(fx):
    return rounded(E.f1_macros(E.eval_f1_best(fx.scored_long)),
                   ["macro_f1_at_half", "macro_f1_at_best", "macro_f1_no_genic", "macro_f1_shared"])


@query("eval_threshold_max_f1", """
SELECT model, head, first(p ORDER BY round(f1, 12) DESC, p) AS threshold, round(MAX(f1), 9) AS f1 FROM (
  SELECT model, head, p, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)::DOUBLE) * (tp / n_pos::DOUBLE)
    / greatest(tp / (tp + fp)::DOUBLE + tp / n_pos::DOUBLE, 1e-12) END AS f1 FROM curve) GROUP BY 1, 2""")
def _(fx):
    return rounded(E.eval_threshold_max_f1(E.score_table(_models(fx), MH), MH), ["f1"])


@query("eval_confusion", """
SELECT head, y, CAST(p >= 0.5 AS INT) AS pred, COUNT(*) AS n FROM scored_long GROUP BY 1, 2, 3""")
def _(fx):
    return E.eval_confusion(fx.scored_long.withColumn("pred", (F.col("p") >= 0.5).cast("int")), ["head"])


def _called(fx):
    return K.high_confidence(class_scores(fx), CLASSES, 0.5)


def _class_confusion(fx):
    at = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("predicted_class")) - 1
    return E.eval_confusion(_called(fx).withColumn("pred", at.cast("int")))


REPORT_SQL = """
SELECT cls, COUNT(*) FILTER (y = cls) AS support, COUNT(*) FILTER (y = cls AND pred = cls) AS tp,
       COUNT(*) FILTER (pred = cls) AS n_pred
FROM (SELECT y, CASE predicted_class WHEN 'enhancer' THEN 0 WHEN 'silencer' THEN 1 ELSE 2 END AS pred FROM calls),
     (VALUES (0), (1), (2)) v(cls) WHERE y = cls OR pred = cls GROUP BY 1"""


@query("class_report", f"""
SELECT cls, support, round(COALESCE(tp / NULLIF(n_pred, 0)::DOUBLE, 0), 9) AS precision,
       round(COALESCE(tp / NULLIF(support, 0)::DOUBLE, 0), 9) AS recall,
       round(COALESCE(2 * tp / NULLIF(n_pred + support, 0)::DOUBLE, 0), 9) AS f1 FROM ({REPORT_SQL})""")
def _(fx):
    return rounded(E.class_report(_class_confusion(fx)), ["precision", "recall", "f1"])


@query("report_averages", f"""
SELECT round(AVG(f1), 9) AS macro_f1, round(SUM(f1 * support) / SUM(support), 9) AS weighted_f1
FROM (SELECT support, COALESCE(2 * tp / NULLIF(n_pred + support, 0)::DOUBLE, 0) AS f1 FROM ({REPORT_SQL}))""")
def _(fx):
    return rounded(E.report_averages(E.class_report(_class_confusion(fx))), ["macro_f1", "weighted_f1"])


@query("eval_prob_or", "SELECT model, row_id, y, round(p, 9) AS p FROM any_head")
def _(fx):
    return rounded(E.eval_prob_or(_models(fx), E.SHARED_HEADS, ["model"]), ["p"])


@query("calib_prior", f"""
WITH c AS ({CLASS_SQL}), n AS (SELECT COUNT(*) FILTER (y = 0) / COUNT(*)::DOUBLE * 3 AS f0, COUNT(*) FILTER (y = 1)
  / COUNT(*)::DOUBLE * 3 AS f1, COUNT(*) FILTER (y = 2) / COUNT(*)::DOUBLE * 3 AS f2 FROM c)
SELECT doc_id, round(p0 * f0 / t, 9) AS c0, round(p1 * f1 / t, 9) AS c1, round(p2 * f2 / t, 9) AS c2
FROM (SELECT *, CASE WHEN p0 * f0 + p1 * f1 + p2 * f2 <= 0 THEN 1 ELSE p0 * f0 + p1 * f1 + p2 * f2 END AS t FROM c, n)""")
def _(fx):
    d = E.calib_prior(class_scores(fx), 3)
    return d.select("doc_id", *[F.round(F.get("corrected", F.lit(i)), 9).alias(f"c{i}") for i in range(3)])


@query("calib_margin_argmax", f"""
SELECT doc_id, CASE WHEN p0 - 0.4 >= p1 - 0.2 AND p0 - 0.4 >= p2 - 0.5 THEN 0 WHEN p1 - 0.2 >= p2 - 0.5 THEN 1 ELSE 2 END
       AS pred FROM ({CLASS_SQL})""")
def _(fx):
    return E.calib_margin_argmax(class_scores(fx), [0.4, 0.2, 0.5]).select("doc_id", "pred")


@query("calib_reliability", f"""
SELECT head, CAST(len(list_filter([{', '.join(f'{e!r}::DOUBLE' for e in E.EDGES)}], lambda x: x <= p)) - 1 AS INT) AS bin,
       COUNT(*) AS n, round(AVG(p), 9) AS mean_p, round(AVG(y), 9) AS mean_y
FROM scored_long WHERE p < 1 GROUP BY 1, 2""")
def _(fx):
    return rounded(E.calib_reliability(fx.scored_long), ["mean_p", "mean_y"])


def _hist_sql(src: str, v: str, by: str, bins: int) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
SELECT {keys}CAST(least(COALESCE(floor(({v} - lo) / NULLIF(hi - lo, 0) * {bins}), 0), {bins - 1}) AS INT) AS bin,
       COUNT(*) AS n FROM (SELECT *, MIN({v}) OVER ({part}) AS lo, MAX({v}) OVER ({part}) AS hi FROM {src}) GROUP BY ALL"""


@query("eval_confidence", f"""
SELECT 'all' AS predicted_class, bin, n FROM ({_hist_sql('calls', 'confidence', '', 50)})
UNION ALL SELECT predicted_class, bin, n FROM ({_hist_sql('calls', 'confidence', 'predicted_class', 30)})""")
def _(fx):
    return E.eval_confidence(_called(fx))


@query("eval_histogram", f"SELECT head, y, bin, n FROM ({_hist_sql('scored_long', 'p', 'head, y', 50)})")
def _(fx):
    return E.eval_histogram(fx.scored_long)


@query("eval_joint_histogram", """
SELECT CAST(least(floor(p_a * 50), 49) AS INT) AS bin_a, CAST(least(floor(p_b * 50), 49) AS INT) AS bin_b, COUNT(*) AS n
FROM scored GROUP BY 1, 2""")
def _(fx):
    return E.eval_joint_histogram(fx.scored, "p_a", "p_b")


@query("eval_compare_models", """
WITH a AS (SELECT model, p, SUM(y) AS pos, SUM(1 - y) AS neg, SUM(SUM(y)) OVER w AS n_pos, SUM(SUM(1 - y)) OVER w AS n_neg,
  SUM(SUM(y)) OVER (PARTITION BY model ORDER BY p DESC) AS tp, SUM(SUM(1 - y)) OVER (PARTITION BY model ORDER BY p DESC) AS fp,
  SUM(SUM(1 - y)) OVER (PARTITION BY model ORDER BY p) - SUM(1 - y) AS nb
  FROM any_head GROUP BY 1, 2 WINDOW w AS (PARTITION BY model)),
r AS (SELECT model, SUM(pos * (nb + neg * 0.5::DOUBLE)) / (MAX(n_pos) * MAX(n_neg))::DOUBLE AS reg_auroc,
        SUM(pos * (tp / (tp + fp)::DOUBLE)) / MAX(n_pos)::DOUBLE AS reg_auprc FROM a GROUP BY 1),
f AS (SELECT model, 2 * COUNT(*) FILTER (p >= 0.5 AND y = 1) / (COUNT(*) FILTER (p >= 0.5) + SUM(y))::DOUBLE AS reg_f1
      FROM any_head GROUP BY 1),
m AS (SELECT model, AVG(auroc) AS a, AVG(auprc) AS b, AVG(f1) AS c FROM heads GROUP BY 1)
SELECT model, round(a, 8) AS macro_auroc, round(b, 8) AS macro_auprc, round(c, 8) AS macro_f1,
       round(a, 8) AS macro_auroc_shared, round(b, 8) AS macro_auprc_shared, round(reg_auroc, 8) AS reg_auroc,
       round(reg_auprc, 8) AS reg_auprc, round(reg_f1, 8) AS reg_f1 FROM m JOIN r USING (model) JOIN f USING (model)""")
def _(fx):
    d = E.eval_compare_models(_models(fx))
    return rounded(d, [c for c in d.columns if c != "model"], 8)


@query("agg_fold_summary", """
SELECT head AS metric, COUNT(*) AS n_folds, round(AVG(v), 9) AS mean, round(COALESCE(stddev_samp(v), 0), 9) AS std
FROM (SELECT head, row_id % 10 AS fold, AVG(p) AS v FROM scored_long WHERE row_id % 10 <> 3 GROUP BY 1, 2) GROUP BY 1""")
def _(fx):
    f = fx.scored_long.groupBy(F.col("head").alias("metric"), (F.col("row_id") % 10).alias("fold")).agg(F.avg("p").alias("value"))
    f = f.withColumn("value", F.when(F.col("fold") == 3, float("nan")).otherwise(F.col("value")))
    return rounded(E.agg_fold_summary(f), ["mean", "std"])


@query("score_ensemble", """
WITH w AS (SELECT model, exp(10 * AVG(f1)) / SUM(exp(10 * AVG(f1))) OVER () AS w FROM heads GROUP BY 1)
SELECT row_id, head, MAX(y) AS y, round(SUM(p * w) / SUM(w), 8) AS p FROM models JOIN w USING (model) GROUP BY 1, 2""")
def _(fx):
    s = _models(fx)
    w = E.softmax_weights(E.macro_metrics(E.head_metrics(s, MH)).select("model", "macro_f1"))
    return rounded(E.score_ensemble(s, w), ["p"], 8)


@query("split_chrom", """
SELECT chrom, CASE WHEN CAST(substr(chrom, 4) AS INT) <= 17 THEN 'train' WHEN CAST(substr(chrom, 4) AS INT) <= 20 THEN 'val'
       ELSE 'test' END AS split, COUNT(*) AS n FROM corpus GROUP BY 1""")
def _(fx):
    return K.agg_peak_corpus(fx.peak_labels()).groupBy("chrom", E.split_chrom().alias("split")).agg(F.count("*").alias("n"))


@query("split_loco", """
WITH s AS (SELECT chrom, (row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT)) - 1) AS r FROM (
             SELECT DISTINCT chrom FROM corpus)),
f AS (SELECT chrom, CAST((CAST(substr(chrom, 4) AS INT) - CASE WHEN CAST(substr(chrom, 4) AS INT) <= 7 THEN 1 ELSE 0 END)
             % 10 AS INT) AS fold FROM s)
SELECT chrom, fold, CASE fold WHEN 3 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS split, COUNT(*) AS n
FROM corpus JOIN f USING (chrom) GROUP BY 1, 2""")
def _(fx):
    return E.split_loco(K.agg_peak_corpus(fx.peak_labels()), 3).groupBy("chrom", "fold", "split").agg(F.count("*").alias("n"))


@query("sample_balanced", """
WITH pool AS (SELECT chrom, peak_start, peak_end, primary_label, row_number() OVER (PARTITION BY primary_label
         ORDER BY md5(chrom || '|' || peak_start || '|' || peak_end), chrom, peak_start, peak_end) - 1 AS pos FROM corpus),
cls AS (SELECT primary_label, n, row_number() OVER (ORDER BY primary_label) - 1 AS c, COUNT(*) OVER () AS k FROM (
         SELECT primary_label, COUNT(*) AS n FROM corpus GROUP BY 1)),
d AS (SELECT i AS draw, ('0x' || substr(md5(i || '|class|0'), 1, 8))::BIGINT AS a,
             ('0x' || substr(md5(i || '|row|0'), 1, 8))::BIGINT AS b FROM range(0, (SELECT COUNT(*) FROM corpus)) r(i))
SELECT draw, pool.primary_label, chrom, peak_start, peak_end FROM d JOIN cls ON c = a % k
JOIN pool ON pool.primary_label = cls.primary_label AND pos = b % n""")
def _(fx):
    c = durable(K.agg_peak_corpus(fx.peak_labels()).select(*K.PEAK, "primary_label"))  # read four times
    return E.sample_balanced(c, "primary_label", K.PEAK, c.count()).select("draw", "primary_label", *K.PEAK)


ENRICH_SQL = """
WITH t AS (SELECT DISTINCT chrom, peak_start, peak_end, tf_motif AS tf FROM corpus_rows),
c AS (SELECT chrom, peak_start, peak_end, CASE WHEN contains(all_labels, 'enhancer') THEN
        CASE WHEN contains(all_labels, 'silencer') THEN 'enhancer_silencer' ELSE 'enhancer' END
        WHEN contains(all_labels, 'silencer') THEN 'silencer' ELSE 'neither' END AS category FROM corpus),
n AS (SELECT tf, category, COUNT(*) AS n FROM t JOIN c USING (chrom, peak_start, peak_end) GROUP BY 1, 2),
k AS (SELECT category, COUNT(*) AS n_cat, SUM(COUNT(*)) OVER () AS n_all FROM c GROUP BY 1),
g AS (SELECT x.tf, k.category, COALESCE(n.n, 0) / n_cat::DOUBLE AS f, n_tf / n_all::DOUBLE AS o
      FROM (SELECT tf, SUM(n) AS n_tf FROM n GROUP BY 1) x CROSS JOIN k LEFT JOIN n ON n.tf = x.tf AND n.category = k.category)
SELECT tf, category, round(log2((f + 1e-6) / (o + 1e-6)), 8) AS log2fc,
       round(MAX(abs(log2((f + 1e-6) / (o + 1e-6)))) OVER (PARTITION BY tf), 8) AS score FROM g WHERE o > 0.001"""


@query("agg_tf_enrichment", ENRICH_SQL)
def _(fx):
    rows = durable(fx.peak_labels())  # read twice, and so is what is made of them
    flags = K.multilabel_flags(K.agg_peak_corpus(rows))
    cat = flags.withColumn("category", R.categorize_2head("is_enhancer", "is_silencer"))
    return rounded(E.agg_tf_enrichment(durable(K.join_tf_lookup(cat, rows))), ["log2fc", "score"], 8)


# ---------------------------------------------------------------- sequences

def _windows(fx):
    """Windows along every sequence, the ends included."""
    n = F.length("seq")
    at = F.sequence(F.lit(0).cast("bigint"), n.cast("bigint"), F.lit(512).cast("bigint"))
    return fx.genome.select("chrom", F.explode(at).alias("peak_start")).withColumn("peak_end", F.col("peak_start") + 201)


WINDOW_SQL = """
SELECT chrom, seq, s AS peak_start, s + 201 AS peak_end, (s + s + 201) // 2 - 256 AS l, length(seq) AS n
FROM (SELECT chrom, seq, unnest(range(0, length(seq) + 1, 512)) AS s FROM genome)"""
SEQ_SQL = f"""
SELECT chrom, peak_start, peak_end, rpad(substr(seq, CAST(greatest(l, 0) AS INT) + 1, CAST(greatest(least(l + 512, n)
       - greatest(l, 0), 0) AS INT)), 512, 'N') AS sequence FROM ({WINDOW_SQL})"""


def _sequences(fx):
    return G.seq_window(_windows(fx), G.tile_genome(fx.genome))


@query("seq_window", SEQ_SQL)
def _(fx):
    return _sequences(fx).select("chrom", "peak_start", "peak_end", "sequence")


@query("join_seq_window", SEQ_SQL)
def _(fx):
    tiles = G.tile_pieces(G.genome_pieces(fx.genome, 777), 1000)
    return G.seq_window(_windows(fx), tiles, tile=1000).select("chrom", "peak_start", "peak_end", "sequence")


@query("seq_base_codes", f"""
SELECT chrom, peak_start, array_to_string(list_transform(string_split(sequence, ''), lambda c: CASE c WHEN 'A' THEN 0
  WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 255 END), ' ') AS codes FROM ({SEQ_SQL})""")
def _(fx):
    codes = F.array_join(Q.seq_base_codes("sequence").cast("array<string>"), " ")
    return _sequences(fx).select("chrom", "peak_start", codes.alias("codes"))


@query("seq_revcomp", f"""
SELECT chrom, peak_start, reverse(translate(sequence, 'ACGT', 'TGCA')) AS revcomp FROM ({SEQ_SQL})""")
def _(fx):
    return _sequences(fx).select("chrom", "peak_start", Q.seq_revcomp("sequence").alias("revcomp"))


@query("seq_kmer", """
SELECT chrom, kmer, round(COUNT(*) / (MAX(n) - 5)::DOUBLE, 9) AS freq FROM (
  SELECT chrom, length(seq) AS n, substr(replace(seq, 'N', 'A'), CAST(unnest(range(1, length(seq) - 4)) AS INT), 6) AS kmer
  FROM genome) GROUP BY 1, 2""")
def _(fx):
    return rounded(G.seq_kmer(fx.genome, ["chrom"], "seq"), ["freq"])


@query("coord_strings", """
SELECT DISTINCT chrom || ':' || peak_start || '-' || peak_end AS coord, chrom, peak_start AS r_start, peak_end AS r_end
FROM footprints""")
def _(fx):
    c = fx.footprints.select(coord("chrom", "peak_start", "peak_end").alias("coord")).distinct()
    return c.select("coord", *parse_coord("coord"))


@query("clean_scores", """
SELECT flag, round(SUM(CASE WHEN tf_motif LIKE 'TF1%' THEN 0 ELSE motif_score END), 6) AS total FROM footprints GROUP BY 1""")
def _(fx):
    bad = F.when(F.col("tf_motif").startswith("TF1"), F.lit(float("nan"))).otherwise(F.col("motif_score"))
    return fx.footprints.groupBy("flag").agg(F.round(F.sum(clean_number(bad)), 6).alias("total"))


# ---------------------------------------------------------------- features and baselines

@query("feat_tf_vector", """
WITH v AS (SELECT tf_motif, row_number() OVER (ORDER BY tf_motif) - 1 AS i FROM (SELECT DISTINCT tf_motif FROM corpus_rows))
SELECT chrom, peak_start, peak_end, string_agg(i, ' ' ORDER BY i) AS bits FROM (
  SELECT DISTINCT chrom, peak_start, peak_end, i FROM corpus_rows JOIN v USING (tf_motif)) GROUP BY 1, 2, 3""")
def _(fx):
    from pyspark.ml.functions import vector_to_array

    rows = fx.peak_labels()
    d = L.feat_tf_vector(K.join_tf_lookup(rows.select(*K.PEAK).distinct(), rows))
    on = F.filter(F.transform(vector_to_array("features"), lambda bit_value, bit_at: F.when(bit_value > 0, bit_at)),
                  lambda bit_at: bit_at.isNotNull())
    return d.select(*K.PEAK, F.array_join(on.cast("array<string>"), " ").alias("bits"))


def _labelled_peaks(fx):
    rows = durable(fx.peak_labels())  # read twice, and so is the corpus
    c = durable(K.agg_peak_corpus(rows))
    flags = K.multilabel_flags(c)
    d = K.join_tf_lookup(c.join(flags, K.PEAK), rows).withColumn("split", E.split_chrom())
    return d.withColumns({"is_enhancer": F.col("is_enhancer").cast("double"), "is_silencer": F.col("is_silencer").cast("double")})


@query("train_logistic_tf")
def _(fx):
    return L.score_metrics(L.train_logistic_tf(_labelled_peaks(fx), E.SHARED_HEADS, K.PEAK))


@query("train_gbt")
def _(fx):
    return L.score_metrics(L.train_gbt(_labelled_peaks(fx), E.SHARED_HEADS, K.PEAK))


#: Sequences that a task counts k-mers of.
SEQUENCES = 1 << 13


@query("train_logistic_kmer")
def _(fx):
    y = fx.table("labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"),
                                  F.col("quality").cast("double").alias("is_enhancer"),
                                  F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"))
    seqs = fx.genome.join(y, "chrom").withColumnRenamed("seq", "sequence")
    tasks = tasks_for(y.count(), SEQUENCES)
    return L.score_metrics(L.train_logistic_kmer(seqs, ["is_enhancer"], ["chrom"], tasks=tasks))


# ---------------------------------------------------------------- stream of cells

@query("incr_new_cells", """
WITH n AS (SELECT subtype, COUNT(DISTINCT cell_id) AS n_cells FROM peaks GROUP BY 1)
SELECT p.subtype, chrom, r_start, r_end, COUNT(DISTINCT cell_id) AS cnt, n_cells,
       round(COUNT(DISTINCT cell_id) * 100.0::DOUBLE / n_cells, 9) AS pct FROM peaks p JOIN n USING (subtype)
GROUP BY 1, 2, 3, 4, n_cells""")
def _(fx):
    path = scratch_path(fx.spark, "cells")
    rows = fx.peaks.select("subtype", "cell_id", "chrom", "r_start", "r_end").withColumn("part", F.col("cell_id") % 6)
    rows.repartition("part").write.parquet(f"{path}/in")
    stream = lambda: incr_new_cells(fx.spark, f"{path}/in", rows.schema, f"{path}/table", f"{path}/log", 2)
    stream()
    stream()  # nothing new: no cell counts twice
    return rounded(read_counts(fx.spark, f"{path}/table"), ["pct"])
