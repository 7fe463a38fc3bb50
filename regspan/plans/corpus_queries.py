"""Queries: scans, recodes, interval joins, overlap summaries and the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from regspan.functions import coords as C, recode as R
from regspan.operators import corpus as K, intervals as I, overlap as O
from regspan.plans.registry import query
from regspan.session import durable, scratch_path
from regspan.sources import bed as B, tables as S


def _overlaps(fx):
    f = fx.footprints.withColumnRenamed("strand", "fp_strand")
    return I.join_interval(f, fx.annotations, ("fp_start", "fp_end"), ("ann_start", "ann_end"), left_levels=1)


# ---------------------------------------------------------------- scans and sinks

def _bed_lines(fx):
    f = fx.footprints
    gap = [F.lit(".") for _ in range(7)]
    fields = ["chrom", "fp_start", "fp_end", "tf_motif", "motif_score", "strand", F.col("chrom"), "peak_start",
              "peak_end", *gap, "fp_score"]
    line = F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in fields])
    # every 50th site also leaves a short line and a line with a bad coordinate behind
    junk = F.when(F.col("fp_start") % 50 == 10, F.array(line, F.concat("chrom", F.lit("\tx")), F.regexp_replace(
        line, r"\t\d+\t", "\tNA\t"))).otherwise(F.array(line))
    return f.select("grp", "subtype", F.explode(junk).alias("value"))


@query("scan_bed", """
SELECT grp, subtype, chrom, fp_start, fp_end, tf_motif, motif_score, strand, peak_start, peak_end, fp_score
FROM footprints""")
def _(fx):
    path = scratch_path(fx.spark, "bed")
    _bed_lines(fx).write.partitionBy("grp", "subtype").text(path)
    rows = B.scan_bed(fx.spark, f"{path}/*/*/*")
    return rows.select(
        F.regexp_extract("path", "grp=([^/]+)", 1).alias("grp"),
        F.regexp_extract("path", "subtype=([^/]+)", 1).alias("subtype"),
        "chrom", "fp_start", "fp_end", "tf_motif", "motif_score", "strand", "peak_start", "peak_end", "fp_score")


def _csv_layouts(fx):
    """Annotation overlaps in the enhancer layout and in the regulome layout."""
    o = _overlaps(fx)
    text = lambda c: F.col(c).cast("string")
    enh = o.where("ann_class = 'enhancer'").select(
        F.col("chrom").alias("Chromosome"), text("peak_start").alias("Extra7_b"), text("peak_end").alias("Extra8_b"),
        F.col("tf_motif").alias("Extra3_b"), text("motif_score").alias("Extra4_b"), text("fp_score").alias("Extra16"))
    reg = o.where("ann_class <> 'enhancer'").select(
        F.regexp_replace("chrom", "chr", "Chr_").alias("Chromosome"), F.col("ann_class").alias("Extra3"),
        F.col("tf_motif").alias("Extra3_b"), text("motif_score").alias("Extra4_b"),
        text("peak_start").alias("Extra7"), text("peak_end").alias("Extra8"), text("fp_score").alias("Extra16"))
    return enh, reg


@query("scan_csv_union", """
SELECT CASE WHEN ann_class = 'enhancer' THEN f.chrom ELSE replace(f.chrom, 'chr', 'Chr_') END AS chromosome,
       CASE WHEN ann_class = 'enhancer' THEN NULL ELSE ann_class END AS extra3,
       CASE WHEN ann_class = 'enhancer' THEN CAST(peak_start AS VARCHAR) END AS extra7_b,
       CASE WHEN ann_class = 'enhancer' THEN NULL ELSE CAST(peak_start AS VARCHAR) END AS extra7,
       tf_motif AS extra3_b, COUNT(*) AS n
FROM footprints f JOIN annotations a ON f.chrom = a.chrom AND fp_start < ann_end AND ann_start < fp_end
GROUP BY ALL""")
def _(fx):
    path = scratch_path(fx.spark, "csv")
    enh, reg = _csv_layouts(fx)
    enh.write.option("header", True).csv(f"{path}/enhancer")
    reg.write.option("header", True).csv(f"{path}/regulome")
    rows = B.scan_csv_union(fx.spark, [f"{path}/enhancer", f"{path}/regulome"])
    cols = ["Chromosome", "Extra3", "Extra7_b", "Extra7", "Extra3_b"]
    return rows.groupBy(*[F.col(c).alias(c.lower()) for c in cols]).agg(F.count("*").alias("n"))


def _file_name(fx):
    """A file per cell in the layout ``<grp>_sorted_.../<subtype>/<cell>.bed``."""
    stem = F.concat(F.when(F.col("cell_id") % 2 == 0, F.lit("MM_")).otherwise(F.lit("S")),
                    (F.col("cell_id") % 7).cast("string"), F.lit("_X"), F.col("cell_id").cast("string"),
                    F.when(F.col("cell_id") % 3 == 0, F.lit("_BD_")).otherwise(F.lit("")))
    return fx.cells.select("cell_id", F.concat(
        F.lit("/data/"), "grp", F.lit("_sorted_scBAMs_merged_beds/"), "subtype", F.lit("/"), stem,
        F.lit("_merged.bed")).alias("path"))


@query("scan_path_columns", """
SELECT cell_id, grp, subtype,
       CASE WHEN cell_id % 2 = 0 THEN 'MM_' ELSE 'S' END || (cell_id % 7) || '_X' || cell_id ||
       CASE WHEN cell_id % 3 = 0 THEN '' ELSE '_merged' END AS cell,
       CASE WHEN cell_id % 2 = 0 THEN 'MM_' || (cell_id % 7) ELSE 'S' || (cell_id % 7) END AS sample
FROM cells""")
def _(fx):
    return B.scan_path_columns(_file_name(fx)).select("cell_id", "grp", "subtype", "cell", "sample")


@query("scan_resolve_file", """
WITH listing AS (
  SELECT '/d/' || subtype AS dir, 'C' || cell_id AS stem, k.kind, s.suffix, s.prio
  FROM cells, (VALUES ('enhancer'), ('regulome'), ('promoter'), ('gtf')) k(kind)
  JOIN (VALUES ('enhancer', '_merged_overlaps_enhancer.csv', 0), ('enhancer', '_BD_merged_overlaps_enhancer.csv', 1),
               ('regulome', '_merged_overlaps_REGULOME.csv', 0), ('promoter', '_BD_merged_overlaps_PROMOTER.bed', 1),
               ('gtf', '__merged_overlaps_GTF.csv', 0), ('gtf', '_BD__merged_overlaps_GTF.csv', 2),
               ('gtf', '_odd_GTF_name.csv', 99)) s(kind, suffix, prio)
    ON s.kind = k.kind AND (cell_id + prio) % 3 <> 0)
SELECT dir, stem, kind, arg_min(dir || '/' || stem || suffix, prio) AS path FROM listing GROUP BY 1, 2, 3""")
def _(fx):
    names = [("_merged_overlaps_enhancer.csv", 0), ("_BD_merged_overlaps_enhancer.csv", 1),
             ("_merged_overlaps_REGULOME.csv", 0), ("_BD_merged_overlaps_PROMOTER.bed", 1),
             ("__merged_overlaps_GTF.csv", 0), ("_BD__merged_overlaps_GTF.csv", 2), ("_odd_GTF_name.csv", 99)]
    present = F.array(*[F.when((F.col("cell_id") + p) % 3 != 0, F.lit(n)) for n, p in names])
    listing = fx.cells.select(F.concat(F.lit("/d/"), "subtype").alias("dir"),
                              F.concat(F.lit("C"), F.col("cell_id").cast("string")).alias("stem"),
                              F.explode(F.array_compact(present)).alias("suffix"))
    return S.scan_resolve_file(listing.select("dir", "stem", F.concat("dir", F.lit("/"), "stem", "suffix").alias("path")))


@query("scan_gtf_genes", """
SELECT chrom, gene_start, gene_end, strand, 'ENSG' || substr(gene_name, 10) AS gene_id, gene_name, gene_type, tss
FROM genes_tss""")
def _(fx):
    path = scratch_path(fx.spark, "gtf")
    gid = F.concat(F.lit("ENSG"), F.substring("gene_name", 10, 100))
    attrs = F.concat(F.lit('gene_id "'), gid, F.lit('.5"; gene_type "'), "gene_type", F.lit('"; gene_name "'),
                     "gene_name", F.lit('"; level 2;'))
    line = lambda feature: F.concat_ws(
        "\t", "chrom", F.lit("HAVANA"), F.lit(feature), F.col("gene_start").cast("string"),
        F.col("gene_end").cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    fx.genes.select(F.explode(F.array(line("gene"), line("exon"), F.lit("# note"))).alias("value")).write.text(path)
    return B.scan_gtf_genes(fx.spark, path)


@query("scan_source_map", "SELECT grp, subtype, sample, cell_id, chrom, r_start, r_end, tag FROM source_tags")
def _(fx):
    return S.scan_source_map(**fx.source_rows())


@query("sink_parquet", """
SELECT chrom, peak_start, peak_end, all_labels, primary_label, n_tfs, max_motif_score, max_fp_score FROM corpus""")
def _(fx):
    path = scratch_path(fx.spark, "corpus")
    S.sink_parquet(K.agg_peak_corpus(fx.peak_labels()), path)
    return fx.spark.read.parquet(path).select(
        "chrom", "peak_start", "peak_end", F.array_join("all_labels", "|").alias("all_labels"), "primary_label",
        "n_tfs", "max_motif_score", "max_fp_score")


@query("sink_metadata", """
SELECT chrom || ':' || peak_start || '-' || peak_end AS coord, primary_label AS label, all_labels,
       CAST(n_tfs AS VARCHAR) AS n_tfs FROM corpus""")
def _(fx):
    path = scratch_path(fx.spark, "metadata")
    S.sink_metadata(K.agg_peak_corpus(fx.peak_labels()), path)
    return fx.spark.read.option("header", True).csv(path)


@query("dataset_info", """
SELECT 'n_regions' AS item, COUNT(*) AS n FROM corpus
UNION ALL SELECT 'n_tfs', COUNT(DISTINCT tf_motif) FROM corpus_rows
UNION ALL SELECT 'n_classes', COUNT(DISTINCT label) FROM corpus_rows
UNION ALL SELECT 'class:' || primary_label, COUNT(*) FROM corpus GROUP BY primary_label""")
def _(fx):
    rows = durable(fx.peak_labels())  # read twice
    return S.dataset_info(K.agg_peak_corpus(rows), rows)


@query("path_roster", """
WITH f AS (SELECT CASE grp WHEN 'G0' THEN 'ITL23' WHEN 'G1' THEN 'CHO' WHEN 'G2' THEN 'MSN'
                  WHEN 'G3' THEN CASE WHEN subtype = 'CTXMIX' THEN 'CTXMIX' END END AS g, subtype,
                  '/p/' || grp || '/' || (cell_id % 2) || '/' || subtype AS dir FROM cells)
SELECT g AS grp, subtype, COUNT(DISTINCT dir) AS n_dirs, COUNT(*) AS total_cells,
       string_agg(DISTINCT dir, ';' ORDER BY dir) AS dirs,
       CASE g WHEN 'ITL23' THEN 1 WHEN 'CHO' THEN 7 WHEN 'MSN' THEN 10 END AS place
FROM f WHERE g IN ('ITL23', 'CHO', 'MSN') GROUP BY g, subtype""")
def _(fx):
    return S.path_roster(_sources(fx))


def _sources(fx):
    src = (F.when(F.col("grp") == "G0", F.concat(F.lit("ITL23_rows_part"), (F.col("cell_id") % 2).cast("string")))
           .when(F.col("grp") == "G1", "CHO_rows").when(F.col("grp") == "G2", "MSN")
           .when(F.col("grp") == "G3", "MBGA").otherwise("elsewhere"))
    folder = F.concat(F.lit("/p/"), "grp", F.lit("/"), (F.col("cell_id") % 2).cast("string"), F.lit("/"), "subtype")
    return fx.cells.select(src.alias("source"), "subtype", folder.alias("dir"), "cell_id",
                           F.concat(folder, F.lit("/"), F.col("cell_id").cast("string")).alias("path"))


@query("incr_skip_done", "SELECT cell_id FROM cells WHERE NOT (cell_id % 3 = 0 AND cell_id % 5 <> 0)")
def _(fx):
    done = fx.cells.where("cell_id % 3 = 0").select(
        "cell_id", F.when(F.col("cell_id") % 5 == 0, 0).otherwise(10).alias("size"))
    return S.incr_skip_done(fx.cells.select("cell_id"), done, ["cell_id"])


# ---------------------------------------------------------------- projections and recodes

@query("proj_common_schema", """
SELECT chrom, peak_start, peak_end, tf_motif, motif_score, fp_score, label FROM corpus_rows
UNION ALL
SELECT f.chrom, peak_start, peak_end, tf_motif, motif_score, fp_score, 'promoter'
FROM footprints f JOIN annotations a ON f.chrom = a.chrom AND fp_start < ann_end AND ann_start < fp_end
WHERE ann_class = 'promoter'""")
def _(fx):
    text = lambda c, name: F.col(c).cast("string").alias(name)
    enh, reg = _csv_layouts(fx)
    promoter = _overlaps(fx).where("ann_class = 'promoter'").select(
        "chrom", text("peak_start", "peak_start"), text("peak_end", "peak_end"), "tf_motif", text("motif_score", "motif_score"),
        text("fp_score", "fp_score"))
    genes = fx.genes.select("chrom", (F.col("gene_start") - 1).alias("lo"), F.col("gene_end").alias("hi"))
    gtf = I.join_interval(fx.footprints, genes, ("fp_start", "fp_end"), ("lo", "hi"), left_levels=1).select(
        F.col("chrom").alias("Chromosome"), text("peak_start", "Extra7"), text("peak_end", "Extra8"),
        F.col("tf_motif").alias("Extra3"), text("motif_score", "Extra4"), text("fp_score", "Extra16"))
    layouts = {"enhancer": enh, "regulome": reg, "promoter": promoter, "gtf": gtf}
    return reduce(DataFrame.unionByName, [S.proj_common_schema(rows, kind) for kind, rows in layouts.items()])


@query("recode_regulome", """
SELECT ann_class, CASE WHEN lower(ann_class) IN ('enhancer', 'silencer', 'promoter') THEN lower(ann_class)
       WHEN lower(ann_class) LIKE 'protein_bind%' THEN 'TFBS' ELSE 'other_regulatory' END AS label, COUNT(*) AS n
FROM annotations GROUP BY ALL""")
def _(fx):
    return fx.annotations.groupBy("ann_class", R.recode_regulome("ann_class").alias("label")).agg(
        F.count("*").alias("n"))


def _region_types(fx):
    return fx.source_tags.select("chrom", "r_start", "r_end", "tag").distinct().groupBy(
        "chrom", "r_start", "r_end").agg(F.array_join(F.sort_array(F.collect_set("tag")), ";").alias("region_type"))


@query("recode_simplify_type", """
SELECT region_type, CASE WHEN region_type LIKE '%uncharacterized%' THEN 'uncharacterized'
         WHEN region_type LIKE '%insulator%' OR region_type LIKE '%enhancer_blocking%' THEN 'insulator'
         WHEN region_type LIKE '%enhancer%' THEN 'enhancer' WHEN region_type LIKE '%silencer%' THEN 'silencer'
         WHEN region_type LIKE '%promoter%' THEN 'promoter' WHEN region_type LIKE '%gene_body%' THEN 'gene_body'
         ELSE 'other_regulatory' END AS simple_type, COUNT(*) AS n
FROM region_types GROUP BY ALL""")
def _(fx):
    return _region_types(fx).groupBy(
        "region_type", R.recode_simplify_type("region_type").alias("simple_type")).agg(F.count("*").alias("n"))


@query("recode_known_class", """
SELECT region_type, CASE WHEN region_type LIKE '%enhancer%' THEN 'known|enhancer'
         WHEN region_type LIKE '%silencer%' THEN 'known|silencer' WHEN region_type LIKE '%promoter%' THEN
         'known|promoter' WHEN region_type LIKE '%gene_body%' THEN 'known|gene_body'
         ELSE 'known|other_regulatory' END AS known_class, COUNT(*) AS n
FROM region_types GROUP BY ALL""")
def _(fx):
    return _region_types(fx).groupBy(
        "region_type", R.recode_known_class("region_type").alias("known_class")).agg(F.count("*").alias("n"))


@query("recode_group", """
SELECT CASE grp WHEN 'G0' THEN 'ITL23' WHEN 'G1' THEN 'CHO' WHEN 'G2' THEN 'MSN' END AS grp_strict,
       CASE grp WHEN 'G0' THEN 'ITL23' WHEN 'G1' THEN 'CHO' WHEN 'G2' THEN 'MSN' WHEN 'G3' THEN 'MBGA'
                ELSE 'elsewhere' END AS grp_kept,
       COUNT(*) AS n_cells FROM cells GROUP BY ALL""")
def _(fx):
    return _sources(fx).groupBy(R.recode_group("source", "subtype").alias("grp_strict"),
                                R.recode_group("source", keep_unknown=True).alias("grp_kept")).agg(
        F.count("*").alias("n_cells"))


@query("recode_5class", """
SELECT CASE WHEN primary_label IN ('TFBS', 'cis_regulatory') THEN 'other_regulatory' ELSE primary_label END AS label,
       COUNT(*) AS n FROM corpus GROUP BY 1""")
def _(fx):
    return K.agg_peak_corpus(fx.peak_labels()).groupBy(R.recode_5class("primary_label").alias("label")).agg(
        F.count("*").alias("n"))


FLAGS_SQL = """
SELECT chrom, peak_start, peak_end, CAST(contains(all_labels, 'enhancer') AS INT) AS is_enhancer,
       CAST(contains(all_labels, 'promoter') AS INT) AS is_promoter,
       CAST(contains(all_labels, 'genic') AS INT) AS is_genic,
       CAST(contains(all_labels, 'silencer') AS INT) AS is_silencer FROM corpus"""


@query("multilabel_flags", FLAGS_SQL)
def _(fx):
    return K.multilabel_flags(K.agg_peak_corpus(fx.peak_labels()))


@query("multilabel_stats", f"""
SELECT COUNT(*) AS n_total, CAST(SUM(is_enhancer) AS BIGINT) AS n_enhancer,
       CAST(SUM(is_silencer) AS BIGINT) AS n_silencer,
       COUNT(*) FILTER (is_enhancer = 1 AND is_silencer = 1) AS n_both,
       COUNT(*) FILTER (is_enhancer = 0 AND is_silencer = 0) AS n_neither,
       CAST(SUM(is_promoter) AS BIGINT) AS n_promoter, CAST(SUM(is_genic) AS BIGINT) AS n_genic
FROM ({FLAGS_SQL})""")
def _(fx):
    return K.multilabel_stats(K.multilabel_flags(K.agg_peak_corpus(fx.peak_labels())))


@query("categorize_2head", """
SELECT category, CASE WHEN p_enhancer >= 0.3 AND p_silencer >= 0.7 THEN 'enhancer_silencer'
       WHEN p_enhancer >= 0.3 THEN 'enhancer' WHEN p_silencer >= 0.7 THEN 'silencer' ELSE 'neither' END AS shifted,
       COUNT(*) AS n
FROM predictions GROUP BY ALL""")
def _(fx):
    return fx.predictions.groupBy("category", R.categorize_2head("p_enhancer", "p_silencer", 0.3, 0.7).alias(
        "shifted")).agg(F.count("*").alias("n"))


def class_scores(fx):
    """Three class probabilities per scored document, from its two scores."""
    s = fx.scored.withColumn("t", F.col("p_a") + F.col("p_b") + 0.5)
    return s.select("doc_id", F.when(F.col("y_a") == 0, 2).when(F.col("y_b") == 1, 1).otherwise(0).alias("y"),
                    F.array(F.col("p_a") / F.col("t"), F.col("p_b") / F.col("t"), F.lit(0.5) / F.col("t")).alias("probs"))


CLASS_SQL = """
SELECT doc_id, CASE WHEN y_a = 0 THEN 2 WHEN y_b = 1 THEN 1 ELSE 0 END AS y, p_a / (p_a + p_b + 0.5) AS p0,
       p_b / (p_a + p_b + 0.5) AS p1, 0.5 / (p_a + p_b + 0.5) AS p2 FROM scored"""
CALL_SQL = f"""
SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'enhancer' WHEN p1 >= p2 THEN 'silencer' ELSE 'genic' END
          AS predicted_class, greatest(p0, p1, p2) AS confidence FROM ({CLASS_SQL})"""
CLASSES = ["enhancer", "silencer", "genic"]


@query("high_confidence", f"""
SELECT predicted_class, COUNT(*) AS n, COUNT(*) FILTER (confidence >= 0.5) AS n_high FROM ({CALL_SQL}) GROUP BY 1""")
def _(fx):
    return K.high_confidence_totals(K.high_confidence(class_scores(fx), CLASSES, 0.5))


@query("filter_std_chroms", """
SELECT chrom, COUNT(*) AS n FROM (SELECT CASE WHEN fp_start % 7 = 0 THEN chrom || '_alt' ELSE chrom END AS chrom
FROM footprints) WHERE chrom NOT LIKE '%alt' GROUP BY 1""")
def _(fx):
    alt = F.when(F.col("fp_start") % 7 == 0, F.concat("chrom", F.lit("_alt"))).otherwise(F.col("chrom"))
    return K.filter_std_chroms(fx.footprints.select(alt.alias("chrom"))).groupBy("chrom").agg(F.count("*").alias("n"))


@query("chrom_code", """
SELECT chrom, CAST(substr(chrom, 4) AS INT) AS code, COUNT(*) AS n FROM footprints GROUP BY ALL""")
def _(fx):
    return fx.footprints.groupBy("chrom", R.chrom_code("chrom").alias("code")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- joins

@query("join_interval", """
SELECT cell_id, f.chrom, fp_start, fp_end, tf_motif, ann_start, ann_end, ann_class, COUNT(*) AS n
FROM footprints f JOIN annotations a ON f.chrom = a.chrom AND fp_start < ann_end AND ann_start < fp_end
GROUP BY ALL""")
def _(fx):
    return _overlaps(fx).groupBy("cell_id", "chrom", "fp_start", "fp_end", "tf_motif", "ann_start", "ann_end",
                                 "ann_class").agg(F.count("*").alias("n"))


@query("join_interval_exists", """
SELECT DISTINCT p.chrom, p.r_start, p.r_end FROM (SELECT DISTINCT chrom, r_start, r_end FROM peaks) p
WHERE EXISTS (SELECT 1 FROM annotations a WHERE a.chrom = p.chrom AND ann_start <= r_end AND ann_end > r_start)""")
def _(fx):
    sites = fx.peaks.select("chrom", "r_start", "r_end").distinct()
    return I.join_interval_exists(sites, fx.annotations, ("r_start", "r_end"), ("ann_start", "ann_end"), left_levels=1)


ANNOTATED = """
SELECT DISTINCT cell_id, f.chrom, fp_start, fp_end
FROM footprints f JOIN annotations a ON f.chrom = a.chrom AND fp_start < ann_end AND ann_start < fp_end"""


@query("join_anti_coords", f"""
SELECT cell_id, chrom, fp_start, fp_end, tf_motif, motif_score, fp_score FROM footprints f
WHERE NOT EXISTS (SELECT 1 FROM ({ANNOTATED}) s WHERE s.cell_id = f.cell_id AND s.chrom = f.chrom
                  AND s.fp_start = f.fp_start AND s.fp_end = f.fp_end)""")
def _(fx):
    return O.join_anti_coords(fx.footprints, _overlaps(fx)).select(
        "cell_id", "chrom", "fp_start", "fp_end", "tf_motif", "motif_score", "fp_score")


STATS_SQL = f"""
WITH sites AS (SELECT DISTINCT grp, cell_id, chrom, fp_start, fp_end FROM footprints),
     hits AS ({ANNOTATED}),
     per AS (SELECT grp, cell_id, COUNT(*) AS n_bound, COUNT(h.chrom) AS n_overlapped
             FROM sites LEFT JOIN hits h USING (cell_id, chrom, fp_start, fp_end) GROUP BY 1, 2)
SELECT grp, cell_id, n_bound, n_overlapped, n_bound - n_overlapped AS n_uncharacterized, 0 AS is_total FROM per
UNION ALL
SELECT grp, NULL, CAST(SUM(n_bound) AS BIGINT), CAST(SUM(n_overlapped) AS BIGINT),
       CAST(SUM(n_bound - n_overlapped) AS BIGINT), 1 FROM per GROUP BY grp"""


@query("agg_uncharacterized_stats", STATS_SQL)
def uncharacterized_stats(fx):
    return O.agg_uncharacterized_stats(fx.footprints, _overlaps(fx))


@query("set_union_sources", ANNOTATED)
def _(fx):
    o = _overlaps(fx)
    # one interval join holds all classes, so it is read once
    return O.set_union_sources(o.where(F.col("ann_class").isin(
        "enhancer", "silencer", "promoter", "response_element", "protein_bind_x")))


@query("set_difference", f"""
SELECT cell_id, chrom, fp_start, fp_end FROM footprints EXCEPT ({ANNOTATED})""")
def _(fx):
    return O.set_difference(fx.footprints, _overlaps(fx), O.SITE)


@query("join_tf_lookup", """
SELECT chrom, peak_start, peak_end, string_agg(DISTINCT tf_motif, '|' ORDER BY tf_motif) AS tfs
FROM corpus_rows GROUP BY 1, 2, 3""")
def _(fx):
    rows = fx.peak_labels()
    return K.join_tf_lookup(rows.select(*K.PEAK).distinct(), rows).select(
        *K.PEAK, F.array_join("tfs", "|").alias("tfs"))


@query("join_nearest_tss", """
WITH pts AS (SELECT DISTINCT chrom, (peak_start + peak_end) // 2 AS mid FROM footprints),
r AS (SELECT p.chrom, p.mid, g.gene_name, g.gene_type, mid - tss AS d,
             row_number() OVER (PARTITION BY p.chrom, p.mid ORDER BY abs(mid - tss), tss, gene_name) AS rn
      FROM pts p JOIN genes_tss g ON p.chrom = g.chrom),
rp AS (SELECT p.chrom, p.mid, g.gene_name, mid - tss AS d,
             row_number() OVER (PARTITION BY p.chrom, p.mid ORDER BY abs(mid - tss), tss, gene_name) AS rn
      FROM pts p JOIN genes_tss g ON p.chrom = g.chrom AND gene_type = 'protein_coding')
SELECT chrom, mid, r.gene_name AS nearest_gene, r.gene_type AS nearest_type, r.d AS dist_to_tss,
       rp.gene_name AS pc_nearest_gene, rp.d AS pc_dist_to_tss
FROM pts LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (chrom, mid)
LEFT JOIN (SELECT * FROM rp WHERE rn = 1) rp USING (chrom, mid)""")
def _(fx):
    return I.join_nearest_tss(_mids(fx), fx.genes)


def _mids(fx):
    return fx.footprints.select("chrom", C.midpoint("peak_start", "peak_end").alias("mid")).distinct()


@query("join_gene_body", """
WITH pts AS (SELECT DISTINCT chrom, (peak_start + peak_end) // 2 AS mid FROM footprints)
SELECT chrom, mid, (SELECT gene_name FROM genes_tss g WHERE g.chrom = pts.chrom AND gene_start <= mid
                    AND gene_end >= mid ORDER BY gene_type <> 'protein_coding', tss, gene_name LIMIT 1) AS within_gene
FROM pts""")
def _(fx):
    return I.join_gene_body(_mids(fx), fx.genes)


@query("join_locus_genes", """
WITH loci AS (SELECT chrom || ':' || ann_start || '-' || ann_end AS locus, chrom, ann_start AS l_start,
                     ann_end AS l_end FROM (SELECT DISTINCT chrom, ann_start, ann_end FROM annotations)),
pc AS (SELECT * FROM genes_tss WHERE gene_type = 'protein_coding'),
n AS (SELECT locus, gene_name, abs((l_start + l_end) // 2 - tss) AS d, row_number() OVER (
        PARTITION BY locus ORDER BY abs((l_start + l_end) // 2 - tss), gene_start, gene_name) AS rn
      FROM loci l JOIN pc ON l.chrom = pc.chrom),
t AS (SELECT locus, string_agg(DISTINCT gene_name, ',' ORDER BY gene_name) AS genes FROM loci l JOIN pc
      ON l.chrom = pc.chrom AND gene_start <= l_end AND gene_end >= l_start GROUP BY 1)
SELECT l.*, COALESCE(t.genes, '') AS genes, n.gene_name AS nearest_gene, n.d AS distance
FROM loci l LEFT JOIN t USING (locus) LEFT JOIN (SELECT * FROM n WHERE rn = 1) n USING (locus)""")
def _(fx):
    loci = fx.annotations.select("chrom", F.col("ann_start").alias("l_start"), F.col("ann_end").alias("l_end")
                                 ).distinct().withColumn("locus", C.coord("chrom", "l_start", "l_end"))
    return I.join_locus_genes(loci, fx.genes)


@query("join_metadata_select", """
SELECT cell_id, sample, subtype FROM cells
WHERE (sample, cell_id % 50) IN (SELECT n_name, s_suppkey % 50 FROM supplier JOIN nation ON s_nationkey = n_nationkey)
""")
def _(fx):
    chosen = fx.table("supplier").join(fx.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("sample"), (F.col("s_suppkey") % 50).alias("barcode"))
    return fx.cells.withColumn("barcode", F.col("cell_id") % 50).join(
        chosen, ["sample", "barcode"], "left_semi").select("cell_id", "sample", "subtype")


# ---------------------------------------------------------------- overlap summaries and corpus

@query("agg_overlap_gene", """
SELECT cell_id, f.chrom, gene_start, gene_end, gene_name, g.strand AS gene_strand, COUNT(*) AS n_overlaps,
       string_agg(DISTINCT tf_motif || '(' || f.strand || ')', ';' ORDER BY tf_motif || '(' || f.strand || ')') AS tfs
FROM footprints f JOIN genes g ON f.chrom = g.chrom AND fp_start < gene_end AND gene_start - 1 < fp_end
GROUP BY 1, 2, 3, 4, 5, 6""")
def _(fx):
    g = fx.genes.select("chrom", "gene_start", "gene_end", "gene_name", F.col("strand").alias("gene_strand"),
                        (F.col("gene_start") - 1).alias("g0"))
    f = fx.footprints.withColumnRenamed("strand", "fp_strand")
    o = I.join_interval(f, g, ("fp_start", "fp_end"), ("g0", "gene_end"), left_levels=1)
    return O.agg_overlap_gene(o, ["chrom", "gene_start", "gene_end", "gene_name", "gene_strand"])


@query("agg_overlap_regulome", """
SELECT cell_id, f.chrom, ann_start, ann_end, ann_class, COUNT(*) AS num_overlaps,
       string_agg(DISTINCT tf_motif, ',' ORDER BY tf_motif) AS tfs
FROM footprints f JOIN annotations a ON f.chrom = a.chrom AND fp_start < ann_end AND ann_start < fp_end
WHERE ann_class <> 'enhancer' GROUP BY 1, 2, 3, 4, 5""")
def _(fx):
    return O.agg_overlap_regulome(_overlaps(fx).where("ann_class <> 'enhancer'"))


@query("agg_overlap_enhancer", """
SELECT cell_id, f.chrom, ann_start, ann_end,
       string_agg(DISTINCT 'GENE' || (fp_start // 20 % 9), ';' ORDER BY 'GENE' || (fp_start // 20 % 9)) AS gene_symbols,
       arg_min('line' || (fp_start // 20 % 4), fp_start) AS cell_line, arg_min(fp_start - ann_start, fp_start) AS distance,
       string_agg(DISTINCT tf_motif || '/' || f.strand, ';' ORDER BY tf_motif || '/' || f.strand) AS tfs
FROM footprints f JOIN annotations a ON f.chrom = a.chrom AND fp_start < ann_end AND ann_start < fp_end
WHERE ann_class = 'enhancer' GROUP BY 1, 2, 3, 4""")
def _(fx):
    o = _overlaps(fx).where("ann_class = 'enhancer'").select(
        "*", F.concat(F.lit("GENE"), F.expr("fp_start div 20 % 9").cast("string")).alias("gene_symbol"),
        F.concat(F.lit("line"), F.expr("fp_start div 20 % 4").cast("string")).alias("cell_line"),
        (F.col("fp_start") - F.col("ann_start")).alias("distance"))
    return O.agg_overlap_enhancer(o, "fp_start")


@query("agg_peak_corpus", """
SELECT chrom, peak_start, peak_end, all_labels, primary_label, n_tfs, max_motif_score, max_fp_score,
       round(mean_motif_score, 9) AS mean_motif_score, round(mean_fp_score, 9) AS mean_fp_score FROM corpus""")
def _(fx):
    return K.agg_peak_corpus(fx.peak_labels()).withColumns({
        "all_labels": F.array_join("all_labels", "|"), "mean_motif_score": F.round("mean_motif_score", 9),
        "mean_fp_score": F.round("mean_fp_score", 9)})


@query("agg_class_distribution", "SELECT primary_label, COUNT(*) AS n FROM corpus GROUP BY 1")
def _(fx):
    return K.agg_class_distribution(K.agg_peak_corpus(fx.peak_labels()))


@query("agg_peak_predict", """
SELECT cell_id, chrom, peak_start, peak_end, string_agg(DISTINCT tf_motif, '|' ORDER BY tf_motif) AS tfs,
       MAX(motif_score) AS max_motif_score, MAX(fp_score) AS max_fp_score,
       round(AVG(motif_score), 9) AS mean_motif_score, round(AVG(fp_score), 9) AS mean_fp_score,
       COUNT(DISTINCT tf_motif) AS n_tfs
FROM footprints GROUP BY 1, 2, 3, 4""")
def _(fx):
    return K.agg_peak_predict(fx.footprints).withColumns({
        "tfs": F.array_join("tfs", "|"), "mean_motif_score": F.round("mean_motif_score", 9),
        "mean_fp_score": F.round("mean_fp_score", 9)})


@query("sort_corpus", "SELECT chrom, peak_start, peak_end, primary_label, n_tfs FROM corpus ORDER BY 1, 2, 3")
def _(fx):
    return S.sort_corpus(K.agg_peak_corpus(fx.peak_labels())).select(*K.PEAK, "primary_label", "n_tfs")


@query("vocabulary", """
SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS idx
FROM (SELECT DISTINCT tf_motif AS name FROM corpus_rows)""")
def _(fx):
    return K.vocabulary(fx.peak_labels(), "tf_motif")


@query("agg_class_weights", """
WITH c AS (SELECT primary_label AS label, COUNT(*) AS n FROM corpus GROUP BY 1)
SELECT label, n, round((1.0::DOUBLE / n) / SUM(1.0::DOUBLE / n) OVER () * COUNT(*) OVER (), 8) AS inverse_weight,
       round(SUM(n) OVER () / (COUNT(*) OVER () * n)::DOUBLE, 8) AS balanced_weight FROM c""")
def _(fx):
    c = K.agg_peak_corpus(fx.peak_labels()).groupBy(F.col("primary_label").alias("label")).agg(F.count("*").alias("n"))
    return K.agg_class_weights(c).select("label", "n", F.round("inverse_weight", 8).alias("inverse_weight"),
                                         F.round("balanced_weight", 8).alias("balanced_weight"))


@query("head_weights", f"""
WITH h AS (UNPIVOT (SELECT is_enhancer, is_silencer, is_promoter, is_genic FROM ({FLAGS_SQL}))
           ON is_enhancer, is_silencer, is_promoter, is_genic INTO NAME head VALUE y),
c AS (SELECT head, CAST(SUM(y) AS BIGINT) AS n_pos, CAST(COUNT(*) - SUM(y) AS BIGINT) AS n_neg FROM h GROUP BY 1)
SELECT head, n_pos, n_neg, round(least(n_neg / greatest(n_pos, 1)::DOUBLE, 20.0::DOUBLE), 8) AS pos_weight,
       round((n_pos + n_neg) / (2 * greatest(n_neg, 1))::DOUBLE, 8) AS weight_0,
       round((n_pos + n_neg) / (2 * greatest(n_pos, 1))::DOUBLE, 8) AS weight_1 FROM c""")
def _(fx):
    flags = K.multilabel_flags(K.agg_peak_corpus(fx.peak_labels()))
    w = K.head_weights(flags, ["is_enhancer", "is_silencer", "is_promoter", "is_genic"], cap=20.0)
    return w.select("head", "n_pos", "n_neg", *[F.round(c, 8).alias(c) for c in ("pos_weight", "weight_0", "weight_1")])
