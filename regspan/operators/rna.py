"""In-group contrasts of regions, their target genes, and concordance with RNA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regspan.functions import recode as R
from regspan.functions.coords import log2_ratio
from regspan.operators.intervals import join_gene_body, join_nearest_tss
from regspan.operators.pairwise import fdr_bh
from regspan.operators.scale import checked_broadcast, dealt, exact_quantiles
from regspan.operators.tf import mann_whitney
from regspan.session import durable

PRESENCE, FRAC_IN, FRAC_OUT = 20.0, 0.50, 0.10
MAX_TSS = 25_000
PSEUDO_RNA = 1e-3
SCALE = 1e4
SPAN = ["chrom", "r_start", "r_end"]
RKEY = [*SPAN, "basket", "region_class"]

# ---- fixed values: cluster labels by marker margin and by dissection keyword ----
MARKER_MARGIN = 0.1
DISSECTION_LABELS = {
    "collicul": "IC-DA", "septal": "Septal-DA", "mediodorsal": "MD-DA",
    "midbrain": "Midbrain-DA", "substantia": "SN-DA", "tegment": "VTA/tegm-DA",
}
# ---- end of fixed values ----


# ---------------------------------------------------------------- region contrasts

def region_side_stats(joint: DataFrame, inside: list[str], ref: list[str], presence: float = PRESENCE,
                      tasks: int | None = None) -> DataFrame:
    """Means, difference and present shares of both sides, for regions present in at least one subtype.

    ``tasks`` is the number of tasks that regions are dealt over (Spark's own if None).
    """
    d = dealt(joint, tasks, *RKEY).where(F.col("subtype").isin(inside + ref)).withColumn("inside", F.col("subtype").isin(inside))
    n1, n2 = len(inside), len(ref)
    i = F.col("inside")
    s = d.groupBy(*RKEY).agg(
        F.max("pct").alias("max_pct"),
        (F.sum(F.when(i, F.col("pct")).otherwise(0.0)) / n1).alias("in_mean"),
        (F.sum(F.when(~i, F.col("pct")).otherwise(0.0)) / n2).alias("ref_mean"),
        (F.count_if(i & (F.col("pct") >= presence)) / n1).alias("in_frac"),
        (F.count_if(~i & (F.col("pct") >= presence)) / n2).alias("ref_frac"))
    return s.where(F.col("max_pct") >= presence).drop("max_pct").withColumn(
        "delta_pct", F.col("in_mean") - F.col("ref_mean"))


def _tested(joint: DataFrame, chosen: DataFrame, inside: list[str], ref: list[str], by: list[str], tasks: int | None = None) -> DataFrame:
    """Mann-Whitney p and FDR within ``by`` for the chosen regions."""
    d = dealt(joint, tasks, *RKEY).where(F.col("subtype").isin(inside + ref)).join(chosen.select(*RKEY), RKEY, "left_semi").select(
        *RKEY, "pct", F.col("subtype").isin(inside).alias("inside"))
    p = mann_whitney(d, RKEY, "inside", "pct", len(inside), len(ref)).select(*RKEY, "mwu_p")
    out = durable(chosen.join(p, RKEY))
    return fdr_bh(out, "mwu_p", by, out="mwu_fdr")


def test_mwu_contrast(joint: DataFrame, inside: list[str], ref: list[str], presence: float = PRESENCE,
                      frac_in: float = FRAC_IN, frac_out: float = FRAC_OUT, tasks: int | None = None) -> DataFrame:
    """Regions present in the in-group and not in the reference (``specific``) or the reverse (``absent``).

    ``tasks`` as in ``region_side_stats``.
    """
    s = region_side_stats(joint, inside, ref, presence, tasks)
    spec = (F.col("in_frac") >= frac_in) & (F.col("ref_frac") <= frac_out)
    absent = (F.col("ref_frac") >= frac_in) & (F.col("in_frac") <= frac_out)
    both = F.array_compact(F.array(F.when(spec, "specific"), F.when(absent, "absent")))
    chosen = s.withColumn("direction", F.explode(both))
    return _tested(joint, chosen, inside, ref, ["direction"], tasks)


def rank_silencers(joint: DataFrame, inside: list[str], ref: list[str], presence: float = PRESENCE) -> DataFrame:
    """All informative silencers with test and FDR over them."""
    s = region_side_stats(joint, inside, ref, presence).where(F.col("region_class").endswith("silencer"))
    return _tested(joint, s.withColumn("direction", F.lit("silencer")), inside, ref, ["direction"])


def annotate_regions(regions: DataFrame, genes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Nearest genes, signed distances and the containing gene at the midpoint of each region.

    ``tasks`` is the number of tasks that regions are dealt over (Spark's own if None).
    """
    d = regions.withColumn("mid", F.expr("(r_start + r_end) div 2"))
    at = ["chrom", "mid"]
    mids = dealt(d.select(*at), tasks, *at).distinct()
    near, body = join_nearest_tss(mids, genes, tasks=tasks), join_gene_body(mids, genes, tasks=tasks)
    ann = dealt(near, tasks, *at).join(dealt(body, tasks, *at), at)
    return dealt(d, tasks, *at).join(ann, at)


def with_coord(regions: DataFrame) -> DataFrame:
    return regions.withColumn("coord", F.concat("chrom", F.lit(":"), "r_start", F.lit("-"), "r_end"))


# ---------------------------------------------------------------- target genes

def rna_candidates(annotated: DataFrame, max_tss: int = MAX_TSS) -> DataFrame:
    """Target gene of a region: the gene around it unless it has only an id, else a near protein-coding TSS."""
    named = F.col("within_gene").isNotNull() & (F.col("within_gene") != "") & ~F.col("within_gene").startswith("ENSG")
    near = F.abs("pc_dist_to_tss") <= max_tss
    gene = F.when(named, F.col("within_gene")).when(near, F.col("pc_nearest_gene"))
    return with_coord(annotated).withColumn("gene", gene).where("gene IS NOT NULL").select(
        "gene", "direction", "delta_pct", "coord")


def win_best_by_abs(candidates: DataFrame) -> DataFrame:
    """Strongest difference per gene and direction, then per gene; the first coordinate wins ties."""
    size = F.round(-F.abs("delta_pct"), 9)
    best = F.min_by(F.struct("direction", "delta_pct", "coord"), F.struct(size.alias("s"), "direction", "coord"))
    return candidates.groupBy("gene").agg(best.alias("b")).select(
        "gene", F.col("b.direction").alias("direction"), F.col("b.delta_pct").alias("delta_pct"),
        F.col("b.coord").alias("coord"))


def join_gene_symbol(named: DataFrame, gene_ids: DataFrame) -> DataFrame:
    """Gene symbol to its id without version; ``gene_ids`` has gene_name and gene_id."""
    ids = gene_ids.groupBy(F.col("gene_name").alias("gene")).agg(
        F.max(F.substring_index("gene_id", ".", 1)).alias("gene_id"))
    return named.join(ids, "gene")


def _target() -> Column:
    return F.coalesce(F.nullif("within_gene", F.lit("")), F.col("pc_nearest_gene"))


def rna_novel_targets(joint: DataFrame, genes: DataFrame, classes: list[str] | None = None, n: int = 45) -> DataFrame:
    """Novel regions with the largest presence in any subtype, one row per coordinate, with target gene."""
    nv = joint.where("basket = 'novel'")
    if classes:
        nv = nv.where(F.col("region_class").isin([f"novel|{c}" for c in classes]))
    m = nv.groupBy(*SPAN, F.regexp_replace("region_class", r"^novel\|", "").alias("region_class")).agg(
        F.max("pct").alias("max_pct"))
    one = m.groupBy(*SPAN).agg(F.max("max_pct").alias("max_pct"), F.min_by("region_class", F.struct(
        (-F.col("max_pct")).alias("x"), "region_class")).alias("region_class"))
    top = one.orderBy(F.desc("max_pct"), *SPAN).limit(n)
    return with_coord(annotate_regions(top, genes)).select(
        "coord", "region_class", "max_pct", _target().alias("target_gene"),
        F.when(F.col("within_gene").isNotNull(), 0).otherwise(F.col("pc_dist_to_tss")).alias("dist_to_tss"))


def rna_known_novel_stack(joint: DataFrame, genes: DataFrame, inside: list[str], ref: list[str], classes: list[str],
                          presence: float = PRESENCE, min_mean: float = 10.0, n: int = 40) -> DataFrame:
    """Top known regions by difference and top novel regions by presence, with target genes."""
    s = region_side_stats(joint, inside, ref, presence)
    cls = F.regexp_replace("region_class", r"^\w+\|", "")
    known = s.where((F.col("basket") == "known") & cls.isin(classes) & (F.col("in_mean") >= min_mean)).orderBy(
        F.desc(F.round("delta_pct", 9)), *SPAN, "region_class").limit(n)
    known = with_coord(annotate_regions(known, genes)).select(
        F.lit("known").alias("source"), "coord", cls.alias("region_class"), _target().alias("target_gene"))
    novel = rna_novel_targets(joint.where(F.col("subtype").isin(inside)), genes, classes, n).select(
        F.lit("novel").alias("source"), "coord", "region_class", "target_gene")
    return known.unionByName(novel)


# ---------------------------------------------------------------- expression

def agg_pseudobulk(rna: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean over the cells of a cluster of log1p(count / library * 10^4); cells without the gene count as zero.

    Only nonzero counts are read; the divisor comes from the cell table. An
    absent (cluster, gene) pair is zero.
    """
    lib = F.when(F.col("total_umis") == 0, 1).otherwise(F.col("total_umis"))
    size = checked_broadcast(cells.groupBy("cluster_id").agg(F.count("*").alias("n_cells")))
    x = rna.where("umi > 0").join(cells.select("cell_id", "cluster_id", lib.alias("lib")), ["cell_id", "cluster_id"])
    s = x.groupBy("cluster_id", "gene").agg(F.sum(F.log1p(F.col("umi") / F.col("lib") * SCALE)).alias("s"))
    return s.join(size, "cluster_id").select("cluster_id", "gene", (F.col("s") / F.col("n_cells")).alias("expr"), "n_cells")


def agg_dominant_dissection(cells: DataFrame) -> DataFrame:
    """Cells and most frequent dissection per cluster; the first name wins ties."""
    c = cells.groupBy("cluster_id", "dissection").agg(F.count("*").alias("n"))
    return c.groupBy("cluster_id").agg(F.sum("n").alias("n_cells"), F.min_by("dissection", F.struct(
        (-F.col("n")).alias("x"), "dissection")).alias("top_dissection"))


def marker_expr(expr: DataFrame, clusters: DataFrame, marker: str, name: str) -> DataFrame:
    m = expr.where(F.col("gene") == marker).select("cluster_id", F.col("expr").alias(name))
    return clusters.join(m, "cluster_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def rna_label_cluster(meta: DataFrame, expr: DataFrame, d1: str, d2: str, min_cells: int = 50) -> DataFrame:
    """Cluster labels: by the two markers in MSN clusters, by dissection words in MidbrDA clusters.

    ``meta`` has cluster_id, supercluster, top_dissection and n_cells. Small clusters are dropped. Where the table has no
    row of one of the markers at all, it was not measured, and MSN clusters are only "MSN".
    """
    measured = expr.where(F.col("gene").isin(d1, d2)).agg(F.count_distinct("gene").alias("n")).scalar()
    m = marker_expr(expr, marker_expr(expr, meta, d1, "_d1"), d2, "_d2")
    gap = F.col("_d1") - F.col("_d2")
    msn = F.when(measured < len({d1, d2}), "MSN").when(gap > MARKER_MARGIN, "D1-MSN").when(-gap > MARKER_MARGIN, "D2-MSN").otherwise("MSN-other/eccentric")
    low = F.lower("top_dissection")
    words = R.first_match([(low.contains(word), lab) for word, lab in DISSECTION_LABELS.items()], "Midbrain-DA")
    label = F.when(F.col("supercluster") == "MSN", msn).when(F.col("supercluster") == "MidbrDA", words).otherwise(
        F.col("supercluster"))
    return m.where(F.col("n_cells") >= min_cells).withColumn("label", label).drop("_d1", "_d2")


def rna_marker_split(expr: DataFrame, clusters: DataFrame, marker: str) -> DataFrame:
    """Clusters whose marker is at or above the median over clusters form the in-group."""
    m = marker_expr(expr, clusters.select("cluster_id"), marker, "marker")
    mid = F.percentile("marker", F.lit(0.5)).over(W.partitionBy(F.lit(0)))
    return m.select("cluster_id", "marker", mid.alias("median")).withColumn("ingroup", F.col("marker") >= F.col("median"))


def side_means(expr: DataFrame, clusters: DataFrame, inside: str = "ingroup") -> DataFrame:
    """Mean expression per gene over in-group and reference clusters, and their log2 ratio; absent pairs are zero."""
    c = checked_broadcast(clusters.select("cluster_id", F.col(inside).alias("_in")))
    n_in, n_all = c.where("_in").count(), c.count()
    s = expr.join(c, "cluster_id").groupBy("gene").agg(
        F.sum(F.when(F.col("_in"), F.col("expr")).otherwise(0.0)).alias("si"),
        F.sum(F.when(~F.col("_in"), F.col("expr")).otherwise(0.0)).alias("sr"))
    d = s.select("gene", (F.col("si") / max(n_in, 1)).alias("rna_in"), (F.col("sr") / max(n_all - n_in, 1)).alias("rna_ref"))
    return d.withColumn("rna_log2fc", log2_ratio(F.col("rna_in"), F.col("rna_ref"), PSEUDO_RNA))


def rna_concordance(candidates: DataFrame, means: DataFrame) -> DataFrame:
    """A gene agrees when RNA is up for a specific region, or not up for an absent one."""
    d = candidates.join(means, "gene")
    return d.withColumn("concordant", (F.col("direction") == "specific") == (F.col("rna_log2fc") > 0))


def rna_concordance_silencer(silencers: DataFrame, means: DataFrame) -> DataFrame:
    """A silencer agrees when its target is lower in the in-group; a target without RNA stays undecided."""
    d = silencers.join(means.withColumnRenamed("gene", "target_gene"), "target_gene", "left")
    return d.withColumn("concordant_repression", F.col("rna_log2fc") < 0)


def concordance_rate(tested: DataFrame, by: str, flag: str = "concordant") -> DataFrame:
    yes = F.coalesce(F.col(flag), F.lit(False))
    return tested.groupBy(by).agg(F.count("*").alias("n"), F.count_if(yes).alias("n_concordant"),
                                  (F.count_if(yes) / F.count("*")).alias("rate"))


def rna_d1_d2(expr: DataFrame, labelled: DataFrame, first: str, second: str) -> DataFrame:
    """Mean expression per gene in the clusters of two labels, and log2 ratio."""
    two = labelled.where(F.col("label").isin(first, second)).select(
        "cluster_id", (F.col("label") == first).alias("ingroup"))
    return side_means(expr, two).select("gene", F.col("rna_in").alias("mean_first"), F.col("rna_ref").alias("mean_second"),
                                        F.col("rna_log2fc").alias("log2fc"))


# ---------------------------------------------------------------- cell quality

QC_MEASURES = ["tsse", "uq", "log10_uq", "doublet", "tn", "um"]


def agg_celltype_qc(meta: DataFrame) -> DataFrame:
    """Per subtype: cells assigned, selected and analysed, medians of six measures, doublet share, most frequent class and subclass.

    ``meta`` has grp, subtype, cell_class, cell_subclass, analysed (bool), selected (bool) and the measures. The first
    name wins a tie of a class.
    """
    base = meta.groupBy("grp", "subtype").agg(
        F.count("*").alias("n_assigned"), F.count_if("selected").alias("n_selected"),
        F.count_if(F.col("selected") & F.col("analysed")).alias("n_analysed"),
        (F.count_if(F.col("selected") & (F.col("doublet") > 0.5)) * 100.0 / F.nullif(
            F.count_if("selected"), F.lit(0))).alias("doublet_pct"))
    doubles = meta.where("selected").select("grp", "subtype", *[F.col(c).cast("double").alias(c) for c in QC_MEASURES])
    long = doubles.unpivot(["grp", "subtype"], QC_MEASURES, "measure", "v")
    med = exact_quantiles(long, ["grp", "subtype", "measure"], "v", {"median": 0.5}).groupBy("grp", "subtype").agg(
        *[F.max(F.when(F.col("measure") == c, F.col("median"))).alias(f"{c}_median") for c in QC_MEASURES])
    names = meta.unpivot(["grp", "subtype"], ["cell_class", "cell_subclass"], "kind", "name")
    c = names.groupBy("grp", "subtype", "kind", "name").agg(F.count("*").alias("n"))
    most = lambda kind: F.min_by("name", F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("x"), "name"))).alias(kind)
    mode = c.groupBy("grp", "subtype").agg(most("cell_class"), most("cell_subclass"))
    return base.join(med, ["grp", "subtype"], "left").join(mode, ["grp", "subtype"])


def qc_group_totals(per_subtype: DataFrame) -> DataFrame:
    return per_subtype.groupBy("grp").agg(
        F.count_distinct("subtype").alias("n_subtypes"), F.sum("n_assigned").alias("n_assigned"),
        F.sum("n_selected").alias("n_selected"), F.sum("n_analysed").alias("n_analysed"),
        (F.sum("n_analysed") * 100.0 / F.nullif(F.sum("n_selected"), F.lit(0))).alias("pct_analysed"))
