"""Queries: region contrasts, target genes, RNA concordance and cell quality."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from regspan.operators import rna as N
from regspan.plans.joint_queries import Joint
from regspan.plans.presence_queries import rounded
from regspan.plans.registry import query
from regspan.plans.tf_queries import bh_sql, mwu_sql
from regspan.plans.views import add_views

# Contrast used by the stand-ins: two groups against three, with limits that fit their low presence.
PRES, F_IN, F_OUT = 3.0, 0.3, 0.2
N_IN, N_REF = 10, 15
IN_CLUSTERS = ["C0", "C1", "C2", "C3"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
RK = "chrom, r_start, r_end, basket, region_class"
TARGET_SQL = "COALESCE(within_gene, pc_nearest_gene)"


def _event_sql(gene: str) -> str:
    names = ", ".join(f"'{e}'" for e in EVENT_TYPES)
    return f"(ARRAY[{names}])[CAST(CAST(substr({gene}, 10) AS BIGINT) % 5 AS INT) + 1]"


def event_of(gene):
    """RNA stand-in: a gene is measured as one of the event types."""
    n = F.substring(gene, 10, 20).cast("bigint") % 5
    return F.element_at(F.array(*[F.lit(e) for e in EVENT_TYPES]), (n + 1).cast("int"))


def _dense_values(where: str) -> str:
    return f"""
SELECT c.{RK.replace(', ', ', c.')}, c.rid, s.subtype, substr(s.subtype, 1, 2) IN ('G0', 'G1') AS inside,
       COALESCE(j.pct, 0) AS v
FROM (SELECT DISTINCT {RK}, rid FROM {where}) c CROSS JOIN sizes_lab s
LEFT JOIN joint_lab j ON j.chrom = c.chrom AND j.r_start = c.r_start AND j.r_end = c.r_end AND j.basket = c.basket
 AND j.region_class = c.region_class AND j.subtype = s.subtype"""


add_views({
    "sides": f"""
SELECT {RK}, region_class || '|' || chrom || ':' || r_start || '-' || r_end AS rid, SUM(i * pct) / {N_IN} AS in_mean,
       SUM((1 - i) * pct) / {N_REF} AS ref_mean, SUM(i * CAST(pct >= {PRES} AS INT)) / {N_IN}::DOUBLE AS in_frac,
       SUM((1 - i) * CAST(pct >= {PRES} AS INT)) / {N_REF}::DOUBLE AS ref_frac,
       SUM(i * pct) / {N_IN} - SUM((1 - i) * pct) / {N_REF} AS delta_pct
FROM (SELECT *, CAST(substr(subtype, 1, 2) IN ('G0', 'G1') AS INT) AS i FROM joint_lab)
GROUP BY {RK} HAVING MAX(pct) >= {PRES}""",
    "chosen": f"""
SELECT *, 'specific' AS direction FROM sides WHERE in_frac >= {F_IN} AND ref_frac <= {F_OUT}
UNION ALL SELECT *, 'absent' FROM sides WHERE ref_frac >= {F_IN} AND in_frac <= {F_OUT}""",
    "chosen_values": _dense_values("chosen"),
    "chosen_p": mwu_sql("chosen_values", "rid", N_IN, N_REF),
    "contrast_rows": "SELECT c.*, p.mwu_p FROM chosen c JOIN chosen_p p ON p.rid = c.rid",
    "contrasted": bh_sql("contrast_rows", "mwu_p", "mwu_fdr", "direction"),
    "silencer_values": _dense_values("(SELECT * FROM sides WHERE ends_with(region_class, 'silencer'))"),
    "silencer_p": mwu_sql("silencer_values", "rid", N_IN, N_REF),
    "silencer_rows": "SELECT c.*, p.mwu_p FROM sides c JOIN silencer_p p ON p.rid = c.rid",
    "silencers_ranked": bh_sql("silencer_rows", "mwu_p", "mwu_fdr"),
    "mid_genes": """
SELECT p.chrom, p.mid, (SELECT gene_name FROM genes_tss g WHERE g.chrom = p.chrom AND gene_start <= mid AND gene_end >= mid
   ORDER BY gene_type <> 'protein_coding', tss, gene_name LIMIT 1) AS within_gene,
  (SELECT gene_name FROM genes_tss g WHERE g.chrom = p.chrom AND gene_type = 'protein_coding'
   ORDER BY abs(p.mid - tss), tss LIMIT 1) AS pc_nearest_gene,
  (SELECT p.mid - tss FROM genes_tss g WHERE g.chrom = p.chrom AND gene_type = 'protein_coding'
   ORDER BY abs(p.mid - tss), tss LIMIT 1) AS pc_dist
FROM (SELECT DISTINCT chrom, (r_start + r_end) // 2 AS mid FROM joint_lab) p""",
    "annotated": """
SELECT c.*, within_gene, pc_nearest_gene, pc_dist, c.chrom || ':' || r_start || '-' || r_end AS coord
FROM contrasted c JOIN mid_genes m ON m.chrom = c.chrom AND m.mid = (r_start + r_end) // 2""",
    "candidates": """
SELECT CASE WHEN within_gene IS NOT NULL THEN within_gene WHEN abs(pc_dist) <= 25000 THEN pc_nearest_gene END AS gene,
       direction, delta_pct, coord FROM annotated WHERE within_gene IS NOT NULL OR abs(pc_dist) <= 25000""",
    "best_candidates": """
SELECT gene, direction, delta_pct, coord FROM (SELECT *, row_number() OVER (
  PARTITION BY gene ORDER BY round(-abs(delta_pct), 9), direction, coord) AS rn FROM candidates) WHERE rn = 1""",
    "pseudobulk": """
SELECT r.cluster_id, gene, SUM(ln(1 + umi / CASE total_umis WHEN 0 THEN 1 ELSE total_umis END::DOUBLE * 1e4))
       / MAX(n_cells) AS expr, MAX(n_cells) AS n_cells
FROM rna r JOIN rna_cells c USING (cell_id, cluster_id)
JOIN (SELECT cluster_id, COUNT(*) AS n_cells FROM rna_cells GROUP BY 1) n ON n.cluster_id = r.cluster_id
WHERE umi > 0 GROUP BY 1, 2""",
    "clusters": """
SELECT cluster_id, CAST(SUM(n) AS BIGINT) AS n_cells, first(dissection ORDER BY n DESC, dissection) AS top_dissection
FROM (SELECT cluster_id, dissection, COUNT(*) AS n FROM rna_cells GROUP BY 1, 2) GROUP BY 1""",
})


def _in_list(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def means_sql(is_in: str) -> str:
    """Side means per gene with absent pairs as zero; ``is_in`` selects clusters from ``clusters k``."""
    return f"""
SELECT gene, a AS rna_in, b AS rna_ref, log2((a + 1e-3) / (b + 1e-3)) AS rna_log2fc FROM (
  SELECT g.gene, SUM(CASE WHEN {is_in} THEN COALESCE(expr, 0) ELSE 0 END) / SUM(CASE WHEN {is_in} THEN 1 ELSE 0 END) AS a,
         SUM(CASE WHEN {is_in} THEN 0 ELSE COALESCE(expr, 0) END) / SUM(CASE WHEN {is_in} THEN 0 ELSE 1 END) AS b
  FROM (SELECT DISTINCT gene FROM pseudobulk) g CROSS JOIN clusters k
  LEFT JOIN pseudobulk p ON p.gene = g.gene AND p.cluster_id = k.cluster_id GROUP BY 1)"""


MEANS_SQL = means_sql(f"k.cluster_id IN {_in_list(IN_CLUSTERS)}")


class Rna(Joint):
    """The joint table with every (group, subtype) on its own, its contrast and RNA."""

    def __init__(self, fx):
        super().__init__(fx, "lab")
        names = [r["subtype"] for r in self.sizes.select("subtype").collect()]
        self.inside = [s for s in names if s[:2] in ("G0", "G1")]
        self.ref = [s for s in names if s not in self.inside]

    @cached_property
    def contrasted(self):
        return N.test_mwu_contrast(self.joint, self.inside, self.ref, PRES, F_IN, F_OUT, self.fx.tasks)

    @cached_property
    def annotated(self):
        return N.annotate_regions(self.contrasted, self.fx.genes, self.fx.tasks)

    @cached_property
    def best(self):
        return N.win_best_by_abs(N.rna_candidates(self.annotated))


def _expr(fx):
    return N.agg_pseudobulk(fx.rna, fx.rna_cells)


def _clusters(fx):
    return N.agg_dominant_dissection(fx.rna_cells)


def _means(fx):
    c = _clusters(fx).withColumn("ingroup", F.col("cluster_id").isin(IN_CLUSTERS))
    return N.side_means(_expr(fx), c)


SIDE_NUM = ["in_mean", "ref_mean", "delta_pct", "in_frac", "ref_frac"]
R9 = lambda cols, places=9: ", ".join(f"round({c}, {places}) AS {c}" for c in cols)


@query("test_mwu_contrast", f"""
SELECT {RK}, direction, {R9(SIDE_NUM)}, {R9(['mwu_p', 'mwu_fdr'], 8)} FROM contrasted""")
def _(fx):
    return rounded(rounded(Rna(fx).contrasted, SIDE_NUM), ["mwu_p", "mwu_fdr"], 8)


@query("rank_silencers", f"SELECT {RK}, {R9(SIDE_NUM)}, {R9(['mwu_p', 'mwu_fdr'], 8)} FROM silencers_ranked")
def _(fx):
    r = Rna(fx)
    s = N.rank_silencers(r.joint, r.inside, r.ref, PRES).drop("direction")
    return rounded(rounded(s, SIDE_NUM), ["mwu_p", "mwu_fdr"], 8)


@query("annotate_regions", f"""
SELECT {RK}, direction, within_gene, pc_nearest_gene, pc_dist AS pc_dist_to_tss FROM annotated""")
def _(fx):
    return Rna(fx).annotated.select(*N.RKEY, "direction", "within_gene", "pc_nearest_gene", "pc_dist_to_tss")


@query("rna_candidates", "SELECT gene, direction, round(delta_pct, 9) AS delta_pct, coord FROM candidates")
def _(fx):
    return rounded(N.rna_candidates(Rna(fx).annotated), ["delta_pct"])


@query("win_best_by_abs", "SELECT gene, direction, round(delta_pct, 9) AS delta_pct, coord FROM best_candidates")
def _(fx):
    return rounded(Rna(fx).best, ["delta_pct"])


@query("join_gene_symbol", """
SELECT b.gene, coord, 'ENSG' || substr(gene, 10) AS gene_id FROM best_candidates b JOIN genes ON gene = gene_name""")
def _(fx):
    ids = fx.genes.select("gene_name", F.concat(F.lit("ENSG"), F.substring("gene_name", 10, 20), F.lit(".7")).alias("gene_id"))
    return N.join_gene_symbol(Rna(fx).best.select("gene", "coord"), ids)


@query("agg_pseudobulk", "SELECT cluster_id, gene, round(expr, 8) AS expr, n_cells FROM pseudobulk")
def _(fx):
    return rounded(_expr(fx), ["expr"], 8)


@query("agg_dominant_dissection", "SELECT cluster_id, n_cells, top_dissection FROM clusters")
def _(fx):
    return _clusters(fx)


@query("rna_concordance", f"""
WITH m AS ({MEANS_SQL})
SELECT b.gene, direction, coord, round(delta_pct, 9) AS delta_pct, {R9(['rna_in', 'rna_ref', 'rna_log2fc'], 7)},
       (direction = 'specific') = (rna_log2fc > 0) AS concordant
FROM best_candidates b JOIN m ON m.gene = {_event_sql('b.gene')}""")
def _(fx):
    best = Rna(fx).best.select(F.col("gene").alias("symbol"), event_of("gene").alias("gene"), "direction", "delta_pct", "coord")
    c = N.rna_concordance(best, _means(fx)).drop("gene").withColumnRenamed("symbol", "gene")
    return rounded(rounded(c, ["delta_pct"]), ["rna_in", "rna_ref", "rna_log2fc"], 7)


SIL_SQL = f"""
SELECT coord, {_event_sql('target')} AS target_gene, delta_pct, mwu_fdr FROM (
  SELECT s.chrom || ':' || r_start || '-' || r_end AS coord, delta_pct, mwu_fdr, {TARGET_SQL} AS target, row_number() OVER (
    ORDER BY round(delta_pct, 9) DESC, s.chrom, r_start, r_end, basket) AS rn
  FROM silencers_ranked s JOIN mid_genes m ON m.chrom = s.chrom AND m.mid = (r_start + r_end) // 2) WHERE rn <= 25"""


def _top_silencers(fx):
    r = Rna(fx)
    s = N.rank_silencers(r.joint, r.inside, r.ref, PRES)
    top = s.orderBy(F.desc(F.round("delta_pct", 9)), *N.SPAN, "basket").limit(25)
    t = N.with_coord(N.annotate_regions(top, fx.genes))
    target = F.coalesce("within_gene", "pc_nearest_gene")
    return t.select("coord", event_of(target).alias("target_gene"), "delta_pct", "mwu_fdr")


@query("rna_concordance_silencer", f"""
WITH m AS ({MEANS_SQL}), s AS ({SIL_SQL})
SELECT coord, target_gene, round(delta_pct, 9) AS delta_pct, round(mwu_fdr, 8) AS mwu_fdr,
       {R9(['rna_in', 'rna_ref', 'rna_log2fc'], 7)}, rna_log2fc < 0 AS concordant_repression
FROM s LEFT JOIN m ON m.gene = s.target_gene""")
def _(fx):
    c = N.rna_concordance_silencer(_top_silencers(fx), _means(fx))
    return rounded(rounded(rounded(c, ["delta_pct"]), ["mwu_fdr"], 8), ["rna_in", "rna_ref", "rna_log2fc"], 7)


NOVEL_SQL = f"""
SELECT t.chrom || ':' || r_start || '-' || r_end AS coord, region_class, max_pct, {TARGET_SQL} AS target_gene,
       CASE WHEN within_gene IS NOT NULL THEN 0 ELSE pc_dist END AS dist_to_tss
FROM (SELECT *, row_number() OVER (ORDER BY max_pct DESC, chrom, r_start, r_end) AS rn FROM (
        SELECT chrom, r_start, r_end, MAX(pct) AS max_pct, first(c ORDER BY pct DESC, c) AS region_class FROM (
          SELECT *, split_part(region_class, '|', 2) AS c FROM joint_lab WHERE basket = 'novel' AND %s)
        GROUP BY 1, 2, 3)) t
JOIN mid_genes m ON m.chrom = t.chrom AND m.mid = (r_start + r_end) // 2 WHERE rn <= %d"""


@query("rna_novel_targets", f"""
SELECT * REPLACE (round(max_pct, 9) AS max_pct) FROM ({NOVEL_SQL % ('TRUE', 45)})""")
def _(fx):
    return rounded(N.rna_novel_targets(Rna(fx).joint, fx.genes), ["max_pct"])


@query("rna_known_novel_stack", f"""
WITH m AS ({MEANS_SQL}),
k AS (SELECT 'known' AS source, s.chrom || ':' || r_start || '-' || r_end AS coord, split_part(region_class, '|', 2) AS
        region_class, {TARGET_SQL} AS target_gene, row_number() OVER (
        ORDER BY round(delta_pct, 9) DESC, s.chrom, r_start, r_end, region_class) AS rn
      FROM sides s JOIN mid_genes g ON g.chrom = s.chrom AND g.mid = (r_start + r_end) // 2
      WHERE basket = 'known' AND region_class IN ('known|enhancer', 'known|silencer') AND in_mean >= 2.0),
e AS (SELECT source, coord, region_class, target_gene FROM k WHERE rn <= 40 UNION ALL
      SELECT 'novel', coord, region_class, target_gene FROM ({NOVEL_SQL % (
          "c IN ('enhancer', 'silencer') AND substr(subtype, 1, 2) IN ('G0', 'G1')", 40)}))
SELECT source, COUNT(*) AS n, COUNT(*) FILTER (rna_log2fc > 0) AS n_concordant,
       round(COUNT(*) FILTER (rna_log2fc > 0) / COUNT(*)::DOUBLE, 9) AS rate
FROM e LEFT JOIN m ON m.gene = {_event_sql('e.target_gene')} GROUP BY 1""")
def _(fx):
    r = Rna(fx)
    e = N.rna_known_novel_stack(r.joint, fx.genes, r.inside, r.ref, ["enhancer", "silencer"], PRES, 2.0, 40)
    d = e.withColumn("gene", event_of("target_gene")).join(_means(fx), "gene", "left")
    return rounded(N.concordance_rate(d.withColumn("concordant", F.col("rna_log2fc") > 0), "source"), ["rate"])


LABEL_SQL = """
SELECT cluster_id, n_cells, top_dissection, CASE WHEN supercluster = 'MSN' THEN
    CASE WHEN d1 - d2 > 0.1 THEN 'D1-MSN' WHEN d2 - d1 > 0.1 THEN 'D2-MSN' ELSE 'MSN-other/eccentric' END
  WHEN supercluster = 'MidbrDA' THEN CASE WHEN lower(top_dissection) LIKE '%collicul%' THEN 'IC-DA'
    WHEN lower(top_dissection) LIKE '%septal%' THEN 'Septal-DA' WHEN lower(top_dissection) LIKE '%mediodorsal%' THEN 'MD-DA'
    WHEN lower(top_dissection) LIKE '%midbrain%' THEN 'Midbrain-DA' WHEN lower(top_dissection) LIKE '%substantia%' THEN 'SN-DA'
    WHEN lower(top_dissection) LIKE '%tegment%' THEN 'VTA/tegm-DA' ELSE 'Midbrain-DA' END
  ELSE supercluster END AS label
FROM (SELECT k.*, CASE WHEN k.cluster_id IN ('C0', 'C1', 'C2', 'C3', 'C4', 'C5') THEN 'MSN'
        WHEN k.cluster_id < 'C9' THEN 'MidbrDA' ELSE 'CGE' END AS supercluster, COALESCE(x.expr, 0) AS d1,
        COALESCE(y.expr, 0) AS d2
      FROM clusters k LEFT JOIN pseudobulk x ON x.cluster_id = k.cluster_id AND x.gene = 'click'
      LEFT JOIN pseudobulk y ON y.cluster_id = k.cluster_id AND y.gene = 'view') WHERE n_cells >= 2"""


def _labelled(fx):
    sc = F.when(F.col("cluster_id") < "C6", "MSN").when(F.col("cluster_id") < "C9", "MidbrDA").otherwise("CGE")
    return N.rna_label_cluster(_clusters(fx).withColumn("supercluster", sc), _expr(fx), "click", "view", 2).drop("supercluster")


@query("rna_label_cluster", LABEL_SQL)
def _(fx):
    return _labelled(fx)


@query("rna_marker_split", """
SELECT cluster_id, round(v, 8) AS marker, round(median(v) OVER (), 8) AS median, v >= median(v) OVER () AS ingroup
FROM (SELECT k.cluster_id, COALESCE(expr, 0) AS v FROM clusters k LEFT JOIN pseudobulk p
      ON p.cluster_id = k.cluster_id AND gene = 'purchase')""")
def _(fx):
    return rounded(N.rna_marker_split(_expr(fx), _clusters(fx), "purchase"), ["marker", "median"], 8)


@query("rna_d1_d2", f"""
WITH l AS ({LABEL_SQL}),
s AS (SELECT g.gene, SUM(COALESCE(expr, 0)) FILTER (label = 'D1-MSN') / COUNT(*) FILTER (label = 'D1-MSN') AS a,
        SUM(COALESCE(expr, 0)) FILTER (label = 'D2-MSN') / COUNT(*) FILTER (label = 'D2-MSN') AS b
      FROM (SELECT DISTINCT gene FROM pseudobulk) g CROSS JOIN l LEFT JOIN pseudobulk p
        ON p.gene = g.gene AND p.cluster_id = l.cluster_id WHERE label IN ('D1-MSN', 'D2-MSN') GROUP BY 1)
SELECT gene, round(COALESCE(a, 0), 7) AS mean_first, round(COALESCE(b, 0), 7) AS mean_second,
       round(log2((COALESCE(a, 0) + 1e-3) / (COALESCE(b, 0) + 1e-3)), 7) AS log2fc FROM s""")
def _(fx):
    return rounded(N.rna_d1_d2(_expr(fx), _labelled(fx), "D1-MSN", "D2-MSN"), ["mean_first", "mean_second", "log2fc"], 7)


QC_SQL = """
WITH m AS (SELECT k.grp, k.subtype, k.sample AS cell_class, c_custkey % 7 <> 0 AS selected, c_custkey % 5 <> 0 AS analysed,
                  c_mktsegment AS cell_subclass, c_acctbal AS tsse, 1000 + c_custkey * 37 % 5003 AS uq,
                  round(log10(1000 + c_custkey * 37 % 5003), 9) AS log10_uq, (c_custkey % 100) / 100.0::DOUBLE AS doublet,
                  c_custkey * 7 % 911 AS tn, c_custkey % 313 AS um
           FROM customer JOIN cells k ON k.cell_id = c_custkey),
md AS (SELECT grp, subtype, first(cell_class ORDER BY n DESC, cell_class) AS cell_class FROM (
         SELECT grp, subtype, cell_class, COUNT(*) AS n FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
ms AS (SELECT grp, subtype, first(cell_subclass ORDER BY n DESC, cell_subclass) AS cell_subclass FROM (
         SELECT grp, subtype, cell_subclass, COUNT(*) AS n FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
q AS (SELECT grp, subtype, COUNT(*) AS n_assigned, COUNT(*) FILTER (selected) AS n_selected,
             COUNT(*) FILTER (selected AND analysed) AS n_analysed,
             COUNT(*) FILTER (selected AND doublet > 0.5) * 100.0::DOUBLE / COUNT(*) FILTER (selected) AS doublet_pct,
             median(CAST(tsse AS DOUBLE)) FILTER (selected) AS tsse_median, median(uq) FILTER (selected) AS uq_median,
             median(log10_uq) FILTER (selected) AS log10_uq_median, median(doublet) FILTER (selected) AS doublet_median,
             median(tn) FILTER (selected) AS tn_median, median(um) FILTER (selected) AS um_median FROM m GROUP BY 1, 2)"""


def _qc(fx):
    c = fx.table("customer").select(
        F.col("c_custkey").alias("cell_id"), (F.col("c_custkey") % 7 != 0).alias("selected"),
        (F.col("c_custkey") % 5 != 0).alias("analysed"), F.col("c_acctbal").alias("tsse"),
        F.col("c_mktsegment").alias("cell_subclass"), (F.col("c_custkey") * 37 % 5003 + 1000).alias("uq"),
        F.round(F.log10(F.col("c_custkey") * 37 % 5003 + 1000), 9).alias("log10_uq"),
        ((F.col("c_custkey") % 100) / F.lit(100.0)).alias("doublet"), (F.col("c_custkey") * 7 % 911).alias("tn"),
        (F.col("c_custkey") % 313).alias("um"))
    return N.agg_celltype_qc(c.join(fx.cells.withColumnRenamed("sample", "cell_class"), "cell_id"))


@query("agg_celltype_qc", f"""{QC_SQL}
SELECT grp, subtype, n_assigned, n_selected, n_analysed, round(doublet_pct, 9) AS doublet_pct,
       {', '.join(f'round({c}_median, 9) AS {c}_median' for c in N.QC_MEASURES)}, cell_class, cell_subclass
FROM q JOIN md USING (grp, subtype) JOIN ms USING (grp, subtype)""")
def _(fx):
    return rounded(_qc(fx), ["doublet_pct", *[f"{c}_median" for c in N.QC_MEASURES]])


@query("qc_group_totals", f"""{QC_SQL}
SELECT grp, COUNT(DISTINCT subtype) AS n_subtypes, CAST(SUM(n_assigned) AS BIGINT) AS n_assigned,
       CAST(SUM(n_selected) AS BIGINT) AS n_selected, CAST(SUM(n_analysed) AS BIGINT) AS n_analysed,
       round(SUM(n_analysed) * 100.0::DOUBLE / SUM(n_selected), 9) AS pct_analysed FROM q GROUP BY 1""")
def _(fx):
    return rounded(N.qc_group_totals(_qc(fx)), ["pct_analysed"])
