"""Queries: novel loci, the joint known/novel tables and the cross-group comparison."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from regspan.operators import crossgroup as X, joint as J, pairwise as T, presence as P
from regspan.plans.presence_queries import Presence, _test_views, rounded, tested_sql
from regspan.plans.registry import query
from regspan.plans.views import add_views
from regspan.session import durable

KNOWN_CLASS = """CASE WHEN region_type LIKE '%enhancer%' THEN 'known|enhancer'
  WHEN region_type LIKE '%silencer%' THEN 'known|silencer' WHEN region_type LIKE '%promoter%' THEN 'known|promoter'
  WHEN region_type LIKE '%gene_body%' THEN 'known|gene_body' ELSE 'known|other_regulatory' END"""
LEAD = """CASE WHEN c_enh >= greatest(c_sil, c_dual, c_neither) THEN 'enhancer'
  WHEN c_sil >= greatest(c_dual, c_neither) THEN 'silencer' WHEN c_dual >= c_neither THEN 'enhancer_silencer'
  ELSE 'neither' END"""
NOVEL_CLASS = """CASE consensus_category WHEN 'enhancer' THEN 'novel|enhancer' WHEN 'silencer' THEN 'novel|silencer'
  WHEN 'enhancer_silencer' THEN 'novel|dual' ELSE 'novel|nonregulatory' END"""
TOP = X.TOP_PER_GROUP
LOW = {"_all": 10, "_grp": 2, "_lab": 2}


def _views(sfx: str, grp: str, sub: str = "subtype") -> dict[str, str]:
    novel = lambda how: f"""
SELECT p.grp, p.chrom, p.bin, subtype, cnt, pct, r_start, r_end, mean_p_enhancer, mean_p_silencer, mean_n_tfs,
       consensus_category, {NOVEL_CLASS} AS region_class
FROM (SELECT d.grp, chrom, bin, d.subtype, CAST({'MAX' if how == 'max' else 'SUM'}(d.n_cells) AS BIGINT) AS cnt,
             {'MAX(pct)' if how == 'max' else 'SUM(d.n_cells) * 100.0::DOUBLE / MAX(s.n_cells)'} AS pct
      FROM rebin{sfx} d JOIN sizes{sfx} s ON s.grp = d.grp AND s.subtype = d.subtype GROUP BY 1, 2, 3, 4) p
JOIN (SELECT *, {LEAD} AS consensus_category FROM (
      SELECT grp, chrom, bin, MIN(r_start) AS r_start, MAX(r_end) AS r_end,
             SUM(mean_p_enhancer * n_cells) / SUM(n_cells) AS mean_p_enhancer,
             SUM(mean_p_silencer * n_cells) / SUM(n_cells) AS mean_p_silencer,
             SUM(mean_n_tfs * n_cells) / SUM(n_cells) AS mean_n_tfs,
             SUM(CASE consensus_category WHEN 'enhancer' THEN n_cells ELSE 0 END) AS c_enh,
             SUM(CASE consensus_category WHEN 'silencer' THEN n_cells ELSE 0 END) AS c_sil,
             SUM(CASE consensus_category WHEN 'enhancer_silencer' THEN n_cells ELSE 0 END) AS c_dual,
             SUM(CASE consensus_category WHEN 'neither' THEN n_cells ELSE 0 END) AS c_neither
      FROM rebin{sfx} GROUP BY 1, 2, 3)) l ON l.grp = p.grp AND l.chrom = p.chrom AND l.bin = p.bin"""  # noqa: E731
    return {
        f"bins{sfx}": f"""
SELECT b.*, n_cells * 100.0::DOUBLE / n_all AS pct, {LEAD} AS consensus_category
FROM (SELECT {grp} AS grp, {sub} AS subtype, chrom, (peak_start + peak_end) // 2 // 1000 AS bin, MIN(peak_start) AS r_start,
             MAX(peak_end) AS r_end, COUNT(DISTINCT cell_id) AS n_cells,
             COUNT(*) FILTER (category = 'enhancer') AS c_enh, COUNT(*) FILTER (category = 'silencer') AS c_sil,
             COUNT(*) FILTER (category = 'enhancer_silencer') AS c_dual,
             COUNT(*) FILTER (category = 'neither') AS c_neither, AVG(p_enhancer) AS mean_p_enhancer,
             AVG(p_silencer) AS mean_p_silencer, AVG(n_tfs) AS mean_n_tfs
      FROM predictions GROUP BY 1, 2, 3, 4) b
JOIN (SELECT grp, subtype, n_cells AS n_all FROM sizes{sfx}) s ON s.grp = b.grp AND s.subtype = b.subtype""",
        f"rebin{sfx}": f"""
SELECT * REPLACE ((r_start + r_end) // 2 // 1000 AS bin) FROM bins{sfx} WHERE n_cells >= {LOW[sfx]}""",
        f"novel{sfx}": novel("max"),
        f"novelsum{sfx}": novel("sum"),
        f"joint{sfx}": f"""
SELECT grp, chrom, r_start, r_end, subtype, cnt, pct, 'known' AS basket, {KNOWN_CLASS} AS region_class FROM kept{sfx}
UNION ALL SELECT grp, chrom, r_start, r_end, subtype, cnt, pct, 'novel', region_class FROM novelsum{sfx}""",
        f"jmaster{sfx}": f"""
SELECT *, max_pct - min_pct AS diff_pct, log2((max_pct + 0.1) / (min_pct + 0.1)) AS log2fc,
       region_class || '|' || chrom || ':' || r_start || '-' || r_end AS region_id
FROM (SELECT c.grp, chrom, r_start, r_end, basket, region_class, MAX(pct) AS max_pct,
             CASE WHEN COUNT(*) < MAX(n_subtypes) THEN 0 ELSE MIN(pct) END AS min_pct,
             SUM(pct) / MAX(n_subtypes) AS mean_pct, first(c.subtype ORDER BY pct DESC, ord) AS max_subtype
      FROM joint{sfx} c JOIN sizes{sfx} s ON s.grp = c.grp AND s.subtype = c.subtype GROUP BY 1, 2, 3, 4, 5, 6)""",
        f"jtop{sfx}": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY diff_pct DESC, region_id) AS rank
               FROM jmaster{sfx}) WHERE rank <= {TOP}""",
        f"prof{sfx}": f"""
SELECT j.grp, j.subtype, j.grp || '__' || j.subtype AS member, region_id, j.pct
FROM joint{sfx} j JOIN jtop{sfx} t ON t.grp = j.grp AND t.chrom = j.chrom AND t.r_start = j.r_start
 AND t.r_end = j.r_end AND t.region_class = j.region_class WHERE j.pct > 0""",
    }


add_views(_views("_all", "'ALL'") | _views("_grp", "grp") | _views("_lab", "'ALL'", "grp || '__' || subtype"))
add_views({
    "novel_rows_all": """
SELECT r.grp, r.chrom, r.r_start, r.r_end, r.region_class, p.a, p.b, p.na, p.nb, COALESCE(u.cnt, 0) AS ca,
       COALESCE(v.cnt, 0) AS cb, COALESCE(u.cnt, 0) * 100.0::DOUBLE / p.na AS pct_a,
       COALESCE(v.cnt, 0) * 100.0::DOUBLE / p.nb AS pct_b
FROM (SELECT DISTINCT grp, chrom, bin, r_start, r_end, region_class FROM novelsum_all) r
JOIN pairs_all p ON p.grp = r.grp
LEFT JOIN novelsum_all u ON u.grp = r.grp AND u.chrom = r.chrom AND u.bin = r.bin AND u.subtype = p.a
LEFT JOIN novelsum_all v ON v.grp = r.grp AND v.chrom = r.chrom AND v.bin = r.bin AND v.subtype = p.b
WHERE COALESCE(u.cnt, 0) + COALESCE(v.cnt, 0) > 0""",
    "novel_tested_all": tested_sql(
        "novel_rows_all", "log2((greatest(pct_a, pct_b) + 0.1) / (least(pct_a, pct_b) + 0.1))", "abs(pct_a - pct_b)"),
})


class Joint(Presence):
    """Known counts, novel loci and their stack for one fixture."""

    def __init__(self, fx, view: str = "all"):
        super().__init__(fx, view)
        self.min_cells = LOW[f"_{view}"]

    @cached_property
    def predictions(self):
        return self.pick(self.fx.predictions)

    @cached_property
    def loci(self):
        return J.agg_bin_consensus(self.predictions, self.sizes, tasks=self.fx.tasks)

    def novel(self, how="sum"):
        return J.agg_novel_merge(self.loci, self.sizes, how, self.min_cells, tasks=self.fx.tasks)

    @cached_property
    def joint(self):
        return durable(J.join_known_novel(self.kept, self.novel()))

    @cached_property
    def master(self):
        return durable(J.joint_master(self.joint, self.sizes, self.fx.tasks))

    @cached_property
    def top(self):
        return X.fingerprint(self.master, TOP)

    @cached_property
    def prof(self):
        return X.profiles(self.joint, self.top)

    @cached_property
    def members(self):
        return self.sizes.select("grp", "subtype", "n_cells", X.label().alias("member"))


MEANS = ["mean_p_enhancer", "mean_p_silencer", "mean_n_tfs"]
R9 = lambda cols: ", ".join(f"round({c}, 9) AS {c}" for c in cols)


@query("agg_bin_consensus", f"""
SELECT grp, subtype, chrom, bin, r_start, r_end, n_cells, c_enh, c_sil, c_dual, c_neither, consensus_category,
       {R9(['pct', *MEANS])} FROM bins_all""")
def _(fx):
    return rounded(Joint(fx).loci, ["pct", *MEANS])


@query("agg_novel_merge", f"""
SELECT grp, chrom, bin, r_start, r_end, subtype, cnt, consensus_category, region_class, {R9(['pct', *MEANS])}
FROM novel_all""")
def _(fx):
    return rounded(Joint(fx).novel("max"), ["pct", *MEANS])


@query("agg_novel_merge_sum", f"""
SELECT grp, chrom, bin, r_start, r_end, subtype, cnt, consensus_category, region_class, {R9(['pct', *MEANS])}
FROM novelsum_all""")
def _(fx):
    return rounded(Joint(fx).novel("sum"), ["pct", *MEANS])


@query("join_known_novel", """
SELECT grp, chrom, r_start, r_end, subtype, cnt, round(pct, 9) AS pct, basket, region_class FROM joint_all""")
def _(fx):
    return rounded(Joint(fx).joint.drop(*MEANS), ["pct"])


JM_NUM = ["max_pct", "min_pct", "mean_pct", "diff_pct", "log2fc"]


@query("joint_master", f"""
SELECT grp, chrom, r_start, r_end, basket, region_class, max_subtype, region_id, {R9(JM_NUM)} FROM jmaster_all""")
def _(fx):
    return rounded(Joint(fx).master, JM_NUM)


@query("agg_composition", """
SELECT grp, basket, region_class, COUNT(*) AS n_regions,
       round(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY grp), 9) AS pct_of_group
FROM jmaster_grp GROUP BY 1, 2, 3""")
def _(fx):
    return rounded(J.agg_composition(Joint(fx, "grp").master), ["pct_of_group"])


@query("agg_rediscovery", """
SELECT n.grp, COUNT(*) AS n_novel_regulatory, COUNT(*) FILTER (hit) AS n_overlapping_known,
       round(COUNT(*) FILTER (hit) * 100.0::DOUBLE / COUNT(*), 9) AS pct_rediscovered
FROM (SELECT n.*, EXISTS (SELECT 1 FROM jmaster_grp k WHERE k.basket = 'known' AND k.grp = n.grp AND k.chrom = n.chrom
              AND k.r_start <= n.r_end AND k.r_end > n.r_start) AS hit
      FROM jmaster_grp n WHERE basket = 'novel' AND region_class <> 'novel|nonregulatory') n
WHERE n.grp IN (SELECT grp FROM jmaster_grp WHERE basket = 'known') GROUP BY 1""")
def _(fx):
    return rounded(J.agg_rediscovery(Joint(fx, "grp").master, fx.tasks), ["pct_rediscovered"])


@query("win_topn_novel", """
SELECT grp, region_id, round(diff_pct, 9) AS diff_pct, max_subtype, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY diff_pct DESC, region_id) AS rank FROM jmaster_grp
  WHERE basket = 'novel' AND region_class <> 'novel|nonregulatory') WHERE rank <= 15""")
def _(fx):
    m = Joint(fx, "grp").master
    novel = m.where(F.col("region_class").isin(J.REGULATORY))
    return rounded(P.win_topn_per_group(novel, ["grp"], "diff_pct", 15, ["region_id"]).select(
        "grp", "region_id", "diff_pct", "max_subtype", "rank"), ["diff_pct"])


NOVEL_TEST = ["grp", "chrom", "r_start", "r_end", "region_class", "a", "b", "ca", "cb", "na", "nb"]


@query("test_fisher_novel", f"""
SELECT {', '.join(NOVEL_TEST)}, {R9(['pct_a', 'pct_b', 'diff_pct', 'log2fc'])}, round(p_value, 8) AS p_value,
       round(fdr, 8) AS fdr, CASE WHEN pct_a >= pct_b THEN 'up_in_' || a ELSE 'up_in_' || b END AS direction
FROM novel_tested_all""")
def _(fx):
    j = Joint(fx)
    t = J.test_fisher_novel(durable(j.novel()), j.sizes).drop("sig_005", "sig_001", "sig_0001")
    return rounded(rounded(t, ["pct_a", "pct_b", "diff_pct", "log2fc"]), ["p_value", "fdr"], 8)


@query("agg_pair_summary_joint", """
SELECT grp, a, b, COUNT(*) AS total_regions, COUNT(*) FILTER (fdr < 0.05) AS sig_005,
       COUNT(*) FILTER (fdr < 0.05 AND basket = 'known') AS sig_005_known,
       COUNT(*) FILTER (fdr < 0.05 AND basket = 'novel') AS sig_005_novel
FROM (SELECT grp, a, b, fdr, 'known' AS basket FROM tested_all
      UNION ALL SELECT grp, a, b, fdr, 'novel' FROM novel_tested_all) GROUP BY 1, 2, 3""")
def _(fx):
    j = Joint(fx)
    cols = [*T.PAIR, "na", "nb", "fdr", "log2fc", "m"]
    known = j.tables.select(*cols, F.lit("known").alias("basket"))
    novel = J.fisher_novel_tables(durable(j.novel()), j.sizes).select(*cols, F.lit("novel").alias("basket"))
    return T.agg_pair_summary(known.unionByName(novel), ["known", "novel"]).select(
        *T.PAIR, "total_regions", "sig_005", "sig_005_known", "sig_005_novel")


@query("join_bin_class", """
WITH rb AS (SELECT grp, chrom, unnest(range(r_start // 1000, r_end // 1000 + 1)) AS bin, basket FROM jmaster_grp),
k AS (SELECT grp, chrom, bin, MIN(basket) AS basket FROM rb GROUP BY 1, 2, 3)
SELECT p.grp, p.subtype, p.cell_id, p.chrom, p.peak_start, p.peak_end, p.category, k.basket
FROM predictions p JOIN k ON k.grp = p.grp AND k.chrom = p.chrom AND k.bin = (peak_start + peak_end) // 2 // 1000
WHERE category <> 'neither'""")
def _(fx):
    j = Joint(fx, "grp")
    return J.join_bin_class(j.predictions, j.master, tasks=fx.tasks).select(
        "grp", "subtype", "cell_id", "chrom", "peak_start", "peak_end", "category", "basket")


@query("percell_novel_burden", """
WITH rb AS (SELECT grp, chrom, unnest(range(r_start // 1000, r_end // 1000 + 1)) AS bin, basket FROM jmaster_grp),
k AS (SELECT grp, chrom, bin, MIN(basket) AS basket FROM rb GROUP BY 1, 2, 3)
SELECT p.grp, p.subtype, p.cell_id, COUNT(*) AS n_reg_peaks,
       round(COUNT(*) FILTER (basket = 'novel') * 100.0::DOUBLE / COUNT(*), 9) AS novel_pct
FROM predictions p JOIN k ON k.grp = p.grp AND k.chrom = p.chrom AND k.bin = (peak_start + peak_end) // 2 // 1000
WHERE category <> 'neither' GROUP BY 1, 2, 3 HAVING COUNT(*) >= 5""")
def _(fx):
    j = Joint(fx, "grp")
    return rounded(J.percell_novel_burden(J.join_bin_class(j.predictions, j.master, tasks=fx.tasks)), ["novel_pct"])


ROLL = "total_peaks, c_enh, c_sil, c_dual, c_neither"


@query("agg_category_rollup", """
WITH d AS (SELECT c.grp, c.subtype, COUNT(DISTINCT c.cell_id) AS n_cells FROM cells c GROUP BY 1, 2),
k AS (SELECT grp, subtype, COUNT(*) AS total_peaks, COUNT(*) FILTER (category = 'enhancer') AS c_enh,
      COUNT(*) FILTER (category = 'silencer') AS c_sil, COUNT(*) FILTER (category = 'enhancer_silencer') AS c_dual,
      COUNT(*) FILTER (category = 'neither') AS c_neither FROM predictions GROUP BY 1, 2),
r AS (SELECT grp, subtype, CAST(SUM(n_cells) AS BIGINT) AS n_cells, CAST(SUM(total_peaks) AS BIGINT) AS total_peaks,
      CAST(SUM(c_enh) AS BIGINT) AS c_enh, CAST(SUM(c_sil) AS BIGINT) AS c_sil, CAST(SUM(c_dual) AS BIGINT) AS c_dual,
      CAST(SUM(c_neither) AS BIGINT) AS c_neither, COUNT(*) AS n_subtypes,
      CAST(grouping_id(grp, subtype) AS INT) AS level
      FROM d LEFT JOIN k USING (grp, subtype) GROUP BY ROLLUP (grp, subtype))
SELECT *, round(c_enh * 100.0::DOUBLE / total_peaks, 9) AS pct_enh, round(c_sil * 100.0::DOUBLE / total_peaks, 9) AS pct_sil,
       round(c_dual * 100.0::DOUBLE / total_peaks, 9) AS pct_both FROM r""")
def _(fx):
    return rounded(J.agg_category_rollup(fx.predictions, fx.cells), ["pct_enh", "pct_sil", "pct_both"])


@query("agg_per_sample_fraction", """
SELECT sample, category, COUNT(*) AS n, round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY sample)::DOUBLE, 9) AS fraction
FROM predictions GROUP BY 1, 2""")
def _(fx):
    return rounded(J.agg_per_sample_fraction(fx.predictions), ["fraction"])


@query("agg_ntfs_quartiles", """
SELECT category, COUNT(*) AS n, quantile_cont(n_tfs, 0.25) AS q1, quantile_cont(n_tfs, 0.5) AS q2,
       quantile_cont(n_tfs, 0.75) AS q3 FROM predictions GROUP BY 1""")
def _(fx):
    return J.agg_ntfs_quartiles(fx.predictions)


# ---------------------------------------------------------------- cross-group

def spearman_sql(values: str, members: str, n_all: str) -> str:
    """Dense form: zero-filled matrix, average ranks, corr."""
    return f"""
SELECT x.member AS a, y.member AS b, 1 - corr(x.r, y.r) AS divergence FROM ranked x JOIN ranked y
  ON x.region_id = y.region_id AND x.member < y.member GROUP BY 1, 2""", f"""
ranked AS (SELECT member, region_id, rank() OVER (PARTITION BY member ORDER BY pct)
           + (COUNT(*) OVER (PARTITION BY member, pct) - 1) / 2.0::DOUBLE AS r
  FROM (SELECT m.member, e.region_id, COALESCE(v.pct, 0) AS pct
        FROM {members} m CROSS JOIN {n_all} e LEFT JOIN {values} v ON v.member = m.member AND v.region_id = e.region_id))"""


_SEL, _RANKED = spearman_sql("prof_grp", "(SELECT DISTINCT grp || '__' || subtype AS member FROM sizes_grp)",
                             "(SELECT DISTINCT region_id FROM jtop_grp)")


@query("div_spearman", f"WITH {_RANKED.strip()} SELECT a, b, round(divergence, 8) AS divergence FROM ({_SEL})")
def _(fx):
    j = Joint(fx, "grp")
    return rounded(X.div_spearman(j.prof, j.members, X.count_elements(j.top)), ["divergence"], 8)


@query("div_spearman_by_basket", """
WITH v AS (SELECT basket, subtype AS member, chrom || ':' || r_start || '-' || r_end || region_class AS region_id, pct
           FROM joint_all),
g AS (SELECT DISTINCT basket, region_id FROM v),
f AS (SELECT s.subtype AS member, g.basket, g.region_id, COALESCE(v.pct, 0) AS pct FROM sizes_all s CROSS JOIN g
      LEFT JOIN v ON v.member = s.subtype AND v.region_id = g.region_id AND v.basket = g.basket),
ranked AS (SELECT *, rank() OVER (PARTITION BY basket, member ORDER BY pct)
           + (COUNT(*) OVER (PARTITION BY basket, member, pct) - 1) / 2.0::DOUBLE AS r FROM f)
SELECT x.basket, x.member AS a, y.member AS b, round(1 - corr(x.r, y.r), 8) AS divergence
FROM ranked x JOIN ranked y ON x.basket = y.basket AND x.region_id = y.region_id AND x.member < y.member
GROUP BY 1, 2, 3""")
def _(fx):
    j = Joint(fx)
    v = j.joint.where("pct > 0").select(
        "basket", F.col("subtype").alias("member"), "pct",
        F.concat("chrom", F.lit(":"), "r_start", F.lit("-"), "r_end", "region_class").alias("region_id"))
    members = j.sizes.select(F.col("subtype").alias("member"))
    parts = [X.div_spearman(v.where(F.col("basket") == b), members, X.count_elements(v.where(F.col("basket") == b)))
             .select(F.lit(b).alias("basket"), "a", "b", F.round("divergence", 8).alias("divergence"))
             for b in ("known", "novel")]
    return parts[0].union(parts[1])


@query("div_intra_inter", f"""
WITH {_RANKED.strip()}, d AS ({_SEL})
SELECT split_part(a, '__', 1) = split_part(b, '__', 1) AS same_group, COUNT(*) AS n_pairs,
       round(AVG(divergence), 8) AS mean_divergence FROM d GROUP BY 1""")
def _(fx):
    j = Joint(fx, "grp")
    d = X.div_intra_inter(X.div_spearman(j.prof, j.members, X.count_elements(j.top)), j.members)
    return d.groupBy((F.col("pair_type") == "intra").alias("same_group")).agg(
        F.count("*").alias("n_pairs"), F.round(F.avg("divergence"), 8).alias("mean_divergence"))


@query("reduce_pca")
def _(fx):
    j = Joint(fx, "grp")
    return X.reduce_pca(j.prof, j.members).join(j.members.select("member", "grp"), "member")


def _all_components(fx):
    j = Joint(fx, "grp")
    return X.reduce_pca(j.prof, j.members, j.members.count())


@query("reduce_pca_distances", """
WITH m AS (SELECT DISTINCT grp || '__' || subtype AS member FROM sizes_grp),
own AS (SELECT m.member, COALESCE(SUM(pct * pct), 0) AS s FROM m LEFT JOIN prof_grp p ON p.member = m.member GROUP BY 1),
met AS (SELECT x.member AS a, y.member AS b, SUM(x.pct * y.pct) AS s FROM prof_grp x JOIN prof_grp y USING (region_id) GROUP BY 1, 2)
SELECT x.member AS a, y.member AS b, round(x.s + y.s - 2 * COALESCE(met.s, 0), 4) + 0.0 AS distance2
FROM own x JOIN own y ON x.member < y.member LEFT JOIN met ON met.a = x.member AND met.b = y.member""")
def _(fx):
    return rounded(X.pca_distances(_all_components(fx)), ["distance2"], 4).withColumn("distance2", F.col("distance2") + 0.0)


@query("reduce_pca_variance", """
WITH m AS (SELECT COUNT(*) AS k FROM sizes_grp),
region AS (SELECT region_id, SUM(pct) AS s, SUM(pct * pct) AS q FROM prof_grp GROUP BY 1)
SELECT round(SUM(q - s * s / k), 4) AS total FROM region, m""")
def _(fx):
    return X.pca_variance(_all_components(fx)).agg(F.round(F.sum("total"), 4).alias("total"))


@query("comp_class_pct", """
SELECT s.grp, s.subtype, region_class, n, round(pct, 9) AS pct FROM sizes_grp s JOIN (
  SELECT grp, region_class, COUNT(*) AS n, COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY grp) AS pct
  FROM jmaster_grp GROUP BY 1, 2) USING (grp)""")
def _(fx):
    j = Joint(fx, "grp")
    return rounded(X.comp_class_pct(j.master, j.sizes), ["pct"])


_SIX = "('enhancer', 'silencer', 'promoter', 'uncharacterized', 'insulator', 'other_regulatory')"


def _active_sql() -> str:
    from regspan.plans.presence_queries import SIMPLE

    return f"""
SELECT grp, subtype, region_class, COUNT(*) AS n, COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (
  PARTITION BY grp, subtype) AS pct FROM (SELECT *, {SIMPLE} AS region_class FROM kept_grp)
WHERE region_class IN {_SIX} GROUP BY 1, 2, 3"""


@query("comp_active_classes", f"SELECT * REPLACE (round(pct, 9) AS pct) FROM ({_active_sql()})")
def _(fx):
    return rounded(X.comp_active_classes(Presence(fx, "grp").kept), ["pct"])


@query("div_shannon", """
WITH c AS (SELECT grp, region_class, COUNT(*) AS n, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY grp) AS p
           FROM jmaster_grp GROUP BY 1, 2)
SELECT s.grp, s.subtype, round(-SUM(p * ln(p)), 8) AS shannon, CAST(SUM(n) AS BIGINT) AS n_regions
FROM sizes_grp s JOIN c USING (grp) GROUP BY 1, 2""")
def _(fx):
    j = Joint(fx, "grp")
    return rounded(X.div_shannon(X.comp_class_pct(j.master, j.sizes)), ["shannon"], 8)


@query("div_shannon_active", f"""
SELECT grp, subtype, round(-SUM(pct / 100 * log2(pct / 100)), 8) AS shannon, CAST(SUM(n) AS BIGINT) AS n_regions
FROM ({_active_sql()}) GROUP BY 1, 2""")
def _(fx):
    return rounded(X.div_shannon(X.comp_active_classes(Presence(fx, "grp").kept), 2.0), ["shannon"], 8)


@query("complexity_index", f"""
WITH e AS (SELECT grp, subtype, -SUM(pct / 100 * log2(pct / 100)) AS shannon, CAST(SUM(n) AS BIGINT) AS n
           FROM ({_active_sql()}) GROUP BY 1, 2),
m AS (SELECT s.grp, s.subtype, COALESCE(p.pct, 0) AS pct FROM sizes_grp s JOIN jtop_grp t ON t.grp = s.grp
      LEFT JOIN prof_grp p ON p.grp = s.grp AND p.subtype = s.subtype AND p.region_id = t.region_id)
SELECT s.grp, s.subtype, s.n_cells, COALESCE(e.n, 0) AS total_active_regions, round(COALESCE(shannon, 0), 8) AS shannon,
       round(AVG(pct), 8) AS mean_presence_pct, round(median(pct), 8) AS median_presence_pct,
       CAST(COUNT(*) FILTER (pct > 10) AS BIGINT) AS regions_gt10pct
FROM sizes_grp s JOIN m ON m.grp = s.grp AND m.subtype = s.subtype
LEFT JOIN e ON e.grp = s.grp AND e.subtype = s.subtype GROUP BY 1, 2, 3, 4, 5""")
def _(fx):
    j = Joint(fx, "grp")
    c = X.complexity_index(j.kept, j.prof, j.top, j.sizes)
    return rounded(c, ["shannon", "mean_presence_pct", "median_presence_pct"], 8)


def _conserved_sql(case: str) -> str:
    return f"""
WITH b AS (SELECT t.region_id, COUNT(DISTINCT p.member) AS n FROM (SELECT DISTINCT region_id FROM jtop_grp) t
           LEFT JOIN prof_grp p ON p.region_id = t.region_id AND p.pct > 5 GROUP BY 1),
k AS (SELECT COUNT(*) AS k FROM sizes_grp)
SELECT {case} AS category, COUNT(*) AS n_regions FROM b, k GROUP BY 1"""


@query("conserved_classes", _conserved_sql(
    "CASE WHEN n > 0.8 * k THEN 'universal' WHEN n < 0.2 * k THEN 'specific' ELSE 'shared' END"))
def _(fx):
    j = Joint(fx, "grp")
    return X.conserved_classes(j.prof, j.top, j.members.count())


@query("conserved_classes_whole", _conserved_sql(
    "CASE WHEN n >= floor(0.8 * k) THEN 'universal' WHEN n < floor(0.2 * k) THEN 'specific' ELSE 'shared' END"))
def _(fx):
    j = Joint(fx, "grp")
    return X.conserved_classes(j.prof, j.top, j.members.count(), whole_bounds=True)


@query("novel_fraction", """
SELECT grp, round(COUNT(*) FILTER (basket = 'novel') / COUNT(*)::DOUBLE, 9) AS novel_fraction FROM jtop_grp GROUP BY 1""")
def _(fx):
    return rounded(X.novel_fraction(Joint(fx, "grp").top), ["novel_fraction"])


@query("fingerprint_composition", "SELECT grp, region_class, COUNT(*) AS n_regions FROM jtop_grp GROUP BY 1, 2")
def _(fx):
    return X.fingerprint_composition(Joint(fx, "grp").top)


@query("win_cumulative_novel", """
SELECT grp, CAST(rank AS INT) AS rank, round(SUM(CASE basket WHEN 'novel' THEN 1.0::DOUBLE ELSE 0 END) OVER (
  PARTITION BY grp ORDER BY rank) * 100 / rank, 9) AS cumulative_novel_pct
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY diff_pct DESC, region_id) AS rank FROM jmaster_grp)
WHERE rank <= 2000""")
def _(fx):
    return rounded(X.win_cumulative_novel(Joint(fx, "grp").master), ["cumulative_novel_pct"])


# ---------------------------------------------------------------- regions that tell deep cells from shallow ones

DEEP, WIDE = 60, 10_000
add_views({
    "cells_dep": f"""
SELECT k.grp, k.cell_id, CASE WHEN COALESCE(n, 0) >= {DEEP} THEN 'deep' ELSE 'shallow' END AS subtype
FROM cells k LEFT JOIN (SELECT cell_id, COUNT(*) AS n FROM footprints GROUP BY 1) f ON f.cell_id = k.cell_id""",
    "sizes_dep": """
SELECT *, row_number() OVER (PARTITION BY grp ORDER BY subtype) AS ord, COUNT(*) OVER (PARTITION BY grp) AS n_subtypes
FROM (SELECT grp, subtype, COUNT(*) AS n_cells FROM cells_dep GROUP BY 1, 2)""",
    "kept_dep": f"""
SELECT d.grp, d.subtype, chrom, peak_start // {WIDE} * {WIDE} AS r_start, peak_start // {WIDE} * {WIDE} + {WIDE} AS r_end,
       'stretch' AS region_type, COUNT(DISTINCT f.cell_id) AS cnt
FROM footprints f JOIN cells_dep d ON d.cell_id = f.cell_id GROUP BY 1, 2, 3, 4, 5, 6"""} | _test_views("_dep", "kept_dep"))


class Depth:
    """Cells with many footprints against cells with few, on wide stretches: presence that does differ."""

    def __init__(self, fx):
        n = fx.footprints.groupBy("cell_id").agg(F.count("*").alias("n"))
        deep = F.when(F.coalesce("n", F.lit(0)) >= DEEP, "deep").otherwise("shallow")
        cells = fx.cells.join(n, "cell_id", "left").select("grp", deep.alias("subtype"), "cell_id")
        at = F.expr(f"peak_start div {WIDE} * {WIDE}")
        rows = fx.footprints.select("cell_id", "chrom", at.alias("r_start"), (at + WIDE).alias("r_end"), F.lit("stretch").alias("tag")).join(cells, "cell_id")
        self.sizes = P.group_sizes(cells)
        self.counts = durable(P.agg_presence_counts(rows, self.sizes))
        self.tables = T.fisher_pair_tables(self.counts, self.sizes)

    def union(self):
        return T.sig_region_union(self.counts, self.tables, 0.05)


@query("sig_region_union", "SELECT DISTINCT grp, chrom, r_start, r_end FROM tested_dep WHERE fdr < 0.05")
def _(fx):
    return Depth(fx).union()


@query("set_concordance", """
WITH s AS (SELECT DISTINCT grp, chrom, r_start, r_end FROM tested_dep WHERE fdr < 0.05)
SELECT x.grp AS a, y.grp AS b, COUNT(*) AS n_shared FROM s x JOIN s y USING (chrom, r_start, r_end) GROUP BY 1, 2""")
def _(fx):
    return X.set_concordance(Depth(fx).union())
