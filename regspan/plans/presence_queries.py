"""Queries: presence counts, percent metrics, pairwise exact tests."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from regspan.functions.coords import coord
from regspan.operators import pairwise as T, presence as P
from regspan.plans.registry import query
from regspan.plans.views import add_views
from regspan.session import durable

SIMPLE = """CASE WHEN region_type LIKE '%uncharacterized%' THEN 'uncharacterized'
  WHEN region_type LIKE '%insulator%' OR region_type LIKE '%enhancer_blocking%' THEN 'insulator'
  WHEN region_type LIKE '%enhancer%' THEN 'enhancer' WHEN region_type LIKE '%silencer%' THEN 'silencer'
  WHEN region_type LIKE '%promoter%' THEN 'promoter' WHEN region_type LIKE '%gene_body%' THEN 'gene_body'
  ELSE 'other_regulatory' END"""


def _presence_views(suffix: str, grp: str, sub: str = "subtype") -> dict[str, str]:
    return {
        f"sizes{suffix}": f"""
SELECT *, row_number() OVER (PARTITION BY grp ORDER BY subtype) AS ord, COUNT(*) OVER (PARTITION BY grp) AS n_subtypes
FROM (SELECT {grp} AS grp, {sub} AS subtype, COUNT(*) AS n_cells FROM cells GROUP BY 1, 2)""",
        f"presence{suffix}": f"""
SELECT c.grp, c.subtype, chrom, r_start, r_end, cnt, CAST(SUM(cnt) OVER (
         PARTITION BY c.grp, chrom, r_start, r_end) AS BIGINT) AS global_count, region_type, n_cells,
       cnt * 100.0::DOUBLE / n_cells AS pct
FROM (SELECT {grp} AS grp, {sub} AS subtype, chrom, r_start, r_end, COUNT(DISTINCT cell_id) AS cnt FROM source_tags
      GROUP BY 1, 2, 3, 4, 5) c
JOIN region_types USING (chrom, r_start, r_end) JOIN sizes{suffix} s ON s.grp = c.grp AND s.subtype = c.subtype""",
    }


def _test_views(suffix: str, counts: str) -> dict[str, str]:
    return {
        f"pairs{suffix}": f"""
SELECT x.grp, x.subtype AS a, y.subtype AS b, x.n_cells AS na, y.n_cells AS nb
FROM sizes{suffix} x JOIN sizes{suffix} y ON x.grp = y.grp AND x.ord < y.ord""",
        f"pair_rows{suffix}": f"""
SELECT r.grp, r.chrom, r.r_start, r.r_end, r.region_type, p.a, p.b, p.na, p.nb, COALESCE(u.cnt, 0) AS ca,
       COALESCE(v.cnt, 0) AS cb, COALESCE(u.cnt, 0) * 100.0::DOUBLE / p.na AS pct_a,
       COALESCE(v.cnt, 0) * 100.0::DOUBLE / p.nb AS pct_b
FROM (SELECT DISTINCT grp, chrom, r_start, r_end, region_type FROM {counts}) r JOIN pairs{suffix} p ON p.grp = r.grp
LEFT JOIN {counts} u ON u.grp = r.grp AND u.chrom = r.chrom AND u.r_start = r.r_start AND u.r_end = r.r_end
      AND u.subtype = p.a
LEFT JOIN {counts} v ON v.grp = r.grp AND v.chrom = r.chrom AND v.r_start = r.r_start AND v.r_end = r.r_end
      AND v.subtype = p.b""",
        f"tested{suffix}": tested_sql(f"pair_rows{suffix}"),
    }


def tested_sql(rows: str, log2fc: str = "log2((pct_a + 0.1) / (pct_b + 0.1))", diff: str = "pct_a - pct_b") -> str:
    """Fisher by log-gamma sums over the support and row-form BH, for rows with ca, na, cb, nb."""
    lf = lambda x: f"lgamma({x} + 1)"
    pmf = lambda k: (f"{lf('na')} - {lf(k)} - {lf(f'na - {k}')} + {lf('nb')} - {lf(f'(ca + cb) - {k}')} "  # noqa: E731
                     f"- {lf(f'nb - (ca + cb) + {k}')} - {lf('na + nb')} + {lf('ca + cb')} "
                     f"+ {lf('na + nb - ca - cb')}")
    return f"""
SELECT *, least(1.0, MIN(raw) OVER (PARTITION BY grp, a, b ORDER BY p_value DESC, rn DESC)) AS fdr,
       least(1.0, MIN(graw) OVER (PARTITION BY grp ORDER BY p_value DESC, grn DESC)) AS global_fdr,
       {diff} AS diff_pct, {log2fc} AS log2fc
FROM (SELECT *, p_value * COUNT(*) OVER (PARTITION BY grp, a, b) / rn AS raw,
             p_value * COUNT(*) OVER (PARTITION BY grp) / grn AS graw
FROM (SELECT r.*, t.p_value, row_number() OVER (PARTITION BY r.grp, r.a, r.b ORDER BY t.p_value) AS rn,
             row_number() OVER (PARTITION BY r.grp ORDER BY t.p_value) AS grn
FROM {rows} r JOIN (
  SELECT na, nb, ca, cb, least(1.0, SUM(exp(lp)) FILTER (lp <= obs + 1e-7)) AS p_value
  FROM (SELECT na, nb, ca, cb, {pmf('ca')} AS obs, {pmf('k')} AS lp
        FROM (SELECT *, unnest(range(greatest(0, ca + cb - nb), least(ca + cb, na) + 1)) AS k
              FROM (SELECT DISTINCT na, nb, ca, cb FROM {rows})))
  GROUP BY 1, 2, 3, 4) t ON t.na = r.na AND t.nb = r.nb AND t.ca = r.ca AND t.cb = r.cb))"""


add_views(_presence_views("_all", "'ALL'") | _presence_views("_grp", "grp")
          | _presence_views("_lab", "'ALL'", "grp || '__' || subtype"))
add_views({
    "kept_all": "SELECT * FROM presence_all WHERE global_count >= 10",
    "kept_grp": "SELECT * FROM presence_grp WHERE global_count >= 4",
    "kept_lab": "SELECT * FROM presence_lab WHERE global_count >= 10",
})
add_views(_test_views("_all", "kept_all") | _test_views("_grp", "kept_grp"))


def _metrics_view(suffix: str) -> dict[str, str]:
    return {f"metrics{suffix}": f"""
SELECT *, max_pct - min_pct AS diff_pct, log2((max_pct + 0.1) / (min_pct + 0.1)) AS log2fc
FROM (SELECT c.grp, chrom, r_start, r_end, any_value(region_type) AS region_type, MAX(pct) AS max_pct,
             CASE WHEN COUNT(*) < MAX(n_subtypes) THEN 0 ELSE MIN(pct) END AS min_pct,
             SUM(pct) / MAX(n_subtypes) AS mean_pct,
             first(c.subtype ORDER BY pct DESC, ord) AS max_subtype,
             CASE WHEN COUNT(*) = 1 THEN MAX(c.subtype) ELSE '' END AS exclusive_subtype
      FROM kept{suffix} c JOIN sizes{suffix} s ON s.grp = c.grp AND s.subtype = c.subtype GROUP BY 1, 2, 3, 4)"""}


add_views(_metrics_view("_all") | _metrics_view("_grp"))


class Presence:
    """Counts and sizes of one fixture.

    ``view``: ``all`` is one group of subtypes, ``grp`` keeps the groups, ``lab``
    is one group in which every (group, subtype) is a subtype of its own.
    """

    def __init__(self, fx, view: str = "all"):
        self.fx, self.view = fx, view
        self.pick = {"all": fx.one_group, "grp": lambda d: d, "lab": fx.one_group_of_labels}[view]

    @cached_property
    def tags(self):
        return self.pick(self.fx.source_tags)

    @cached_property
    def sizes(self):
        return P.group_sizes(self.pick(self.fx.cells))

    @cached_property
    def counts(self):
        return P.agg_presence_counts(self.pick(self.fx.peak_rows), self.sizes, self.fx.region_tags, self.fx.tasks)

    @cached_property
    def kept(self):
        return P.filter_min_cells(self.counts, 4 if self.view == "grp" else P.MIN_CELLS)

    def metrics(self):
        return P.agg_pct_metrics(self.kept, self.sizes)

    @cached_property
    def stored(self):
        # read several times by the tests: for the tables and for the rows
        return durable(self.kept)

    def tested(self):
        return T.test_fisher_pairs(self.stored, self.sizes)

    @cached_property
    def tables(self):
        return T.fisher_pair_tables(self.stored, self.sizes)


def rounded(df, cols, places=9):
    return df.withColumns({c: F.round(c, places) for c in cols})


COUNT_COLS = ["grp", "chrom", "r_start", "r_end", "subtype", "cnt", "n_cells", "global_count", "region_type"]


@query("agg_presence_counts", f"SELECT {', '.join(COUNT_COLS)}, round(pct, 9) AS pct FROM presence_all")
def _(fx):
    return Presence(fx).counts.select(*COUNT_COLS, F.round("pct", 9).alias("pct"))


@query("filter_min_cells", "SELECT DISTINCT grp, chrom, r_start, r_end, global_count FROM presence_all "
                           "WHERE global_count >= 30")
def _(fx):
    return P.filter_min_cells(Presence(fx).counts, 30).select(*P.REGION, "global_count").distinct()


@query("join_semi_filtered", """
SELECT 'ALL' AS grp, t.subtype, t.cell_id, t.chrom, t.r_start, t.r_end, t.tag FROM source_tags t
WHERE (chrom, r_start, r_end) IN (SELECT (chrom, r_start, r_end) FROM presence_all WHERE global_count >= 30)""")
def _(fx):
    p = Presence(fx)
    return P.join_semi_filtered(p.tags, P.filter_min_cells(p.counts, 30)).select(
        "grp", "subtype", "cell_id", "chrom", "r_start", "r_end", "tag")


@query("filter_regulatory_multi", f"""
SELECT DISTINCT grp, chrom, r_start, r_end, region_type FROM kept_all WHERE {SIMPLE} <> 'gene_body'""")
def _(fx):
    return P.filter_regulatory_multi(Presence(fx).kept).select(*P.REGION, "region_type").distinct()


@query("filter_regulatory_single", """
SELECT DISTINCT grp, chrom, r_start, r_end, region_type FROM kept_all WHERE region_type <> 'gene_body'""")
def _(fx):
    return P.filter_regulatory_single(Presence(fx).kept).select(*P.REGION, "region_type").distinct()


SAMPLE_SQL = """
WITH fam AS (SELECT 'subtype' AS family, NULL AS sample, subtype, cell_id, chrom, r_start, r_end FROM peaks
  UNION ALL SELECT 'sample', sample, NULL, cell_id, chrom, r_start, r_end FROM peaks
  UNION ALL SELECT 'sample+subtype', sample, subtype, cell_id, chrom, r_start, r_end FROM peaks),
n AS (SELECT family, sample, subtype, COUNT(DISTINCT cell_id) AS n_cells FROM fam GROUP BY 1, 2, 3),
sampled AS (SELECT f.family, f.sample, f.subtype, chrom, r_start, r_end, COUNT(DISTINCT cell_id) AS cnt, MAX(n_cells) AS n_cells
  FROM fam f JOIN n ON n.family = f.family AND n.sample IS NOT DISTINCT FROM f.sample
   AND n.subtype IS NOT DISTINCT FROM f.subtype GROUP BY 1, 2, 3, 4, 5, 6)"""


@query("agg_presence_sample", f"{SAMPLE_SQL} SELECT *, round(cnt * 100.0::DOUBLE / n_cells, 9) AS pct FROM sampled")
def _(fx):
    return rounded(P.agg_presence_sample(fx.peaks), ["pct"])


@query("win_rankings", f"""{SAMPLE_SQL}
SELECT sample, subtype, chrom, r_start, r_end, cnt, round(cnt * 100.0::DOUBLE / n_cells, 9) AS pct,
       rank() OVER (PARTITION BY sample, subtype ORDER BY cnt DESC) AS rank FROM sampled
WHERE family = 'sample+subtype'""")
def _(fx):
    return rounded(P.win_rankings(P.agg_presence_sample(fx.peaks)), ["pct"])


METRIC_SQL = """SELECT grp, chrom, r_start, r_end, region_type, round(max_pct, 9) AS max_pct,
 round(min_pct, 9) AS min_pct, round(mean_pct, 9) AS mean_pct, max_subtype, exclusive_subtype,
 round(diff_pct, 9) AS diff_pct, round(log2fc, 9) AS log2fc FROM metrics_all"""
METRIC_NUM = ["max_pct", "min_pct", "mean_pct", "diff_pct", "log2fc"]


@query("agg_pct_metrics", METRIC_SQL)
def _(fx):
    return rounded(Presence(fx).metrics(), METRIC_NUM)


@query("agg_pct_metrics_first_stage", METRIC_SQL.replace(
    "round(log2fc, 9)", "round(log2((max_pct + 1.0::DOUBLE) / (min_pct + 1.0::DOUBLE)), 9)"))
def _(fx):
    p = Presence(fx)
    return rounded(P.agg_pct_metrics(p.kept, p.sizes, P.PSEUDO_FIRST_STAGE), METRIC_NUM)


@query("agg_common_high", f"{METRIC_SQL} WHERE min_pct >= 1.5")
def _(fx):
    return rounded(P.agg_common_high(Presence(fx).metrics(), 1.5), METRIC_NUM)


@query("agg_single_group_master", """
SELECT subtype AS grp, chrom, r_start, r_end, region_type, subtype, cnt,
       round(cnt * 100.0::DOUBLE / n_cells, 9) AS pct, round(cnt * 100.0::DOUBLE / n_cells, 9) AS diff_pct,
       0.0::DOUBLE AS log2fc, subtype AS exclusive_subtype
FROM presence_all WHERE cnt >= 4""")
def _(fx):
    alone = lambda d: d.withColumn("grp", F.col("subtype"))
    counts = P.agg_presence_counts(alone(fx.peak_rows), P.group_sizes(alone(fx.cells)), fx.region_tags, fx.tasks)
    m = P.agg_single_group_master(P.filter_min_cells(counts, 4))
    return rounded(m, ["pct", "diff_pct"]).drop("max_pct", "min_pct", "max_subtype")


@query("agg_type_breakdown", f"""
WITH act AS (SELECT grp, subtype, region_type, {SIMPLE} AS simple FROM kept_all)
SELECT grp, subtype, 'raw' AS level, tag AS region_class, COUNT(*) AS n_regions
FROM (SELECT grp, subtype, unnest(string_split(region_type, ';')) AS tag FROM act) GROUP BY 1, 2, 4
UNION ALL SELECT grp, subtype, 'simple', simple, COUNT(*) FROM act GROUP BY 1, 2, 4""")
def _(fx):
    return P.agg_type_breakdown(Presence(fx).kept)


@query("agg_exclusive_by_type", f"""
SELECT grp, exclusive_subtype AS subtype, {SIMPLE} AS simple_type, COUNT(*) AS n_regions
FROM metrics_grp WHERE exclusive_subtype <> '' GROUP BY 1, 2, 3""")
def _(fx):
    return P.agg_exclusive_by_type(Presence(fx, "grp").metrics())


@query("sim_jaccard_subtypes", """
WITH s AS (SELECT grp, subtype, COUNT(*) AS n FROM kept_all GROUP BY 1, 2),
x AS (SELECT u.grp, u.subtype AS a, v.subtype AS b, COUNT(*) AS n_shared FROM kept_all u JOIN kept_all v
      USING (grp, chrom, r_start, r_end) WHERE u.subtype <= v.subtype GROUP BY 1, 2, 3)
SELECT x.grp, a, b, n_shared, round(n_shared * 100.0::DOUBLE / (p.n + q.n - n_shared), 9) AS jaccard_pct
FROM x JOIN s p ON p.grp = x.grp AND p.subtype = a JOIN s q ON q.grp = x.grp AND q.subtype = b""")
def _(fx):
    return rounded(P.sim_jaccard_subtypes(Presence(fx).kept), ["jaccard_pct"])


@query("win_topn_per_group", """
SELECT grp, chrom, r_start, r_end, round(diff_pct, 9) AS diff_pct, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(diff_pct, 9) DESC, chrom, r_start, r_end) AS rank
  FROM metrics_grp) WHERE rank <= 500""")
def _(fx):
    m = rounded(Presence(fx, "grp").metrics(), ["diff_pct"])
    return P.win_topn_per_group(m, ["grp"], "diff_pct", 500, P.SPAN).select(*P.REGION, "diff_pct", "rank")


@query("win_anchor_dedup", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY grp, subtype ORDER BY pct DESC, chrom, r_start, r_end) AS rn
           FROM kept_all),
u AS (SELECT *, row_number() OVER (PARTITION BY grp, chrom, r_start, r_end ORDER BY subtype) AS f FROM t WHERE rn <= 30)
SELECT grp, chrom, r_start, r_end, subtype AS anchor, round(pct, 9) AS anchor_pct, region_type FROM u WHERE f = 1""")
def _(fx):
    p = Presence(fx)
    return rounded(P.win_anchor_dedup(p.kept, p.sizes, 30), ["anchor_pct"])


@query("region_companion", """
WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(diff_pct, 9) DESC, chrom,
             r_start, r_end) AS rn FROM metrics_all) WHERE rn <= 100),
mf AS (SELECT grp, chrom, r_start, r_end, MIN(fdr) AS min_fdr FROM tested_all GROUP BY ALL),
d AS (SELECT c.*, ord, n_subtypes, row_number() OVER (PARTITION BY c.grp, chrom, r_start, r_end ORDER BY pct DESC, ord)
      AS rn FROM kept_all c JOIN sizes_all s ON s.grp = c.grp AND s.subtype = c.subtype
      WHERE (chrom, r_start, r_end) IN (SELECT (chrom, r_start, r_end) FROM top))
SELECT d.grp, d.chrom, d.r_start, d.r_end, MAX(subtype) FILTER (rn = 1) AS first_subtype,
       round(MAX(pct) FILTER (rn = 1), 9) AS first_pct, MAX(subtype) FILTER (rn = 2) AS second_subtype,
       round(MAX(pct) FILTER (rn = 2), 9) AS second_pct, COUNT(*) FILTER (pct >= 5) AS n_ge5,
       COUNT(*) FILTER (pct >= 25) AS n_ge25, round(SUM(pct) / MAX(n_subtypes), 9) AS mean_pct,
       round(MAX(min_fdr), 8) AS min_fdr, CASE WHEN MAX(min_fdr) < 0.001 THEN '***' WHEN MAX(min_fdr) < 0.01 THEN '**'
       WHEN MAX(min_fdr) < 0.05 THEN '*' ELSE '' END AS stars
FROM d JOIN mf USING (grp, chrom, r_start, r_end) GROUP BY 1, 2, 3, 4""")
def _(fx):
    p = Presence(fx)
    top = P.win_topn_per_group(rounded(p.metrics(), ["diff_pct"]), ["grp"], "diff_pct", 100, P.SPAN)
    low = T.agg_min_fdr(p.stored, p.tables).drop("stars")
    out = P.region_companion(top, p.stored, p.sizes, low)
    return rounded(rounded(out, ["first_pct", "second_pct", "mean_pct"]), ["min_fdr"], 8)


@query("coord_lookup", """
SELECT region, grp, diff_pct, input_order FROM (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY grp) AS rn, CASE WHEN contains(region, 'chr5:1') THEN 0
    WHEN contains(region, 'chr1:24') THEN 1 END AS input_order
  FROM (SELECT chrom || ':' || r_start || '-' || r_end AS region, 'ALL' AS grp, round(diff_pct, 9) AS diff_pct
        FROM metrics_all)) WHERE input_order IS NOT NULL AND rn = 1""")
def _(fx):
    m = rounded(Presence(fx).metrics(), ["diff_pct"]).withColumn("region", coord(*P.SPAN))
    return P.coord_lookup(m, ["chr5:1", "chr1:2 4"], order="input").select("region", "grp", "diff_pct", "input_order")


# ---------------------------------------------------------------- tests

TEST_COLS = ["grp", "chrom", "r_start", "r_end", "a", "b", "ca", "cb", "na", "nb"]


@query("test_fisher_pairs", f"""
SELECT {', '.join(TEST_COLS)}, round(pct_a, 9) AS pct_a, round(pct_b, 9) AS pct_b, round(diff_pct, 9) AS diff_pct,
       round(log2fc, 9) AS log2fc, round(p_value, 8) AS p_value,
       round(CASE WHEN ca + cb = 0 OR na - ca + nb - cb = 0 THEN NULL WHEN na - ca > 0 AND cb > 0
         THEN ca * (nb - cb) / (cb * (na - ca))::DOUBLE ELSE 'Infinity'::DOUBLE END, 6) AS odds_ratio
FROM tested_all""")
def _(fx):
    t = Presence(fx).tested().select(*TEST_COLS, "pct_a", "pct_b", "diff_pct", "log2fc", "p_value", "odds_ratio")
    return rounded(rounded(rounded(t, ["pct_a", "pct_b", "diff_pct", "log2fc"]), ["p_value"], 8), ["odds_ratio"], 6)


@query("fdr_bh", f"""
SELECT {', '.join(TEST_COLS)}, round(fdr, 8) AS fdr, round(global_fdr, 8) AS global_fdr FROM tested_all""")
def _(fx):
    return rounded(Presence(fx).tested().select(*TEST_COLS, "fdr", "global_fdr"), ["fdr", "global_fdr"], 8)


@query("fdr_bh_regulatory", f"""
WITH pair_rows_reg AS (SELECT * FROM pair_rows_all WHERE {SIMPLE} <> 'gene_body'),
tested_reg AS ({tested_sql('pair_rows_reg')})
SELECT {', '.join(TEST_COLS)}, round(fdr, 8) AS fdr, round(global_fdr, 8) AS global_fdr FROM tested_reg""")
def _(fx):
    p = Presence(fx)
    t = T.test_fisher_pairs(durable(P.filter_regulatory_multi(p.kept)), p.sizes)
    return rounded(t.select(*TEST_COLS, "fdr", "global_fdr"), ["fdr", "global_fdr"], 8)


@query("test_direction", """
SELECT grp, a, b, direction, sig_005, sig_001, sig_0001, COUNT(*) AS n FROM (
  SELECT *, CASE WHEN fdr < 0.9 AND log2fc > 0 THEN 'up_in_' || a WHEN fdr < 0.9 AND log2fc < 0 THEN 'up_in_' || b
            ELSE 'ns' END AS direction, fdr < 0.05 AS sig_005, fdr < 0.01 AS sig_001, fdr < 0.001 AS sig_0001
  FROM tested_all) GROUP BY ALL""")
def _(fx):
    t = Presence(fx).tables.drop("direction", "sig_005", "sig_001", "sig_0001")
    return T.test_direction(t, 0.9).groupBy("grp", "a", "b", "direction", "sig_005", "sig_001", "sig_0001").agg(
        F.sum("m").alias("n"))


@query("agg_pair_summary", """
SELECT grp, a, b, COUNT(*) AS total_regions, MAX(na) AS na, MAX(nb) AS nb, COUNT(*) FILTER (fdr < 0.05) AS sig_005,
       COUNT(*) FILTER (fdr < 0.05 AND log2fc > 0) AS up_a_005, COUNT(*) FILTER (fdr < 0.05 AND log2fc < 0) AS up_b_005,
       COUNT(*) FILTER (fdr < 0.01) AS sig_001, COUNT(*) FILTER (fdr < 0.001) AS sig_0001,
       round(MAX(log2fc), 9) AS max_log2fc, round(MIN(log2fc), 9) AS min_log2fc, round(MIN(fdr), 8) AS min_fdr
FROM tested_all GROUP BY 1, 2, 3""")
def _(fx):
    s = T.agg_pair_summary(Presence(fx).tables).drop("up_a_001", "up_b_001", "up_a_0001", "up_b_0001")
    return rounded(rounded(s, ["max_log2fc", "min_log2fc"]), ["min_fdr"], 8)


@query("agg_min_fdr", """
SELECT grp, chrom, r_start, r_end, round(MIN(fdr), 8) AS min_fdr, CASE WHEN MIN(fdr) < 0.001 THEN '***'
  WHEN MIN(fdr) < 0.01 THEN '**' WHEN MIN(fdr) < 0.05 THEN '*' ELSE '' END AS stars
FROM tested_all GROUP BY 1, 2, 3, 4""")
def _(fx):
    p = Presence(fx)
    return rounded(T.agg_min_fdr(p.stored, p.tables), ["min_fdr"], 8)


@query("agg_pair_points", """
SELECT grp, a, b, chrom, r_start, r_end, neg AS neg_log10_fdr, round((pct_a + pct_b) / 2, 9) AS mean_presence,
       CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY grp, a, b ORDER BY neg DESC, chrom, r_start, r_end) AS rank
      FROM (SELECT *, round(-log10(greatest(fdr, 1e-300)), 7) + 0.0 AS neg FROM tested_all)) WHERE rank <= 8""")
def _(fx):
    p = Presence(fx)
    pts = T.agg_pair_points(p.stored, p.sizes, p.tables, 8, places=7)
    return rounded(pts, ["mean_presence"]).select(*T.PAIR, *P.SPAN, "neg_log10_fdr", "mean_presence", "rank")


@query("agg_fdr_histogram", """
SELECT grp, CAST(least(floor(round(fdr, 8) * 50), 49) AS INT) AS bin, COUNT(*) AS n FROM tested_all GROUP BY 1, 2""")
def _(fx):
    return T.agg_fdr_histogram(rounded(Presence(fx).tables, ["fdr"], 8))


@query("agg_diff_spread", f"""
SELECT grp, {SIMPLE} AS simple_type, COUNT(*) AS n, round(MIN(diff_pct), 8) AS q0,
       round(quantile_cont(diff_pct, 0.25), 8) AS q1, round(quantile_cont(diff_pct, 0.5), 8) AS q2,
       round(quantile_cont(diff_pct, 0.75), 8) AS q3, round(MAX(diff_pct), 8) AS q4
FROM metrics_all GROUP BY 1, 2""")
def _(fx):
    return rounded(T.agg_diff_spread(Presence(fx).metrics()), ["q0", "q1", "q2", "q3", "q4"], 8)
