"""Queries: TF ranks, contrasts, permutation test, itemsets, TF sets and cell similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspan.functions.coords import tf_short
from regspan.operators import itemsets as M, sets as S, tf as T
from regspan.operators.presence import win_topn_per_group
from regspan.plans.presence_queries import rounded
from regspan.plans.registry import query
from regspan.plans.views import add_views
from regspan.session import scratch_path
from regspan.sources.tables import sink_topn_exports


_SARLE = ("(skewness({x}) ** 2 + 1) / (kurtosis({x}) + 3 * (COUNT(*) - 1.0::DOUBLE) ** 2 / ((COUNT(*) - 2.0::DOUBLE) * (COUNT(*) - 3)))")


def _views(sfx: str, grp: str, sub: str) -> dict[str, str]:
    return {
        f"tfp{sfx}": f"SELECT {grp} AS grp, {sub} AS subtype, nucleus, tf, pct FROM tf_pct",
        f"tfrank{sfx}": f"""
SELECT *, rank() OVER (PARTITION BY grp, subtype, nucleus ORDER BY pct DESC)
       + (COUNT(*) OVER (PARTITION BY grp, subtype, nucleus, pct) - 1) / 2.0::DOUBLE AS r
FROM (SELECT n.grp, n.subtype, n.nucleus, v.tf, COALESCE(p.pct, 0) AS pct
      FROM (SELECT DISTINCT grp, subtype, nucleus FROM tfp{sfx}) n CROSS JOIN (SELECT DISTINCT tf FROM tf_pct) v
      LEFT JOIN tfp{sfx} p ON p.grp = n.grp AND p.subtype = n.subtype AND p.nucleus = n.nucleus AND p.tf = v.tf)""",
        f"tfdiv{sfx}": f"""
SELECT grp, subtype, tf, COUNT(*) AS n_nuclei, stddev_samp(r) AS divergence_std, AVG(r) AS mean_rank,
       AVG(CASE WHEN pct > 0 THEN 1.0::DOUBLE ELSE 0 END) AS occupancy, stddev_samp(r) / AVG(r) AS cv,
       split_part(tf, '_MA', 1) AS tf_short
FROM tfrank{sfx} GROUP BY 1, 2, 3""",
        f"tfb{sfx}": f"""
SELECT grp, subtype, tf, COUNT(*) AS n_nuclei, CASE WHEN COUNT(*) >= 20 AND var_pop(r) > 1e-9 THEN {_SARLE.format(x='r')} END AS b
FROM tfrank{sfx} GROUP BY 1, 2, 3""",
        f"tfnull{sfx}": f"""
SELECT n, d, {_SARLE.format(x='u')} AS c FROM (
  SELECT n, d, xor(h, h >> 16) / 4294967296.0::DOUBLE AS u FROM (
    SELECT n, d, CAST((xor(h, h >> 13)::HUGEINT * {T.NULL_MIX[4]}) % 4294967296 AS BIGINT) AS h FROM (
      SELECT n, d, CAST((xor(h, h >> 16)::HUGEINT * {T.NULL_MIX[3]}) % 4294967296 AS BIGINT) AS h FROM (
        SELECT n, d, (i * {T.NULL_MIX[0]} + d * {T.NULL_MIX[1]} + n * {T.NULL_MIX[2]}) % 4294967296 AS h FROM (
          SELECT n, d, unnest(range(0, n)) AS i FROM (
            SELECT n, unnest(range(0, {T.NULL_DRAWS})) AS d FROM (SELECT DISTINCT n_nuclei AS n FROM tfb{sfx} WHERE b IS NOT NULL))))))) GROUP BY n, d""",
        f"tfbim{sfx}": f"""
SELECT grp, subtype, tf, n_nuclei, bimodality, p_value, fdr, fdr < 0.05 AS bimodal FROM (
  SELECT *, least(1.0, MIN(raw) OVER (PARTITION BY grp, subtype ORDER BY p_value DESC, rn DESC)) AS fdr FROM (
    SELECT *, p_value * COUNT(*) OVER (PARTITION BY grp, subtype) / rn AS raw FROM (
      SELECT *, row_number() OVER (PARTITION BY grp, subtype ORDER BY p_value) AS rn FROM (
        SELECT grp, subtype, tf, n_nuclei, b AS bimodality, CASE WHEN b IS NULL THEN 1.0::DOUBLE ELSE
               (1 + (SELECT COUNT(*) FROM tfnull{sfx} k WHERE k.n = t.n_nuclei AND k.c >= t.b - 1e-9)) / {T.NULL_DRAWS + 1}.0::DOUBLE END AS p_value
        FROM tfb{sfx} t))))""",
    }


add_views(_views("_all", "'ALL'", "subtype") | _views("_grp", "grp", "subtype")
          | _views("_lab", "'ALL'", "grp || '__' || subtype"))
DIV = ["divergence_std", "mean_rank", "occupancy", "cv"]


def _div(fx, view="all"):
    pick = {"all": fx.one_group, "grp": lambda d: d, "lab": fx.one_group_of_labels}[view]
    return T.win_divergence(pick(fx.tf_pct))


def _ranked(fx, view="all"):
    """SDs cut to 9 places, so that ties break by name in both engines."""
    return rounded(_div(fx, view), ["divergence_std"])


@query("win_rank_within_nucleus", """
SELECT grp, subtype, nucleus, tf, round(pct, 9) AS pct, r AS rank FROM tfrank_all""")
def _(fx):
    return rounded(T.win_rank_within_nucleus(fx.one_group(fx.tf_pct)), ["pct"])


@query("win_divergence", f"""
SELECT grp, subtype, tf, tf_short, n_nuclei, {', '.join(f'round({c}, 7) AS {c}' for c in DIV)} FROM tfdiv_all""")
def _(fx):
    return rounded(_div(fx), DIV, 7).drop("n_tf")


@query("screen_bimodal", """
SELECT grp, subtype, tf, n_nuclei, round(bimodality, 6) AS bimodality, round(p_value, 9) AS p_value, round(fdr, 9) AS fdr, bimodal
FROM tfbim_all""")
def _(fx):
    return rounded(rounded(T.screen_bimodal(fx.one_group(fx.tf_pct)), ["bimodality"], 6), ["p_value", "fdr"])


@query("tf_subtype_summary", """
SELECT grp, subtype, MAX(n_nuclei) AS n_nuclei, round(AVG(divergence_std) FILTER (rn <= 20), 7) AS mean_top_std,
       round(median(divergence_std), 7) AS median_std, COUNT(*) FILTER (bimodal) AS n_bimodal
FROM (SELECT d.*, bimodal, row_number() OVER (PARTITION BY d.grp, d.subtype ORDER BY round(divergence_std, 9) DESC, d.tf)
      AS rn FROM tfdiv_all d JOIN tfbim_all b ON b.subtype = d.subtype AND b.tf = d.tf) GROUP BY 1, 2""")
def _(fx):
    s = T.tf_subtype_summary(_ranked(fx), T.screen_bimodal(fx.one_group(fx.tf_pct)), 20)
    return rounded(s, ["mean_top_std", "median_std"], 7)


@query("tf_node_spread", """
SELECT CASE WHEN subtype < 'C' THEN 'node1' ELSE 'node2' END AS node, grp, subtype, COUNT(*) AS n,
       round(MIN(divergence_std), 7) AS q0, round(quantile_cont(divergence_std, 0.25), 7) AS q1,
       round(median(divergence_std), 7) AS q2, round(quantile_cont(divergence_std, 0.75), 7) AS q3,
       round(MAX(divergence_std), 7) AS q4 FROM tfdiv_all GROUP BY 1, 2, 3""")
def _(fx):
    return rounded(T.tf_node_spread(_div(fx), _nodes(fx)), ["q0", "q1", "q2", "q3", "q4"], 7)


def _nodes(fx):
    return fx.cells.select("subtype", F.when(F.col("subtype") < "C", "node1").otherwise("node2").alias("node")).distinct()


BETWEEN = """COUNT(*) AS n_subtypes, round(AVG(divergence_std), 7) AS mean_std,
 round(stddev_samp(divergence_std), 7) AS between_std, round(MAX(divergence_std) - MIN(divergence_std), 7) AS between_range,
 first(subtype ORDER BY round(divergence_std, 9) DESC, subtype) AS max_subtype,
 first(subtype ORDER BY round(divergence_std, 9), subtype) AS min_subtype, split_part(tf, '_MA', 1) AS tf_short"""
BNUM = ["mean_std", "between_std", "between_range"]


@query("tf_between_rank", f"SELECT tf, {BETWEEN} FROM tfdiv_lab GROUP BY tf")
def _(fx):
    return rounded(T.tf_between_rank(_ranked(fx, "lab")), BNUM, 7)


@query("tf_between_rank_within", f"SELECT grp, tf, {BETWEEN} FROM tfdiv_grp GROUP BY grp, tf HAVING COUNT(*) >= 2")
def _(fx):
    return rounded(T.tf_between_rank(_ranked(fx, "grp"), ["grp"]).where("n_subtypes >= 2"), BNUM, 7)


def _top_sql(n: int, where: str = "", view: str = "tfdiv_lab") -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, subtype
 ORDER BY round(divergence_std, 9) DESC, tf) AS rn FROM {view}) WHERE rn <= {n} {where})"""


@query("top_shared", f"SELECT tf_short, COUNT(*) AS n_subtypes FROM {_top_sql(5)} GROUP BY 1 HAVING COUNT(*) >= 2")
def _(fx):
    return T.top_shared(_ranked(fx, "lab"), 5, 2)


def _list_sql(side):
    return f"""(SELECT tf_short, COUNT(*) AS n FROM {_top_sql(5, f"AND subtype {side} 'G2'")}
 GROUP BY 1 ORDER BY n DESC, tf_short LIMIT 15)"""


@query("cmp_top_lists", f"""
SELECT tf_short, x.n AS score_a, y.n AS score_b FROM {_list_sql('<')} x JOIN {_list_sql('>=')} y USING (tf_short)""")
def _(fx):
    d = _ranked(fx, "lab")
    first, rest = (T.top_shared(d.where(c), 5) for c in ("subtype < 'G2'", "subtype >= 'G2'"))
    return T.cmp_top_lists(first, rest, "tf_short", "n_subtypes")


@query("win_zscore_rows", """
SELECT tf, subtype, round((divergence_std - AVG(divergence_std) OVER w) / CASE WHEN stddev_samp(divergence_std) OVER w
  > 1e-12 THEN stddev_samp(divergence_std) OVER w ELSE 1 END, 6) AS z
FROM tfdiv_all WINDOW w AS (PARTITION BY tf)""")
def _(fx):
    return rounded(T.win_zscore_rows(_div(fx), "tf", "divergence_std").select("tf", "subtype", "z"), ["z"], 6)


@query("sink_topn_exports", """
SELECT subtype, tf, list, CAST(rank AS INT) AS rank, divergence_std FROM (
  SELECT subtype, tf, round(divergence_std, 9) AS divergence_std, row_number() OVER (
    PARTITION BY subtype ORDER BY round(divergence_std, 9) DESC, tf) AS rank FROM tfdiv_all)
JOIN (VALUES ('top5', 5), ('top10', 10), ('full', 1000000)) l(list, n) ON rank <= n""")
def _(fx):
    path = scratch_path(fx.spark, "rankings")
    return sink_topn_exports(_ranked(fx), path, sizes=(5, 10)).select("subtype", "tf", "list", "rank", "divergence_std")


IN_GROUPS = ("G0", "G1")


def normal_p_sql(u: str, n1: str, n2: str, ties: str) -> str:
    """Two-sided tie-corrected normal p; erf as a gamma-function series."""
    n = f"({n1} + {n2})"
    z = (f"greatest((greatest({u}, {n1} * {n2} - {u}) - {n1} * {n2} / 2.0::DOUBLE - 0.5) / sqrt({n1} * {n2} / 12.0::DOUBLE "
         f"* ({n} + 1 - {ties} / ({n} * ({n} - 1))::DOUBLE)), 0)")
    x = f"({z} / sqrt(2.0::DOUBLE))"
    return (f"CASE WHEN {z} <= 0 THEN 1.0::DOUBLE ELSE 1 - list_sum(list_transform(range(0, 150), lambda i: "
            f"exp((2 * i + 1) * ln({x}) - {x} * {x} - lgamma(i + 1.5)))) END")


def mwu_sql(values: str, key: str, n1: int, n2: int) -> str:
    """Dense ranks of all members per key; ``values`` has the key, inside (bool) and v for every member."""
    p = normal_p_sql("u1", str(n1), str(n2), "ties")
    return f"""
SELECT {key}, u1, {p} AS mwu_p FROM (
  SELECT {key}, SUM(r) FILTER (inside) - {n1} * ({n1} + 1) / 2.0::DOUBLE AS u1, SUM(t * t - 1) AS ties
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY {key}, v) AS t, rank() OVER (PARTITION BY {key} ORDER BY v)
        + (COUNT(*) OVER (PARTITION BY {key}, v) - 1) / 2.0::DOUBLE AS r FROM {values})
  GROUP BY {key})"""


def bh_sql(rows: str, p: str, out: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""
SELECT * EXCLUDE (rn, raw), least(1.0, MIN(raw) OVER ({part} ORDER BY {p} DESC, rn DESC)) AS {out}
FROM (SELECT *, {p} * COUNT(*) OVER ({part}) / rn AS raw
      FROM (SELECT *, row_number() OVER ({part} ORDER BY {p}) AS rn FROM {rows}))"""


@query("test_mwu_tf", f"""
WITH v AS (SELECT tf, subtype, substr(subtype, 1, 2) IN ('G0', 'G1') AS inside, occupancy,
                  round((SELECT COUNT(DISTINCT tf) FROM tf_pct) - mean_rank, 9) AS v FROM tfdiv_lab),
p AS ({mwu_sql('v', 'tf', 10, 15)}),
f AS ({bh_sql('p', 'mwu_p', 'mwu_fdr')}),
m AS (SELECT tf, AVG(v) FILTER (inside) AS i, AVG(v) FILTER (NOT inside) AS r, AVG(occupancy) FILTER (inside) * 100 AS io,
             AVG(occupancy) FILTER (NOT inside) * 100 AS ro FROM v GROUP BY 1)
SELECT tf, round(i, 6) AS in_dominance, round(r, 6) AS ref_dominance, round(io, 6) AS in_occ_pct,
       round(ro, 6) AS ref_occ_pct, round(mwu_p, 8) AS mwu_p, round(mwu_fdr, 8) AS mwu_fdr, round(i - r, 6) AS delta,
       CASE WHEN i > r THEN 'higher' WHEN i < r THEN 'lower' ELSE 'equal' END AS side
FROM m JOIN f USING (tf)""")
def _(fx):
    labels = [r[0] for r in fx.one_group_of_labels(fx.cells).select("subtype").distinct().collect()]
    inside = [s for s in labels if s[:2] in IN_GROUPS]
    t = T.test_mwu_tf(_div(fx, "lab"), inside, [s for s in labels if s not in inside])
    return rounded(rounded(t, ["in_dominance", "ref_dominance", "in_occ_pct", "ref_occ_pct", "delta"], 6),
                   ["mwu_p", "mwu_fdr"], 8)


PERMS = 2000


@query("test_permutation", f"""
WITH nuc AS (SELECT DISTINCT grp, subtype, nucleus FROM tf_pct),
hi AS (SELECT grp, subtype, SUM(n) OVER (PARTITION BY grp ORDER BY subtype) AS hi, SUM(n) OVER (
         PARTITION BY grp ORDER BY subtype) - n AS lo FROM (SELECT grp, subtype, COUNT(*) AS n FROM nuc GROUP BY 1, 2)),
pl AS (SELECT grp, nucleus, perm, row_number() OVER (PARTITION BY grp, perm ORDER BY md5(nucleus || '|' || perm || '|1'),
         nucleus) AS place FROM nuc, range(1, {PERMS} + 1) q(perm)),
lab AS (SELECT pl.grp, nucleus, perm, subtype AS label FROM pl JOIN hi ON hi.grp = pl.grp AND place > lo AND place <= hi),
tp AS (SELECT grp, perm, tf, stddev_samp(sd) AS t FROM (
         SELECT l.grp, perm, label, tf, stddev_samp(r) AS sd FROM lab l JOIN tfrank_grp k
           ON k.grp = l.grp AND k.nucleus = l.nucleus GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
ob AS (SELECT grp, tf, stddev_samp(sd) AS t_obs FROM (
         SELECT grp, subtype, tf, stddev_samp(r) AS sd FROM tfrank_grp GROUP BY 1, 2, 3) GROUP BY 1, 2),
d AS (SELECT grp, tf, t_obs, COUNT(*) FILTER (t >= t_obs - 1e-9) AS n_ge, AVG(t) AS null_mean, stddev_pop(t) AS null_sd,
             (COUNT(*) FILTER (t >= t_obs - 1e-9) + 1) / {PERMS + 1}.0::DOUBLE AS perm_p
      FROM tp JOIN ob USING (grp, tf) GROUP BY 1, 2, 3)
SELECT grp, tf, round(t_obs, 7) AS t_obs, n_ge, round(null_mean, 7) AS null_mean, round(null_sd, 7) AS null_sd,
       round(perm_p, 8) AS perm_p, round(perm_fdr, 8) AS perm_fdr,
       round(CASE WHEN null_sd > 1e-9 THEN (t_obs - null_mean) / null_sd ELSE 0 END, 5) AS z_score,
       perm_fdr < 0.05 AS significant FROM ({bh_sql('d', 'perm_p', 'perm_fdr', 'grp')})""")
def _(fx):
    t = T.test_permutation(fx.tf_pct, PERMS, 1)
    return rounded(rounded(rounded(t, ["t_obs", "null_mean", "null_sd"], 7), ["perm_p", "perm_fdr"], 8), ["z_score"], 5)


# ---------------------------------------------------------------- itemsets

add_views({
    "zeros": """
SELECT grp, subtype, nucleus, tf, pct = 0 AS z FROM tfrank_all""",
    "informative": """
SELECT *, row_number() OVER (PARTITION BY grp, subtype ORDER BY round(zero_rate * (1 - zero_rate), 12) DESC, tf) - 1 AS idx
FROM (SELECT grp, subtype, tf, COUNT(*) AS n_cell, COUNT(*) FILTER (z) AS n_zero,
             COUNT(*) FILTER (z) / COUNT(*)::DOUBLE AS zero_rate FROM zeros GROUP BY 1, 2, 3)
WHERE zero_rate BETWEEN 0.05 AND 0.95 QUALIFY idx < 50""",
    "fi1": """
SELECT *, greatest(10, CAST(round_even(n_cell * 0.02::DOUBLE, 0) AS BIGINT)) AS min_support, split_part(tf, '_MA', 1) AS s
FROM informative WHERE n_zero >= greatest(10, CAST(round_even(n_cell * 0.02::DOUBLE, 0) AS BIGINT))""",
    "zit": """
SELECT z.grp, z.subtype, nucleus, i.idx, i.s, i.n_cell, i.min_support FROM zeros z JOIN fi1 i
  ON i.subtype = z.subtype AND i.tf = z.tf WHERE z.z""",
    "cozero": """
SELECT grp, subtype, 1 AS size, s AS tfs, n_zero AS support_count, n_zero * 100.0::DOUBLE / n_cell AS support_pct FROM fi1
UNION ALL
SELECT a.grp, a.subtype, 2, a.s || ' + ' || b.s, COUNT(*), COUNT(*) * 100.0::DOUBLE / MAX(a.n_cell)
FROM zit a JOIN zit b ON a.subtype = b.subtype AND a.nucleus = b.nucleus AND a.idx < b.idx
GROUP BY a.grp, a.subtype, a.s, b.s HAVING COUNT(*) >= MAX(a.min_support)
UNION ALL
SELECT a.grp, a.subtype, 3, a.s || ' + ' || b.s || ' + ' || c.s, COUNT(*), COUNT(*) * 100.0::DOUBLE / MAX(a.n_cell)
FROM zit a JOIN zit b ON a.subtype = b.subtype AND a.nucleus = b.nucleus AND a.idx < b.idx
JOIN zit c ON a.subtype = c.subtype AND a.nucleus = c.nucleus AND b.idx < c.idx
GROUP BY a.grp, a.subtype, a.s, b.s, c.s HAVING COUNT(*) >= MAX(a.min_support)""",
})
FIM_TOP = M.TOP_TF


@query("fim_informative", """
SELECT grp, subtype, tf, n_cell, n_zero, round(zero_rate, 9) AS zero_rate, CAST(idx AS INT) AS idx FROM informative""")
def _(fx):
    return rounded(M.fim_informative(fx.one_group(fx.tf_pct), FIM_TOP), ["zero_rate"])


@query("fim_cozero", """
SELECT grp, subtype, CAST(size AS INT) AS size, tfs, support_count, round(support_pct, 9) AS support_pct FROM cozero""")
def _(fx):
    return rounded(M.fim_cozero(fx.one_group(fx.tf_pct), FIM_TOP), ["support_pct"])


@query("fim_pair_prevalence", """
SELECT array_to_string(list_sort(string_split(tfs, ' + ')), ' + ') AS tf_pair, COUNT(*) AS n_subtypes,
       round(AVG(support_pct), 8) AS mean_support_pct, round(MAX(support_pct), 8) AS max_support_pct
FROM cozero WHERE size = 2 GROUP BY 1""")
def _(fx):
    return rounded(M.fim_pair_prevalence(M.fim_cozero(fx.one_group(fx.tf_pct), FIM_TOP)),
                   ["mean_support_pct", "max_support_pct"], 8)


@query("fim_counts", """
SELECT grp, subtype, COUNT(*) AS n_itemsets, COUNT(*) FILTER (size = 2) AS n_pairs, COUNT(*) FILTER (size = 3) AS n_triples
FROM cozero GROUP BY 1, 2""")
def _(fx):
    return M.fim_counts(M.fim_cozero(fx.one_group(fx.tf_pct), FIM_TOP))


@query("fim_pair_matrix", """
WITH it AS (SELECT z.subtype, nucleus, i.idx, split_part(i.tf, '_MA', 1) AS s FROM zeros z JOIN informative i
            ON i.subtype = z.subtype AND i.tf = z.tf WHERE z.z),
n AS (SELECT a.subtype, a.s AS tf_i, b.s AS tf_j, COUNT(*) AS n FROM it a JOIN it b ON a.subtype = b.subtype
      AND a.nucleus = b.nucleus AND a.idx <= b.idx GROUP BY 1, 2, 3)
SELECT x.grp, x.subtype, split_part(x.tf, '_MA', 1) AS tf_i, split_part(y.tf, '_MA', 1) AS tf_j,
       round(COALESCE(n.n, 0) * 100.0::DOUBLE / x.n_cell, 9) AS cozero_pct
FROM informative x JOIN informative y ON x.subtype = y.subtype AND x.idx <= y.idx
LEFT JOIN n ON n.subtype = x.subtype AND n.tf_i = split_part(x.tf, '_MA', 1) AND n.tf_j = split_part(y.tf, '_MA', 1)""")
def _(fx):
    return rounded(M.fim_pair_matrix(fx.one_group(fx.tf_pct), FIM_TOP), ["cozero_pct"])


# ---------------------------------------------------------------- sets of TFs

SETS_SQL = f"(SELECT DISTINCT substr(subtype, 1, 2) AS set, tf AS element FROM {_top_sql(4)})"


def _tf_sets(fx):
    """Top TFs of every group as named sets."""
    top = win_topn_per_group(_ranked(fx, "lab"), ["grp", "subtype"], "divergence_std", 4, ["tf"])
    return top.select(F.substring("subtype", 1, 2).alias("set"), F.col("tf").alias("element")).distinct()


GROUPS = ["G0", "G1", "G2", "G3", "G4"]


@query("set_membership", f"""
SELECT element, {', '.join(f"MAX(CASE WHEN set = '{g}' THEN 1 ELSE 0 END) AS {g}" for g in GROUPS)},
       COUNT(DISTINCT set) AS n_sets FROM {SETS_SQL} GROUP BY 1""")
def _(fx):
    return S.set_membership(_tf_sets(fx), GROUPS)


@query("set_unique", f"""
SELECT element, MIN(set) AS unique_to FROM {SETS_SQL} GROUP BY 1 HAVING COUNT(DISTINCT set) = 1""")
def _(fx):
    return S.set_unique(_tf_sets(fx))


@query("set_intersections", f"""
SELECT sets, degree, COUNT(*) AS n_elements, string_agg(element, ', ' ORDER BY element) AS elements FROM (
  SELECT element, string_agg(set, ' & ' ORDER BY set) AS sets, COUNT(*) AS degree FROM {SETS_SQL} GROUP BY 1)
GROUP BY 1, 2""")
def _(fx):
    return S.set_intersections(_tf_sets(fx))


@query("set_node_aggregate", f"""
SELECT DISTINCT CASE WHEN set < 'G2' THEN 'left' ELSE 'right' END AS node, element FROM {SETS_SQL}""")
def _(fx):
    sets = _tf_sets(fx)
    parents = sets.select("set", F.when(F.col("set") < "G2", "left").otherwise("right").alias("node")).distinct()
    return S.set_node_aggregate(sets, parents)


@query("set_majority", f"""
WITH f AS (SELECT substr(subtype, 1, 2) AS grp, subtype, tf FROM {_top_sql(8)}),
k AS (SELECT grp, COUNT(*) AS k FROM sizes_grp GROUP BY 1)
SELECT f.grp, tf, COUNT(DISTINCT subtype) AS n_flagged FROM f JOIN k USING (grp) GROUP BY 1, 2, k
HAVING COUNT(DISTINCT subtype) >= CASE WHEN k = 1 THEN 1 ELSE (k + 1) // 2 END""")
def _(fx):
    top = win_topn_per_group(_ranked(fx, "lab"), ["grp", "subtype"], "divergence_std", 8, ["tf"])
    flags = top.select(F.substring("subtype", 1, 2).alias("grp"), "subtype", "tf")
    return S.set_majority(flags, fx.cells.select("grp", "subtype").distinct())


@query("sim_jaccard_cells", """
WITH h AS (SELECT DISTINCT grp || '__' || subtype AS subtype, cell_id, chrom, r_start, r_end FROM peaks),
n AS (SELECT subtype, cell_id, COUNT(*) AS n FROM h GROUP BY 1, 2)
SELECT p.subtype, p.a AS cell_a, p.b AS cell_b, p.n_shared,
       round(p.n_shared * 100.0::DOUBLE / (x.n + y.n - p.n_shared), 9) AS jaccard_pct
FROM (SELECT u.subtype, u.cell_id AS a, v.cell_id AS b, COUNT(*) AS n_shared FROM h u JOIN h v
        USING (subtype, chrom, r_start, r_end) WHERE u.cell_id < v.cell_id GROUP BY 1, 2, 3) p
JOIN n x ON x.subtype = p.subtype AND x.cell_id = p.a JOIN n y ON y.subtype = p.subtype AND y.cell_id = p.b""")
def _(fx):
    return rounded(S.sim_jaccard_cells(fx.one_group_of_labels(fx.peaks), tasks=fx.tasks), ["jaccard_pct"])


@query("sim_jaccard_cells_all", """
WITH h AS (SELECT DISTINCT cell_id, chrom, r_start, r_end FROM peaks),
n AS (SELECT cell_id, COUNT(*) AS n FROM h GROUP BY 1)
SELECT 'ALL' AS subtype, p.a AS cell_a, p.b AS cell_b, p.n_shared,
       round(p.n_shared * 100.0::DOUBLE / (x.n + y.n - p.n_shared), 9) AS jaccard_pct
FROM (SELECT u.cell_id AS a, v.cell_id AS b, COUNT(*) AS n_shared FROM h u JOIN h v
        USING (chrom, r_start, r_end) WHERE u.cell_id < v.cell_id GROUP BY 1, 2) p
JOIN n x ON x.cell_id = p.a JOIN n y ON y.cell_id = p.b""")
def _(fx):
    return rounded(S.sim_jaccard_cells(fx.peaks, by=None, tasks=fx.tasks), ["jaccard_pct"])


@query("sim_jaccard_cells_least", """
WITH h AS (SELECT DISTINCT cell_id, chrom, r_start, r_end FROM peaks),
n AS (SELECT cell_id, COUNT(*) AS n FROM h GROUP BY 1)
SELECT 'ALL' AS subtype, p.a AS cell_a, p.b AS cell_b, p.n_shared,
       round(p.n_shared * 100.0::DOUBLE / (x.n + y.n - p.n_shared), 9) AS jaccard_pct
FROM (SELECT u.cell_id AS a, v.cell_id AS b, COUNT(*) AS n_shared FROM h u JOIN h v
        USING (chrom, r_start, r_end) WHERE u.cell_id < v.cell_id GROUP BY 1, 2) p
JOIN n x ON x.cell_id = p.a JOIN n y ON y.cell_id = p.b WHERE p.n_shared * 100.0::DOUBLE / (x.n + y.n - p.n_shared) >= 5""")
def _(fx):
    return rounded(S.sim_jaccard_cells_least(fx.peaks, 5, by=None), ["jaccard_pct"])


@query("tf_short_names", "SELECT tf_motif, split_part(tf_motif, '_MA', 1) AS tf, COUNT(*) AS n FROM footprints GROUP BY 1")
def _(fx):
    return fx.footprints.groupBy("tf_motif", tf_short("tf_motif").alias("tf")).agg(F.count("*").alias("n"))
