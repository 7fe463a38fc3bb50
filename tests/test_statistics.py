import math
from fractions import Fraction
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from regspan.functions import stats as S
from regspan.operators import evaluation as E, pairwise as T, scale as C, tf as TF
from regspan.operators.presence import win_topn_per_group


def fisher(ca, na, cb, nb):
    if ca > na or cb > nb:
        return 1.0
    r = ca + cb
    w = {k: math.comb(na, k) * math.comb(nb, r - k) for k in range(max(0, r - nb), min(r, na) + 1)}
    return float(Fraction(sum(v for v in w.values() if v * 10 ** 7 <= w[ca] * (10 ** 7 + 1)), sum(w.values())))


def test_fisher_against_whole_numbers(spark):
    rng = np.random.default_rng(1)
    rows = [(0, 5, 0, 9), (5, 5, 0, 9), (7, 5, 1, 9), (3, 40, 30, 60), (0, 300, 300, 300), (10, 2000, 900, 3000), (0, 0, 0, 4)]
    for _ in range(60):
        na, nb = (int(x) for x in rng.integers(1, 400, 2))
        rows.append((int(rng.integers(0, na + 1)), na, int(rng.integers(0, nb + 1)), nb))
    rows += [(b, n, a, m) for a, m, b, n in rows]
    df = spark.createDataFrame(rows, "ca long, na long, cb long, nb long")
    got = {(r.ca, r.na, r.cb, r.nb): r.p_value for r in T.fisher_tables(df.union(df)).collect()}
    assert set(got) == set(rows)
    for ca, na, cb, nb in rows:
        p = got[ca, na, cb, nb]
        assert math.isclose(p, fisher(ca, na, cb, nb), rel_tol=1e-8, abs_tol=1e-300), (ca, na, cb, nb)
        assert math.isclose(p, got[cb, nb, ca, na], rel_tol=1e-8, abs_tol=1e-300)  # sides may swap


def test_fisher_large_tables_stay_finite():
    assert 0 <= S.hypergeometric_p(60_000, 70_000, 30_100, np.array([30_000]))[0] < 1e-300


def bh(p):
    p = np.asarray(p)
    o = np.argsort(p, kind="stable")
    adj = np.minimum.accumulate((p[o] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[o] = np.minimum(adj, 1)
    return out


def test_bh_of_distinct_values_is_the_row_form(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([10.0 ** -rng.uniform(0, 12, 300), np.round(rng.uniform(0, 1, 500), 2), np.ones(300), [0.0, 0.0]])
    g = rng.integers(0, 3, len(p))
    df = spark.createDataFrame([(int(i), int(k), float(v)) for i, (k, v) in enumerate(zip(g, p))], "i long, g int, p double")
    got = {r.i: r.fdr for r in T.fdr_bh(df, "p", ["g"]).collect()}
    assert len(got) == len(p)
    for k in range(3):
        at = np.flatnonzero(g == k)
        np.testing.assert_allclose([got[int(i)] for i in at], bh(p[at]), atol=1e-12)


def test_running_totals(spark):
    rng = np.random.default_rng(3)
    v = sorted(set(np.round(rng.uniform(0, 1, 400), 4)) | {0.0, 1.0, 1e-7, 2.0 ** -10})
    n = rng.integers(1, 9, len(v))
    df = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(v, n)], "k int, x double, n long")
    got = sorted((r.x, r.cum_n, r.all_n) for r in C.running_totals(df, ["k"], "x", C.unit_bucket("x"), ["n"]).collect())
    assert got == [(float(a), int(c), int(n.sum())) for a, c in zip(v, np.cumsum(n))]


def test_salted_join_keeps_every_copy(spark):
    big = spark.createDataFrame([("hot", 1)] * 500 + [("cold", 2)], "k string, v int")
    small = spark.createDataFrame([("hot", 10), ("cold", 20), ("none", 30)], "k string, w int")
    got = C.salted_join(big, small, ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.max("w").alias("w")).collect()
    assert {(r.k, r.n, r.w) for r in got} == {("hot", 500, 10), ("cold", 1, 20)}


def test_checked_broadcast_leaves_large_sides_alone(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert C.checked_broadcast(df, 99) is df
    small = C.checked_broadcast(df, 100)
    plan = df.join(small, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def avg_ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_mann_whitney_exact_and_normal(spark):
    rng = np.random.default_rng(4)
    n1, n2 = 4, 6
    rows, want = [], {}
    for key in range(12):
        x = rng.permutation(n1 + n2).astype(float) if key < 6 else rng.integers(0, 3, n1 + n2).astype(float)
        rows += [(key, i < n1, float(v)) for i, v in enumerate(x)]
        r = avg_ranks(x)
        u1 = r[:n1].sum() - n1 * (n1 + 1) / 2
        u = max(u1, n1 * n2 - u1)
        n = n1 + n2
        if len(set(x)) == n:
            us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n + 1), n1)]
            want[key] = min(1.0, 2 * sum(v >= u for v in us) / len(us))
        else:
            _, t = np.unique(x, return_counts=True)
            s = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t ** 3 - t).sum() / (n * (n - 1))))
            z = max((u - n1 * n2 / 2 - 0.5) / s, 0)
            want[key] = min(1.0, math.erfc(z / math.sqrt(2)))
    df = spark.createDataFrame(rows, "key int, inside boolean, v double")
    got = {r.key: r.mwu_p for r in TF.mann_whitney(df, ["key"], "inside", "v", n1, n2).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert math.isclose(got[k], want[k], rel_tol=1e-9), (k, got[k], want[k])


def test_normal_tail(spark):
    z = [0.0, 0.1, 1.0, 2.5, 3.99, 4.0, 5.5, 8.0, 20.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", S.normal_tail(F.col("z")).alias("p")).collect()
    for r in got:
        assert math.isclose(r.p, 0.5 * math.erfc(r.z / math.sqrt(2)), rel_tol=1e-9), r


def test_auroc_of_the_mirror_is_the_rest(spark):
    rng = np.random.default_rng(5)
    rows = [("h", i, int(rng.integers(0, 2)), float(np.round(rng.uniform(), 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "head string, row_id long, y int, p double")
    up = E.eval_auroc(E.score_table(df)).first().auroc
    down = E.eval_auroc(E.score_table(df.withColumn("p", 1 - F.col("p")))).first().auroc
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert math.isclose(up, want, rel_tol=1e-12) and math.isclose(up + down, 1, rel_tol=1e-9)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([("h", 1, 0, 0.2), ("h", 2, 0, 0.9)], "head string, row_id long, y int, p double")
    t = E.score_table(df)
    assert E.eval_auroc(t).first().auroc == 0 and E.eval_auprc(t).first().auprc == 0
    assert E.eval_threshold_max_f1(t).first().threshold == 0.5
    assert E.eval_f1_at(df).first().f1 == 0
    assert E.eval_f1_best(df).count() == 0


def test_a_score_of_one_is_in_no_reliability_bin(spark):
    df = spark.createDataFrame([("h", 1, 1, 1.0), ("h", 2, 0, 0.3), ("h", 3, 1, 0.0)], "head string, row_id long, y int, p double")
    got = {r.bin: r.n for r in E.calib_reliability(df).collect()}
    assert got == {int(np.digitize(0.3, np.linspace(0, 1, 11))) - 1: 1, 0: 1}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    groups = {"a": np.round(rng.normal(0, 50, 301), 1), "b": np.array([3.0]), "c": np.array([-2.0, -2.0, 5.0, 1e9])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    q = {"q1": 0.25, "q2": 0.5, "q9": 0.9}
    for r in C.exact_quantiles(df, ["g"], "v", q).collect():
        assert r.n == len(groups[r.g])
        for name, p in q.items():
            assert math.isclose(r[name], np.quantile(groups[r.g], p), rel_tol=1e-9, abs_tol=1e-12)


def test_values_in_a_narrow_range_spread_over_buckets(spark):
    df = spark.range(20000).select(F.lit("g").alias("g"), (F.col("id") / 2e7 + 1e6).alias("v"), F.lit(1).alias("m"))
    sizes = [r["count"] for r in C.value_buckets(df, ["g"], "v").groupBy("_q").count().collect()]
    assert sum(sizes) == 20000 and max(sizes) < 400
    got = C.exact_quantiles(df.drop("m"), ["g"], "v", {"half": 0.5}).first()
    assert math.isclose(got.half, 1e6 + 19999 / 4e7, rel_tol=1e-15)


def test_top_rows_beyond_the_group_limit(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), "id", (F.col("id") * 7919 % 1000).alias("s"))
    want = sorted(((-(i * 7919 % 1000), i) for i in range(5000)))[:1500]
    got = {r["rank"]: r["id"] for r in win_topn_per_group(df, ["g"], "s", 1500, ["id"]).collect()}
    assert got == {n + 1: i for n, (_, i) in enumerate(want)}


def test_hashed_places_number_each_group(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).alias("hot"), F.md5(F.col("id").cast("string")).alias("h"))
    got = C.hashed_places(df, ["hot"], "h", "id").collect()
    for flag in (True, False):
        want = [r.id for r in sorted((r for r in got if r.hot == flag), key=lambda r: r.h)]
        assert [r.id for r in sorted((r for r in got if r.hot == flag), key=lambda r: r.place)] == want
        assert sorted(r.place for r in got if r.hot == flag) == list(range(len(want)))


def test_score_buckets_rise_with_the_score(spark):
    v = sorted({0.0, 1.0, 0.5, 1e-300, 5e-324, 1 - 2 ** -53, 1 - 1e-9} | set(np.random.default_rng(7).uniform(0, 1, 300)))
    got = [r.b for r in spark.createDataFrame([(float(x),) for x in v], "x double").coalesce(1).orderBy("x").select(
        C.unit_bucket("x").alias("b")).collect()]
    assert got == sorted(got)
