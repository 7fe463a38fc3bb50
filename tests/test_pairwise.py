"""Weighted contingency tables and what is read from them, against plain loops over regions and pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspan.operators import joint as J, pairwise as T
from tests.test_statistics import bh, fisher

GROUPS = {"g": {"s1": 40, "s2": 55, "s3": 30, "s4": 3}, "h": {"x": 25, "y": 25}, "one": {"z": 9}}


@pytest.fixture(scope="module")
def plain(spark):
    """Counts as rows and, per (grp, a, b), its regions with (ca, cb, p, fdr)."""
    rng, rows, cells = random.Random(4), [], []
    for g, subs in GROUPS.items():
        cells += [(g, s, f"{g}{s}{i}") for s, n in subs.items() for i in range(n)]
        for r in range(60):
            strong = rng.random() < 0.15
            held = {s: rng.randint(0, n) if strong else rng.choice([0, 0, 1, 2]) for s, n in subs.items()}
            held[rng.choice(sorted(held))] = 1
            rows += [(g, f"chr{r % 3}", 100 * r, 100 * r + 50, "enh", s, c) for s, c in held.items() if c]
    counts = spark.createDataFrame(rows, "grp string, chrom string, r_start long, r_end long, region_type string, subtype string, cnt long")
    sizes = spark.createDataFrame([(g, s, n, i + 1, len(subs)) for g, subs in GROUPS.items() for i, (s, n) in enumerate(sorted(subs.items()))],
                                  "grp string, subtype string, n_cells long, ord int, n_subtypes long")
    at = {}
    for g, c, lo, hi, _, s, n in rows:
        at.setdefault((g, c, lo, hi), {})[s] = n
    tests = {}
    for g, subs in GROUPS.items():
        names = sorted(subs)
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                regions = [(k, m.get(a, 0), m.get(b, 0)) for k, m in at.items() if k[0] == g]
                p = [fisher(ca, subs[a], cb, subs[b]) for _, ca, cb in regions]
                tests[g, a, b] = [(k, ca, cb, x, y) for (k, ca, cb), x, y in zip(regions, p, bh(p))]
    return counts.repartition(3), sizes, at, tests


def test_contingency_counts_every_region_once(plain):
    counts, sizes, _, tests = plain
    held = T.member_counts(counts, T.REGION)
    got = {(r.grp, r.a, r.b, r.ca, r.cb): r.m for r in T.contingency(held, sizes).collect()}
    want = Counter((*pair, ca, cb) for pair, rows in tests.items() for _, ca, cb, _, _ in rows)
    assert got == dict(want)
    some = {(r.grp, r.a, r.b, r.ca, r.cb): r.m for r in T.contingency(held, sizes, zeros=False).collect()}
    assert some == {k: m for k, m in want.items() if k[3] + k[4]}
    assert T.contingency(held.limit(0), sizes).count() == 0


def test_rows_tables_and_minima_agree_with_loops(plain):
    counts, sizes, at, tests = plain
    tables = T.fisher_pair_tables(counts, sizes).cache()
    rows = T.test_fisher_pairs(counts, sizes).collect()
    want = {(*k, a, b): (ca, cb, p, f) for (_, a, b), found in tests.items() for k, ca, cb, p, f in found}
    assert len(rows) == len(want)
    for r in rows:
        ca, cb, p, f = want[r.grp, r.chrom, r.r_start, r.r_end, r.a, r.b]
        assert (r.ca, r.cb) == (ca, cb) and math.isclose(r.p_value, p, rel_tol=1e-8) and math.isclose(r.fdr, f, rel_tol=1e-8)
    least = {}
    for key, (_, _, _, f) in want.items():
        least[key[:4]] = min(f, least.get(key[:4], 1.0))
    got = {(r.grp, r.chrom, r.r_start, r.r_end): r.min_fdr for r in T.agg_min_fdr(counts, tables).collect()}
    assert set(got) == set(at)
    assert all(math.isclose(v, least.get(k, 1.0), rel_tol=1e-8) for k, v in got.items())
    assert sum(v < 0.05 for v in got.values()) > 5
    union = {(r.grp, r.chrom, r.r_start, r.r_end) for r in T.sig_region_union(counts, tables).collect()}
    assert union == {k for k, v in least.items() if v < 0.05}
    summary = {(r.grp, r.a, r.b): r for r in T.agg_pair_summary(tables).collect()}
    for pair, found in tests.items():
        assert summary[pair].total_regions == len(found) and summary[pair].sig_005 == sum(f < 0.05 for *_, f in found)
    histogram = Counter()
    for found in tests.values():
        for k, *_, f in found:
            histogram[k[0], min(int(f * 50), 49)] += 1
    assert {(r.grp, r.bin): r.n for r in T.agg_fdr_histogram(tables).collect()} == dict(histogram)


@pytest.mark.parametrize("n", [1, 4, 70])
def test_points_are_the_first_of_all_rows(plain, n):
    counts, sizes, _, tests = plain
    tables = T.fisher_pair_tables(counts, sizes)
    got = {}
    for r in T.agg_pair_points(counts, sizes, tables, n, places=9).collect():
        got.setdefault((r.grp, r.a, r.b), []).append((r["rank"], r.chrom, r.r_start, r.r_end))
    for pair, found in tests.items():
        order = sorted((-round(-math.log10(f), 9) + 0.0, k[1:]) for k, _, _, _, f in found)[:n]
        assert sorted(got[pair]) == [(i + 1, *k) for i, (_, k) in enumerate(order)], pair


def test_no_pair_rows_in_plans_of_weighted_results(plain):
    counts, sizes, _, _ = plain
    held = T.member_counts(counts, T.REGION)
    plan = T.contingency(held, sizes)._jdf.queryExecution().optimizedPlan().toString()
    assert "r_start" not in plan  # regions are summed before they meet the roster of pairs


def test_novel_tables_weigh_the_rows(plain):
    counts, sizes, _, tests = plain
    novel = counts.withColumn("region_class", F.lit("novel|enhancer"))
    rows = J.test_fisher_novel(novel, sizes)
    tables = J.fisher_novel_tables(novel, sizes)
    key = ["grp", "a", "b", "ca", "cb"]
    got = {tuple(r[:5]): (r.n, r.fdr) for r in rows.groupBy(*key).agg(F.count("*").alias("n"), F.first("fdr").alias("fdr")).collect()}
    assert got == {(r.grp, r.a, r.b, r.ca, r.cb): (r.m, r.fdr) for r in tables.collect()}
    for pair, found in tests.items():
        some = [x for x in found if x[1] + x[2]]
        for (_, ca, cb, _, _), f in zip(some, bh([x[3] for x in some])):
            assert np.isclose(got[(*pair, ca, cb)][1], f, rtol=1e-8)
