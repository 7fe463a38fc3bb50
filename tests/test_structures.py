"""Bitmaps, dictionaries, pieces, layouts and prefix joins against plain versions."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspan.operators import corpus as K, itemsets as M, presence as P, scale as C, sequence as G, sets as S, tf as T, training as L
from regspan.plans.fixtures import Fixtures
from regspan.sources import bed as B


@pytest.mark.parametrize("kind", ["long", "string"])
def test_presence_by_bitmaps_counts_distinct_cells(spark, kind):
    rng = random.Random(5)
    cells = [rng.randrange(-10 ** 12, 10 ** 12) if i % 3 else i * 32_768 for i in range(300)]
    name = {c: c if kind == "long" else f"cell{c}" for c in cells}
    rows = [("g", f"s{c % 3}", name[c], "chr1", 10 * rng.randrange(4), 99, rng.choice("ab")) for c in rng.choices(cells, k=4000)]
    df = spark.createDataFrame(rows, f"grp string, subtype string, cell_id {kind}, chrom string, r_start long, r_end long, tag string")
    sizes = P.group_sizes(df.select("grp", "subtype", "cell_id"))
    want = {}
    for _, s, c, _, at, _, tag in rows:
        want.setdefault((s, at), set()).add(c)
    tags = {at: ";".join(sorted({r[6] for r in rows if r[4] == at})) for at in {r[4] for r in rows}}
    got = P.agg_presence_counts(df, sizes).collect()
    assert {(r.subtype, r.r_start): r.cnt for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        assert r.global_count == sum(len(v) for (_, at), v in want.items() if at == r.r_start) and r.region_type == tags[r.r_start]
    region_tags = spark.createDataFrame([("chr1", 0, 99, "x"), ("chr1", 0, 99, "w")], "chrom string, r_start long, r_end long, tag string")
    named = {r.r_start: r.region_type for r in P.agg_presence_counts(df.drop("tag"), sizes, region_tags).collect()}
    assert named == {0: "w;x", 10: "uncharacterized", 20: "uncharacterized", 30: "uncharacterized"}


def test_presence_words_are_numbers_and_dealt(spark):
    """A bitmap of 4 KB per region, subtype and bucket was sorted in one task where few cells share a region."""
    rows = [("g", "s", c, "chr1", r, r + 1) for c, r in [(-1, 0), (-64, 0), (-65, 0), (0, 0), (63, 0), (64, 0), (63, 0), (5, 1), (None, 1), (None, 2)]]
    df = spark.createDataFrame(rows, "grp string, subtype string, cell_id long, chrom string, r_start long, r_end long")
    sizes, tags = P.group_sizes(df), df.selectExpr("chrom", "r_start", "r_end", "'t' tag")
    for tasks in (None, 3):
        assert P.presence_bitmaps(df, tasks=tasks).schema["bits"].dataType.simpleString() == "bigint"
        got = {r.r_start: (r.cnt, r.global_count, r.region_type) for r in P.agg_presence_counts(df, sizes, tags, tasks).collect()}
        assert got == {0: (6, 6, "t"), 1: (1, 1, "t"), 2: (0, 0, "t")}


def test_footprints_are_dealt_by_their_number(spark, tmp_path):
    """Tasks grow with the rows of lineitem, so that the maps of one task do not."""
    cells = [(c, c % 5, "AB"[c % 2]) for c in range(40)]
    spark.createDataFrame(cells, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(n, n % 3, f"N{n}") for n in range(5)], "n_nationkey int, n_regionkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(o, o % 40) for o in range(100)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(i % 100, i % 30, i % 9, i % 7, 1.0, 0.1 * (i % 9), 0.01 * (i % 5), "R", "F") for i in range(600)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    one, many = Fixtures(spark, str(tmp_path)), Fixtures(spark, str(tmp_path))
    assert one.tasks == 1 and C.tasks_for(600, 100) == 6 and C.tasks_for(0) == 1
    many.tasks = 37
    plan = many.predictions._jdf.queryExecution().toString()
    assert "37), REPARTITION_BY_NUM" in plan
    assert sorted(many.predictions.collect()) == sorted(one.predictions.collect())


def test_prefix_join_is_the_whole_table_above_the_least_percent(spark):
    rng = random.Random(2)
    base = [rng.sample(range(200), 30) for _ in range(12)]
    held = {}
    for c in range(60):
        mine = set(rng.choice(base))
        for _ in range(rng.randint(0, 25)):
            mine.discard(rng.choice(sorted(mine))) if mine and rng.random() < 0.5 else mine.add(rng.randrange(200))
        held[c] = mine | {999}  # a region that every cell holds
    df = spark.createDataFrame([("t" if c % 2 else "u", c, "chr1", r, r + 1) for c, m in held.items() for r in m] * 2,
                               "subtype string, cell_id long, chrom string, r_start long, r_end long")
    for least in (12.5, 50, 100):
        want = {(a, b): 100 * len(held[a] & held[b]) / len(held[a] | held[b]) for a, b in combinations(held, 2) if (a - b) % 2 == 0}
        want = {k: v for k, v in want.items() if v >= least}
        got = {(r.cell_a, r.cell_b): r.jaccard_pct for r in S.sim_jaccard_cells_least(df, least).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    with pytest.raises(ValueError):
        S.sim_jaccard_cells_least(df, 0)


def test_cells_that_share_few_regions_meet_by_region(spark, monkeypatch):
    """Every row went to every block of cells, and every pair with a shared region was compared whole."""
    rng = random.Random(3)
    held = {f"c{c}": {(c + 7 * i) % 997 for i in range(rng.randint(1, 20))} | ({5000} if c % 2 else set()) for c in range(150)}
    rows = [("ALL", c, "chr1", r, r + 1) for c, m in held.items() for r in m] + [("ALL", None, "chr1", 5000, 5001)]
    df = spark.createDataFrame(rows, "subtype string, cell_id string, chrom string, r_start long, r_end long")
    want = {(a, b): len(held[a] & held[b]) for a, b in combinations(sorted(held), 2) if held[a] & held[b]}
    pct = {(a, b): 100 * n / len(held[a] | held[b]) for (a, b), n in want.items()}
    monkeypatch.setattr(S, "TASK_PAIRS", 2000)
    got = S.sim_jaccard_cells(df, "subtype", 16, 64, 20).collect()  # one region by blocks
    assert {(r.cell_a, r.cell_b): r.n_shared for r in got} == want and len(got) == len(want)
    assert all(math.isclose(r.jaccard_pct, pct[r.cell_a, r.cell_b]) for r in got)
    got = {(r.cell_a, r.cell_b) for r in S.sim_jaccard_cells_least(df, 20, "subtype", 20).collect()}
    assert got == {k for k, v in pct.items() if v >= 20}
    monkeypatch.setattr(S, "_pairs_by_blocks", None)  # not asked for where no region has many cells
    assert S.sim_jaccard_cells(df).count() == len(want)
    sets = S._ordered_sets(S._held(df, "subtype"))
    met = S._met_cells(sets, 0.6).count()
    assert sum(v >= 60 for v in pct.values()) <= met < len(want) / 2


def test_kmers_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(G, "PIECE", 50)
    rng = random.Random(1)
    texts = {f"k{i}": "".join(rng.choices("ACGTNacé", k=n)) for i, n in enumerate([0, 3, 5, 6, 49, 50, 51, 54, 55, 500, 1234])}
    df = spark.createDataFrame(list(texts.items()) + [("k9", texts["k9"]), ("none", None)], "k string, s string")
    for k in (1, 6, 11):
        want = {}
        for name, t in texts.items():
            bases = "".join(c if c in "ACGT" else "A" for c in t)
            for kmer, n in Counter(bases[i:i + k] for i in range(len(bases) - k + 1)).items():
                want[name, kmer] = n / (len(bases) - k + 1) * (2 if name == "k9" else 1)  # rows of one key add up
        got = {(r.k, r.kmer): r.freq for r in G.seq_kmer(df, ["k"], "s", k).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x]) for x in want)
    assert G.kmer_codes(b"ACGT", 2).tolist() == [1, 6, 11] and G.kmer_names(np.array([1, 6, 11]), 2).to_pylist() == ["AC", "CG", "GT"]


@pytest.mark.parametrize("size", [1, 60, 700])
def test_tiles_of_lines_are_tiles_of_the_text(spark, size):
    texts = [("a", "ACGTN" * 1000), ("b", "ACG"), ("c", "T" * 1024), ("d", "G" * 1537)]
    genome = spark.createDataFrame(texts, "chrom string, seq string")
    rows = lambda d: {(r.chrom, r.tile): (r.chrom_len, r.piece) for r in d.collect()}
    want = rows(G.tile_genome(genome, 512, 512))
    assert want["a", 3] == (5000, texts[0][1][1536:2560]) and want["b", 0] == (3, "ACG")
    pieces = G.genome_pieces(genome, size)
    assert pieces.agg(F.max(F.length("piece"))).first()[0] <= size
    got = rows(G.tile_pieces(pieces, 512, 512))
    assert {k: v for k, v in want.items() if v[1]} == {k: v for k, v in got.items() if v[1]}


def test_null_of_the_bimodality_coefficient(spark):
    null = {r.n: r.null for r in T.unimodal_null(spark.createDataFrame([(40,), (40,), (3000,)], "n long"), 120).collect()}
    assert set(null) == {40, 3000} and all(len(v) == 120 and v == sorted(v) for v in null.values())
    again = {r.n: r.null for r in T.unimodal_null(spark.createDataFrame([(3000,)], "n long"), 120).collect()}
    assert again[3000] == null[3000]
    assert abs(np.mean(null[3000]) - 5 / 9) < 0.01 and np.std(null[40]) > np.std(null[3000])
    rng = np.random.default_rng(0)
    rows = [("g", "s", i, f"TF{j}", float(v)) for i in range(200) for j, v in enumerate(rng.uniform(1, 2, 6))]
    rows += [("g", "s", i, "TWO", 9.0 if i % 2 else 0.5) for i in range(200)]  # first or last in every nucleus
    got = {r.tf: r for r in T.screen_bimodal(spark.createDataFrame(rows, "grp string, subtype string, nucleus long, tf string, pct double"), draws=199).collect()}
    assert got["TWO"].p_value == 1 / 200 and got["TWO"].bimodal and got["TWO"].fdr < 0.05
    assert all(0 < r.p_value <= 1 and r.fdr >= r.p_value - 1e-12 for r in got.values())


def test_csv_union_plans_by_layout(spark, tmp_path):
    for i in range(500):
        a, b = ("x,y", f"{i},a{i}") if i % 2 else ('y,"x z"', f"b{i},{i}")
        (tmp_path / f"file {i:03}.csv").write_text(f"{a}\n{b}\n")
    (tmp_path / "empty.csv").write_text("")
    assert sorted(len(v) for v in B.csv_layouts(spark, [str(tmp_path)]).values()) == [250, 250]
    df = B.scan_csv_union(spark, [str(tmp_path)])
    assert sorted(df.columns) == ["x", "x z", "y"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    got = {(r.x, r["x z"], r.y) for r in df.collect()}
    assert got == {(str(i), None, f"a{i}") if i % 2 else (None, str(i), f"b{i}") for i in range(500)}


def test_fifty_thousand_words_become_vector_places(spark):
    n = 50_000
    peaks = spark.range(n // 10).select("id", F.transform(F.sequence(F.col("id") * 10, F.col("id") * 10 + 9), lambda x: F.format_string("TF%06d", x)).alias("tfs"))
    more = spark.createDataFrame([(-1, ["TF000007", "TF049999", "TF000007"]), (-2, []), (-3, None)], "id long, tfs array<string>")
    got = {r.id: r.features for r in L.feat_tf_vector(peaks.union(more)).where("id < 3").collect()}
    assert got[0].size == n and got[2].indices.tolist() == list(range(20, 30)) and set(got[2].values.tolist()) == {1.0}
    assert got[-1].indices.tolist() == [7, 49_999] and got[-2].numNonzeros() == 0 and got[-3].size == n
    names = K.vocabulary(peaks.select(F.explode("tfs").alias("tf")), "tf").orderBy("idx").collect()
    assert [r.idx for r in names] == list(range(n)) and [r.name for r in names] == sorted(r.name for r in names)
    assert C.numbered_names(spark.createDataFrame([], "x string"), "x").count() == 0


def test_itemsets_of_a_hundred_tfs(spark):
    rng = np.random.default_rng(8)
    n, k = 150, 100
    bound = rng.uniform(0, 1, (n, k)) < rng.uniform(0.5, 0.9, k)
    bound[:, 0] |= ~bound.any(axis=1)
    rows = [("g", "s", i, f"T{j:03}", 5.0 if bound[i, j] else 0.0) for i in range(n) for j in range(k)]
    df = spark.createDataFrame(rows, "grp string, subtype string, nucleus long, tf string, pct double")
    zero = ~bound
    least = max(10, round(n * 0.02))
    keep = [j for j in range(k) if 0.05 <= zero[:, j].mean() <= 0.95]
    assert len(keep) > 70
    want = Counter()
    for size in (1, 2):
        for c in combinations(keep, size):
            m = int(zero[:, list(c)].all(axis=1).sum())
            if m >= least:
                want[frozenset(f"T{j:03}" for j in c)] = m
    got = {frozenset(r.tfs.split(" + ")): r.support_count for r in M.fim_cozero(df, 100).where("size < 3").collect()}
    assert got == dict(want)
    matrix = {frozenset((r.tf_i, r.tf_j)): r.cozero_pct for r in M.fim_pair_matrix(df, 100).collect()}
    assert len(matrix) == len(keep) * (len(keep) + 1) // 2
    assert all(math.isclose(matrix[c], 100 * m / n) for c, m in want.items())
