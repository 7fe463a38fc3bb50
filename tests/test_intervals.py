import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from regspan.operators import intervals as I, scale as C

span = st.tuples(st.sampled_from(["chr1", "chr2"]), st.integers(0, 6000), st.integers(1, 5000)).map(
    lambda t: (t[0], t[1], t[1] + t[2]))
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frames(spark, left, right):
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i long, chrom string, s long, e long")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], "j long, chrom string, rs long, re long")
    return a, b


@few
@given(st.lists(span, min_size=1, max_size=12), st.lists(span, min_size=1, max_size=12), st.sampled_from([7, 1024, 10 ** 6]))
def test_binned_join_is_the_theta_join(spark, left, right, width):
    a, b = frames(spark, left, right)
    got = {(r.i, r.j) for r in I.join_interval(a, b, ("s", "e"), ("rs", "re"), bin_size=width).collect()}
    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]}
    assert got == want
    rows = I.join_interval(a, b, ("s", "e"), ("rs", "re"), bin_size=width, closed=True).select("i", "j").collect()
    closed = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right)
              if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted((r.i, r.j) for r in rows) == closed  # each pair once


@few
@given(st.lists(span, min_size=1, max_size=12), st.lists(span, min_size=1, max_size=12))
def test_semi_and_anti_split_all_rows(spark, left, right):
    a, b = frames(spark, left, right)
    semi = {r.i for r in I.join_interval_exists(a, b, ("s", "e"), ("rs", "re"), bin_size=100).collect()}
    anti = {r.i for r in I.join_interval_exists(a, b, ("s", "e"), ("rs", "re"), bin_size=100, keep="left_anti").collect()}
    want = {i for i, x in enumerate(left) if any(x[0] == y[0] and y[1] <= x[2] and y[2] > x[1] for y in right)}
    assert semi == want
    assert anti == set(range(len(left))) - want


def test_touching_start_counts_as_met(spark):
    a, b = frames(spark, [("chr1", 0, 1024)], [("chr1", 1024, 1030)])
    assert I.join_interval_exists(a, b, ("s", "e"), ("rs", "re")).count() == 1
    assert I.join_interval(a, b, ("s", "e"), ("rs", "re")).count() == 0


def test_hot_locus_of_equal_rows(spark):
    a = spark.range(5000, numPartitions=8).select(F.lit("chr1").alias("chrom"), F.lit(10).alias("s"), F.lit(20).alias("e"))
    _, b = frames(spark, [("chr1", 0, 1)], [("chr1", 15, 16), ("chr1", 18, 400_000)])
    assert I.join_interval(a, b, ("s", "e"), ("rs", "re")).count() == 10_000


@pytest.fixture(scope="module")
def genes(spark):
    rows = [("chr1", 100, 900, "-", "A", "protein_coding"), ("chr1", 500, 800, "+", "B", "protein_coding"),
            ("chr1", 2000, 2500, "+", "C", "lncRNA"), ("chr2", 50, 60, "+", "D", "lncRNA")]
    return spark.createDataFrame(rows, "chrom string, gene_start long, gene_end long, strand string, gene_name string, gene_type string")


def test_nearest_tss(spark, genes):
    mids = [("chr1", 0), ("chr1", 500), ("chr1", 700), ("chr1", 701), ("chr1", 1450), ("chr1", 1451), ("chr1", 10 ** 9),
            ("chr2", 55), ("chr9", 1)]
    pts = spark.createDataFrame(mids, "chrom string, mid long")
    got = {(r.chrom, r.mid): (r.nearest_gene, r.dist_to_tss, r.pc_nearest_gene, r.pc_dist_to_tss)
           for r in I.join_nearest_tss(pts, genes).collect()}
    assert got[("chr1", 700)] == ("B", 200, "B", 200)      # halfway: the lower TSS
    assert got[("chr1", 701)] == ("A", -199, "A", -199)
    assert got[("chr1", 1450)] == ("A", 550, "A", 550)
    assert got[("chr1", 1451)] == ("C", -549, "A", 551)
    assert got[("chr1", 10 ** 9)] == ("C", 10 ** 9 - 2000, "A", 10 ** 9 - 900)
    assert got[("chr2", 55)] == ("D", 5, None, None)
    assert got[("chr9", 1)] == (None, None, None, None)
    assert len(got) == len(mids)


def test_gene_body_prefers_protein_coding(spark, genes):
    more = genes.union(spark.createDataFrame([("chr1", 1, 5000, "+", "L", "lncRNA")], genes.schema))
    pts = spark.createDataFrame([("chr1", 600), ("chr1", 2100), ("chr1", 900), ("chr2", 61)], "chrom string, mid long")
    got = {(r.chrom, r.mid): r.within_gene for r in I.join_gene_body(pts, more).collect()}
    assert got == {("chr1", 600): "B", ("chr1", 2100): "L", ("chr1", 900): "A", ("chr2", 61): None}


def test_locus_tie_goes_to_the_gene_that_starts_first(spark, genes):
    loci = spark.createDataFrame([("x", "chr1", 650, 750), ("y", "chr1", 801, 899), ("z", "chr2", 1, 9)],
                                 "locus string, chrom string, l_start long, l_end long")
    got = {r.locus: (r.genes, r.nearest_gene, r.distance) for r in I.join_locus_genes(loci, genes).collect()}
    assert got == {"x": ("A,B", "A", 200), "y": ("A", "A", 50), "z": ("", None, None)}


@pytest.mark.parametrize("left_levels", [1, I.LEVELS])
def test_chromosome_long_spans(spark, left_levels):
    """Long and short spans on both sides; a span is repeated at most twice per level, however long it is."""
    n = 250_000_000
    left = [("chr1", 0, n), ("chr1", 5, 9), ("chr1", 1023, 1025), ("chr1", n - 1, n), ("chr2", 7, 8), ("chr1", 8_000, 600_000)]
    if left_levels == 1:
        left = left[1:]
    right = [("chr1", 0, n), ("chr1", 8, 2_000_000), ("chr1", 1024, 1030), ("chr2", 0, 7), ("chr1", n - 1, n), ("chr1", 0, 1)]
    a, b = frames(spark, left, right)
    got = sorted((r.i, r.j) for r in I.join_interval(a, b, ("s", "e"), ("rs", "re"), left_levels=left_levels).collect())
    assert got == sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    met = {r.i for r in I.join_interval_exists(a, b, ("s", "e"), ("rs", "re"), left_levels=left_levels).collect()}
    assert met == {i for i, x in enumerate(left) if any(x[0] == y[0] and y[1] <= x[2] and y[2] > x[1] for y in right)}
    spots = I._nested(a, b, (F.col("s"), F.col("e") - 1), (F.col("rs"), F.col("re") - 1), I.BIN, left_levels)
    assert spots[1].groupBy("j").count().agg(F.max("count")).first()[0] <= 2 * I.LEVELS
    if left_levels > 1:
        assert spots[0].groupBy("i").count().agg(F.max("count")).first()[0] <= 4 * I.LEVELS


def test_only_hot_bins_are_spread(spark):
    a = spark.range(4000, numPartitions=4).select(F.lit("chr1").alias("chrom"), F.when(F.col("id") % 2 == 0, F.col("id") % 900).otherwise(F.col("id") * 5000).alias("s"))
    a = a.withColumn("e", F.col("s") + 5)
    _, b = frames(spark, [("chr1", 0, 1)], [("chr1", 0, 910)] + [("chr1", 5000 * k, 5000 * k + 9) for k in range(1, 4000)])
    left, right = I._nested(a, b, (F.col("s"), F.col("e") - 1), (F.col("rs"), F.col("re") - 1), I.BIN, 1)
    key = ["chrom", "_key", "_bin"]
    left, right = C.spread_keys(left, right, key, 100)
    hot = left.groupBy(*key, "_salt").count().where("_bin = 0").collect()
    assert len(hot) == 20 and max(r["count"] for r in hot) < 250
    copies = {r["_bin"]: r["count"] for r in right.groupBy(*key).count().collect()}
    assert copies.pop(0) == 20 and set(copies.values()) == {1}
    assert I.join_interval(a, b, ("s", "e"), ("rs", "re"), hot_rows=100).count() == 4000
    assert C.salted_join(a, b.select("chrom", "j"), ["chrom"], rows=300).count() == 4000 * 4000


def test_equal_points_keep_their_rows(spark, genes):
    pts = spark.createDataFrame([("chr1", 600, 1), ("chr1", 600, 1), ("chr9", 5, 1), (None, 5, 1)], "chrom string, mid long, x int")
    got = sorted((str(r.chrom), r.within_gene) for r in I.join_gene_body(pts, genes).collect())
    assert got == [("None", None), ("chr1", "B"), ("chr1", "B"), ("chr9", None)]
