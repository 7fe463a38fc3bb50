"""Steps that put their rows through as few shuffles as they can, since shuffle files stay on disk until a query ends."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from regspan.operators import corpus as K, intervals as I, sets as S, training as L
from regspan.plans import corpus_queries, eval_queries, registry  # noqa: F401
from regspan.plans.fixtures import Fixtures
from regspan.session import SHUFFLE_CLEANUP, durable


def _same(a, b):
    assert Counter(map(str, a.collect())) == Counter(map(str, b.select(*a.columns).collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def fx(spark, tmp_path_factory):
    """Small tables with repeated and null keys."""
    at = str(tmp_path_factory.mktemp("tables"))
    put = lambda df, name: df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    key = lambda c, n: F.when(F.col("id") % 41 != 7, F.col("id") % n).alias(c)
    put(spark.range(25).selectExpr("id n_nationkey", "id % 5 n_regionkey", "concat('N', id) n_name"), "nation")
    put(spark.range(60).select(key("c_custkey", 55), key("c_nationkey", 25), F.lit("BUILDING").alias("c_mktsegment"), F.concat(F.lit("c"), "id").alias(
        "c_name"), (F.col("id") * 170.0).alias("c_acctbal")), "customer")
    put(spark.range(300).select(key("o_orderkey", 290), key("o_custkey", 70), F.element_at(F.split(F.lit(
        "1-URGENT,2-HIGH,3-MEDIUM,4-NOT SPECIFIED,5-LOW"), ","), (F.col("id") % 5 + 1).cast("int")).alias("o_orderpriority")), "orders")
    put(spark.range(900).select(
        key("l_orderkey", 310), key("l_partkey", 80), key("l_suppkey", 13), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        key("l_quantity", 50), (F.col("id") % 11 / 100).alias("l_discount"), F.lit(0.01).alias("l_tax"), F.lit("F").alias("l_linestatus"),
        F.lit("R").alias("l_returnflag")).withColumn("l_quantity", F.col("l_quantity").cast("double")), "lineitem")
    return Fixtures(spark, at)


def test_lines_dealt_once_give_the_same_footprints(fx):
    assert fx.footprints.count() > 500
    _same(fx.footprints, fx.footprints_by_order)


def test_footprints_meet_annotations_and_genes_in_one_join(fx):
    f = fx.footprints
    ann = f.join(fx.annotations, "chrom").where("fp_start < ann_end AND ann_start < fp_end")
    gene = f.join(fx.genes, "chrom").where("fp_start < gene_end AND gene_start - 1 < fp_end")
    got = fx.peak_labels()
    assert got.count() == ann.count() + gene.count() > 0
    assert got.where("label = 'genic'").count() == gene.count()
    plan = _plan(got)
    assert sum("lineitem.parquet" in x for x in plan.splitlines() if "FileScan" in x) <= 3  # once for the rows, twice as one plan of salts


def test_salts_planned_from_other_rows_change_no_pair(spark):
    a = spark.range(3000).select(F.lit("chr1").alias("chrom"), (F.col("id") % 900).alias("s"), (F.col("id") % 900 + 5).alias("e"))
    b = spark.range(50).select(F.lit("chr1").alias("chrom"), (F.col("id") * 20).alias("rs"), (F.col("id") * 20 + 9).alias("re"))
    join = lambda **k: I.join_interval(a, b, ("s", "e"), ("rs", "re"), hot_rows=100, **k)
    assert join().count() > 0
    _same(join(), join(seen=a.select("chrom", "s", "e")))
    _same(join(), join(seen=a.select("chrom", "s", "e").limit(1)))


def test_a_peak_is_grouped_in_one_shuffle(spark):
    rows = [("chr1", 1, 2, f"TF{i % 3}" if i % 4 else None, float(i) if i % 5 else None, None, ["genic", "TFBS", None][i % 3]) for i in range(40)]
    rows += [("chr2", 1, 2, None, None, None, "genic"), (None, 1, 2, "TF1", 1.0, 0.5, "genic")]
    df = spark.createDataFrame(rows, "chrom string, peak_start long, peak_end long, tf_motif string, motif_score double, "
                                     "fp_score double, label string").repartition(4)
    c = K.agg_peak_corpus(df)
    assert _plan(c).count("Exchange") == _plan(df).count("Exchange") + 1
    got = {r.chrom: r for r in c.collect()}
    scores = [r[4] for r in rows if r[0] == "chr1" and r[4] is not None]
    assert got["chr1"].all_labels == ["TFBS", "genic"] and got["chr1"].primary_label == "TFBS" and got["chr1"].n_tfs == 3
    assert got["chr1"].mean_motif_score == pytest.approx(sum(scores) / len(scores)) and got["chr1"].max_motif_score == max(scores)
    assert got["chr2"].n_tfs == 0 and got["chr2"].mean_motif_score is None and got[None].mean_fp_score == 0.5
    tfs = {r.chrom: r.tfs for r in K.join_tf_lookup(c.select(*K.PEAK), df).collect()}
    assert tfs["chr1"] == ["TF0", "TF1", "TF2"] and tfs["chr2"] == []
    assert _plan(K.join_tf_lookup(spark.createDataFrame([("chr1", 1, 2)], "chrom string, peak_start long, peak_end long"), df)).count(
        "HashAggregate") == 2  # no second grouping for distinct TFs


@pytest.mark.parametrize("name", ["sample_balanced", "dataset_info", "agg_tf_enrichment"])
def test_rows_that_are_read_twice_are_a_stage(fx, name):
    assert "lineitem.parquet" not in _plan(registry.QUERIES[name](fx))


def test_peaks_for_training_are_a_stage(fx):
    assert "lineitem.parquet" not in _plan(eval_queries._labelled_peaks(fx))


def test_words_of_a_small_vocabulary_stay_with_their_row(spark, monkeypatch):
    peaks = spark.createDataFrame([(1, ["b", "a", "a"]), (2, []), (3, None), (4, ["c", "b"])], "id int, tfs array<string>")
    by_join = {r.id: r.features for r in L.feat_tf_vector(peaks).collect()}
    monkeypatch.setattr(L, "salted_join", None)
    assert {r.id: r.features for r in L.feat_tf_vector(peaks).collect()} == by_join
    monkeypatch.undo()
    monkeypatch.setattr(L, "checked_broadcast", lambda df: df)
    assert {r.id: r.features for r in L.feat_tf_vector(peaks).collect()} == by_join
    assert by_join[1].indices.tolist() == [0, 1] and by_join[3].indices.tolist() == []


def _shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if "shuffle" in str(blocks.apply(i))}


def test_a_written_stage_leaves_no_shuffle_files(spark):
    df = spark.range(5000, numPartitions=4).selectExpr("id % 700 k").repartition(3, "k").groupBy("k").count()
    before, setting = _shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    stage = durable(df)
    assert _shuffle_files(spark) <= before
    assert stage.count() == df.count() == durable(df).count() == 700
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_cells_of_regions_travel_in_the_smallest_types(spark):
    frame = lambda cells, n: spark.createDataFrame([("t", c, n, "r") for c in cells], "subtype string, cell_id long, n long, region string")
    assert S._narrow(frame([-128, 127], 127)) == ("tinyint", "tinyint")
    assert S._narrow(frame([-129, 32767], 32767)) == ("smallint", "smallint")
    assert S._narrow(frame([-5, 32768], 32768)) == ("int", "int")
    assert S._narrow(frame([-(1 << 31) - 1, 1], 1 << 31)) == ("bigint", "bigint")
    assert S._narrow(frame([], 1)) == ("bigint", "bigint")
    assert S._narrow(frame([1], 200).withColumn("cell_id", F.lit("c"))) == ("string", "smallint")


@pytest.mark.parametrize("far", [0, 1 << 20, 1 << 40])
def test_jaccard_of_narrow_and_wide_cell_numbers(spark, far):
    held = {far * (c % 2) + c: {(c * k) % 17 for k in range(1, 6)} for c in range(30)}
    rows = [("t", c, "chr1", r, r + 1) for c, m in held.items() for r in m] * 2 + [("t", None, "chr1", 1, 2), (None, 3, "chr1", 1, 2)]
    df = spark.createDataFrame(rows, "subtype string, cell_id long, chrom string, r_start long, r_end long")
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and held[a] & held[b]}
    for got in (S.sim_jaccard_cells(df, tasks=3), S.sim_jaccard_cells(df, direct_cells=6), S.sim_jaccard_cells(df.where("subtype = 't'"), by=None)):
        assert dict(got.dtypes)["cell_a"] == dict(got.dtypes)["cell_b"] == "bigint"
        assert {(r.cell_a, r.cell_b): r.n_shared for r in got.collect()} == want and got.count() == len(want)


def test_cells_are_dealt_once(spark, monkeypatch):
    stages = []
    monkeypatch.setattr(S, "durable", lambda df: stages.append(_plan(df)) or durable(df))
    df = spark.createDataFrame([("t", c, "chr1", c % 3, c % 3 + 1) for c in range(9)], "subtype string, cell_id long, chrom string, r_start long, r_end long")
    for by in ("subtype", None):
        S.sim_jaccard_cells(df, by=by, tasks=3).count()
    assert len(stages) == 2 and all(x.count("Exchange") == 2 and x.count("REPARTITION") == 2 for x in stages)  # the same one on both sides
