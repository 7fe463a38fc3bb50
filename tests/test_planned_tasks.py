"""Steps whose number of tasks follows the input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from regspan.operators import intervals as I, joint as J, presence as P, rna as N


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(600).select(
        F.lit("ALL").alias("grp"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("subtype"),
        (F.col("id") % 50).alias("cell_id"), F.concat(F.lit("chr"), (F.col("id") % 7).cast("string")).alias("chrom"),
        (F.col("id") % 11 * 700).alias("r_start"), (F.col("id") % 11 * 700 + 300).alias("r_end"))
    return d


def _same(a, b):
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.select(*a.columns).collect()))


def test_presence_stays_in_the_planned_tasks(rows):
    sizes = P.group_sizes(rows)
    tags = rows.select("chrom", "r_start", "r_end", F.lit("enhancer").alias("tag")).distinct()
    planned = P.agg_presence_counts(rows, sizes, tags, 5)
    assert planned.rdd.getNumPartitions() == 5
    assert P.agg_pct_metrics(planned, sizes).rdd.getNumPartitions() == 5
    _same(P.agg_pct_metrics(P.agg_presence_counts(rows, sizes, tags), sizes), P.agg_pct_metrics(planned, sizes))


def test_master_and_loci_stay_in_the_planned_tasks(rows):
    sizes = P.group_sizes(rows)
    p = rows.withColumnsRenamed({"r_start": "peak_start", "r_end": "peak_end"}).select(
        "*", F.lit(0.7).alias("p_enhancer"), F.lit(0.2).alias("p_silencer"), F.lit(2).alias("n_tfs"), F.lit("enhancer").alias("category"))
    loci = J.agg_bin_consensus(p, sizes, tasks=5)
    novel = J.agg_novel_merge(loci, sizes, "sum", 1, tasks=5)
    assert loci.rdd.getNumPartitions() == 5 and novel.rdd.getNumPartitions() == 5
    _same(J.agg_novel_merge(J.agg_bin_consensus(p, sizes), sizes, "sum", 1).drop("mean_p_enhancer", "mean_p_silencer", "pct"), novel)
    counts = novel.withColumn("basket", F.lit("novel")).localCheckpoint()
    master = J.joint_master(counts, sizes, 5)
    assert master.rdd.getNumPartitions() == 5
    _same(J.joint_master(counts, sizes).drop("mean_pct"), master)


def test_interval_joins_by_planned_tasks(rows):
    left = rows.select("chrom", "r_start", "r_end").distinct()
    right = left.select("chrom", (F.col("r_start") + 100).alias("a"), (F.col("r_end") + 500).alias("b"))
    planned = I.join_interval(left, right, ("r_start", "r_end"), ("a", "b"), tasks=5)
    assert planned.rdd.getNumPartitions() == 5
    _same(I.join_interval(left, right, ("r_start", "r_end"), ("a", "b")), planned)
    met = I.join_interval_exists(left, right, ("r_start", "r_end"), ("a", "b"), tasks=5)
    assert met.rdd.getNumPartitions() == 5
    _same(I.join_interval_exists(left, right, ("r_start", "r_end"), ("a", "b")), met)


def test_bin_class_stays_in_the_planned_tasks(rows, spark):
    rows = rows.withColumn("grp", F.concat(F.lit("G"), (F.col("cell_id") % 2).cast("string")))
    p = rows.withColumnsRenamed({"r_start": "peak_start", "r_end": "peak_end"}).withColumn("category", F.lit("enhancer"))
    master = rows.where("r_start % 1400 = 0").select(
        "grp", "chrom", "r_start", "r_end", F.lit("known").alias("basket"))
    plain = J.join_bin_class(p, master)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        planned = J.join_bin_class(p, master, tasks=11)
        assert planned.rdd.getNumPartitions() == 11
        _same(plain, planned)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_contrast_and_genes_stay_in_the_planned_tasks(rows, spark):
    joint = rows.select("grp", "chrom", "r_start", "r_end", "subtype", (F.col("cell_id") + 30.0).alias("pct"),
                        F.concat(F.lit("b"), (F.col("r_start") % 3).cast("string")).alias("basket"),
                        F.concat(F.lit("c"), (F.col("r_start") % 2).cast("string")).alias("region_class")).distinct()
    genes = spark.range(40).select(
        F.concat(F.lit("chr"), (F.col("id") % 7).cast("string")).alias("chrom"), (F.col("id") * 150).alias("gene_start"),
        (F.col("id") * 150 + 400).alias("gene_end"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("gene_name"),
        F.lit("+").alias("strand"), F.when(F.col("id") % 2 == 0, "protein_coding").otherwise("lncRNA").alias("gene_type"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        side = N.region_side_stats(joint, ["s0"], ["s1", "s2"], tasks=11)
        assert side.rdd.getNumPartitions() == 11
        _same(N.region_side_stats(joint, ["s0"], ["s1", "s2"]), side)
        planned = N.annotate_regions(side, genes, 11)
        assert planned.rdd.getNumPartitions() == 11
        _same(N.annotate_regions(side, genes), planned)
        assert I.join_nearest_tss(side.withColumn("mid", F.col("r_start")), genes, tasks=11).rdd.getNumPartitions() == 11
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
