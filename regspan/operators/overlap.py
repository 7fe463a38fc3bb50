"""Set difference of footprints and annotations, and roll-ups per annotated element."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

SITE = ["cell_id", "chrom", "fp_start", "fp_end"]


def set_union_sources(*overlaps: DataFrame) -> DataFrame:
    """Distinct footprint coordinates over the overlap sets of a cell."""
    parts = [o.select(*SITE) for o in overlaps]
    return reduce(DataFrame.unionByName, parts).distinct()


def join_anti_coords(footprints: DataFrame, overlapped: DataFrame) -> DataFrame:
    """Footprint rows whose exact coordinates are in no overlap set of the same cell; all columns stay."""
    return footprints.join(overlapped.select(*SITE).distinct(), SITE, "left_anti")


def set_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).distinct().join(b.select(*key), key, "left_anti")


def agg_uncharacterized_stats(footprints: DataFrame, overlapped: DataFrame) -> DataFrame:
    """Distinct bound, overlapped and uncharacterized sites per cell and, with ``cell_id`` NULL, per group."""
    sites = footprints.select("grp", *SITE).distinct()
    mark = overlapped.select(*SITE).distinct().withColumn("hit", F.lit(1))
    per_cell = sites.join(mark, SITE, "left").groupBy("grp", "cell_id").agg(
        F.count("*").alias("n_bound"), F.count("hit").alias("n_overlapped"))
    return per_cell.rollup("grp", "cell_id").agg(
        F.sum("n_bound").alias("n_bound"), F.sum("n_overlapped").alias("n_overlapped"),
        F.sum(F.col("n_bound") - F.col("n_overlapped")).alias("n_uncharacterized"),
        F.grouping("cell_id").cast("int").alias("is_total"),
    ).where("grp IS NOT NULL")


def _names(col) -> F.Column:
    return F.array_join(F.sort_array(F.collect_set(col)), ";")


def agg_overlap_gene(overlaps: DataFrame, gene: list[str]) -> DataFrame:
    """Per cell and gene: overlap rows and the sorted distinct ``TF(strand)``.

    ``gene`` names the gene columns. Distinct TFs are bounded by the motif
    vocabulary, so the set in one row stays small.
    """
    label = F.concat("tf_motif", F.lit("("), "fp_strand", F.lit(")"))
    return overlaps.groupBy("cell_id", *gene).agg(F.count("*").alias("n_overlaps"), _names(label).alias("tfs"))


def agg_overlap_regulome(overlaps: DataFrame) -> DataFrame:
    """Per cell, region and class: overlap rows and distinct motifs."""
    return overlaps.groupBy("cell_id", "chrom", "ann_start", "ann_end", "ann_class").agg(
        F.count("*").alias("num_overlaps"),
        F.array_join(F.sort_array(F.collect_set("tf_motif")), ",").alias("tfs"))


def agg_overlap_enhancer(overlaps: DataFrame, order: str) -> DataFrame:
    """Per cell and enhancer: gene symbols, first cell line and distance, distinct (TF, strand).

    "First" is by ``order``, then by cell line and distance; both come from the same row. Rows of one enhancer need
    not be adjacent.
    """
    first = F.min_by(F.struct("cell_line", "distance"), F.struct(order, "cell_line", "distance"))
    tf = F.concat("tf_motif", F.lit("/"), "fp_strand")
    return overlaps.groupBy("cell_id", "chrom", "ann_start", "ann_end").agg(
        _names("gene_symbol").alias("gene_symbols"), first.alias("first"), _names(tf).alias("tfs")).select(
        "cell_id", "chrom", "ann_start", "ann_end", "gene_symbols", "first.cell_line", "first.distance", "tfs")
