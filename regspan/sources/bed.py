"""Text scans. Everything is read as text, cast with try_cast, and bad rows are dropped."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from regspan.functions.coords import number, whole

# ---- fixed values: positions in the headerless 17-column layout ----
BED_COLUMNS = ["chrom", "fp_start", "fp_end", "tf_motif", "motif_score", "strand", "peak_chrom", "peak_start",
               "peak_end", "peak_id", "x10", "x11", "x12", "x13", "x14", "x15", "fp_score"]
# ---- end of fixed values ----


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def scan_bed(spark: SparkSession, path: str | list[str], extra: int = 0) -> DataFrame:
    """Footprints from headerless tab files, one file per cell.

    Short lines and lines without numeric coordinates are dropped; comment
    lines are skipped. ``extra`` counts reference columns after the 17th.
    """
    names = BED_COLUMNS + [f"ref{i}" for i in range(extra)]
    raw = (spark.read.schema(_text_schema(names)).option("sep", "\t").option("comment", "#")
           .option("mode", "PERMISSIVE").csv(path))
    keep = [c for c in names if not c.startswith("x1")]
    ints = {"fp_start", "fp_end", "peak_start", "peak_end"}
    dbl = {"motif_score", "fp_score"}
    cast = [whole(c).alias(c) if c in ints else number(c).alias(c) if c in dbl else F.col(c) for c in keep]
    needed = ["chrom", "fp_start", "fp_end", "peak_start", "peak_end"]
    return raw.select(*cast, F.input_file_name().alias("path")).dropna(subset=needed)


def csv_layouts(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files by their header line, found by one job over all paths (files or folders); empty files have none.

    One row a file reaches the driver, which held the list of paths before.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"))
    layouts: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():
        layouts.setdefault(r["header"].removeprefix("\ufeff"), []).append(unquote(r["file"]))
    return layouts


def scan_csv_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files of several layouts as text, lined up by column name; missing columns are NULL.

    Files are grouped by their header, and each layout is one read: the plan grows with the layouts, not with the files.
    """
    parts = []
    for header, files in csv_layouts(spark, paths).items():
        schema = _text_schema(next(csv.reader([header])))
        parts.append(spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(files))
    if not parts:
        raise ValueError("no file has a header")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def path_columns(path: str | Column = "path") -> dict[str, Column]:
    """Group, subtype, cell and sample held in ``<grp>_sorted_.../<subtype>/<cell>.<ext>``."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    cell = F.when(F.instr(stem, "_BD_") > 1, F.substring_index(stem, "_BD_", 1)).otherwise(stem)
    bits = F.split(stem, "_")
    sample = F.when((F.element_at(bits, 1) == "MM") & (F.size(bits) >= 2), F.concat_ws("_", F.slice(bits, 1, 2))
                    ).otherwise(F.element_at(bits, 1))
    return {
        "grp": F.substring_index(F.element_at(parts, -3), "_sorted_", 1),
        "subtype": F.element_at(parts, -2),
        "cell": cell,
        "sample": sample,
    }


def scan_path_columns(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumns(path_columns(path))


def scan_gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene rows of a GTF; coordinates stay one-based."""
    names = ["chrom", "origin", "feature", "start", "stop", "score", "strand", "frame", "attrs"]
    raw = spark.read.schema(_text_schema(names)).option("sep", "\t").option("comment", "#").option(
        "quote", "").csv(path)
    return gtf_gene_rows(raw)


def gtf_gene_rows(raw: DataFrame) -> DataFrame:
    attr = lambda name: F.nullif(F.regexp_extract("attrs", f'{name} "([^"]+)"', 1), F.lit(""))
    g = raw.where(F.col("feature") == "gene").select(
        "chrom", whole("start").alias("gene_start"), whole("stop").alias("gene_end"), "strand",
        F.substring_index(attr("gene_id"), ".", 1).alias("gene_id"), F.coalesce(attr("gene_name"), F.lit("NA")).alias("gene_name"),
        F.coalesce(attr("gene_type"), F.lit("NA")).alias("gene_type"))
    tss = F.when(F.col("strand") == "+", F.col("gene_start")).otherwise(F.col("gene_end"))
    return g.dropna(subset=["gene_start", "gene_end"]).withColumn("tss", tss)
