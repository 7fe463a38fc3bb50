"""Presence counts that grow as cell files arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

KEY = ["subtype", "chrom", "r_start", "r_end"]


def _cells_before(spark: SparkSession, table: str, batch_id: int) -> DataFrame | None:
    """The cells that earlier batches wrote down, if there are any."""
    try:
        seen = spark.read.parquet(f"{table}/cells")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return seen.where(F.col("batch") < batch_id)


def write_delta(batch: DataFrame, batch_id: int, table: str) -> None:
    """Counts of one batch of cells, one row per (subtype, region), and the cells themselves.

    A batch overwrites its own folder, so running it again after a failure changes nothing. Counts add up because a
    cell arrives in one file, hence in one batch; a cell that an earlier batch holds is an error and nothing is written.
    """
    rows = batch.select("subtype", "cell_id", "chrom", "r_start", "r_end").distinct().persist()
    try:
        cells = rows.select("subtype", "cell_id").distinct()
        before = _cells_before(batch.sparkSession, table, batch_id)
        again = before and cells.join(before, ["subtype", "cell_id"], "left_semi").first()
        if again:
            raise ValueError(f"cell {again['cell_id']} of {again['subtype']} arrived in an earlier batch")
        counts = rows.where("chrom IS NOT NULL").groupBy(*KEY).agg(F.count("*").alias("cnt"))
        counts.write.mode("overwrite").parquet(f"{table}/counts/batch={batch_id}")
        cells.write.mode("overwrite").parquet(f"{table}/cells/batch={batch_id}")
    finally:
        rows.unpersist()


def incr_new_cells(spark: SparkSession, source: str, schema: T.StructType, table: str, checkpoint: str,
                   files_per_batch: int = 1000) -> None:
    """Process every cell file not seen before, once, and stop."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (files.writeStream.foreachBatch(lambda batch, batch_id: write_delta(batch, batch_id, table))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def read_counts(spark: SparkSession, table: str) -> DataFrame:
    """Counts over all batches, with the percent of the cells seen so far."""
    c = spark.read.parquet(f"{table}/counts").groupBy(*KEY).agg(F.sum("cnt").alias("cnt"))
    n = spark.read.parquet(f"{table}/cells").groupBy("subtype").agg(F.count("*").alias("n_cells"))
    return c.join(n, "subtype").withColumn("pct", F.col("cnt") * 100.0 / F.col("n_cells"))
