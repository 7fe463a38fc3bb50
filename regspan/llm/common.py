"""Small helpers that every operator of this folder shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows handed to Python at once. Texts may be long, so batches hold few of them.
BATCH_ROWS = 256
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of one Arrow batch for this session; it never raises a smaller setting."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= rows:
        spark.conf.set(BATCH_SETTING, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id gives null."""
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def held_out(id_col: Column, divisor: int, value: int) -> Column:
    """True for rows that no label may be learned from; a null id is not held out (it has no label either)."""
    return F.coalesce(remainder(id_col, divisor) == value, F.lit(False))


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_slices(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows; the session's batch size stays as it is."""

    def run(batches):
        yield from fn(b.slice(lo, rows) for b in batches for lo in range(0, b.num_rows, rows))

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the last one is the intercept) of a ridge logistic fit by Newton steps until they stand still."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty * len(a) + 1e-9 * np.eye(len(w)),
                               a.T @ (y - p) - len(a) * (penalty @ w))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(labels: DataFrame, id_col: str, label: str, divisor: int, left_out: int, rows: int) -> dict:
    """At most ``rows`` labels {id: 0 or 1} from rows that may be learned from.

    Ids are drawn by hash, so the sample does not depend on row order. An id with two
    different labels counts as 1. Null ids and null labels are not used.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(
        "id IS NOT NULL AND y IS NOT NULL").where(remainder(F.col("id"), divisor) != left_out)
    one = known.groupBy("id").agg(F.max("y").alias("y"))
    got = one.orderBy(F.xxhash64("id"), "id").limit(rows).toPandas()
    return dict(zip(got["id"].tolist(), (got["y"] > 0).astype(int).tolist(), strict=True))
