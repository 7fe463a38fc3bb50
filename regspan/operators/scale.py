"""Shapes that keep hot keys, prefix sums and small lookups distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regspan.session import durable

# A dimension is broadcast only when it is seen to hold no more rows than this.
BROADCAST_ROWS = 20_000
#: Rows of one join key that a task takes; a key with more of them is spread over several.
HOT_ROWS = 1 << 18
#: Rows that a task of a planned shuffle takes; what a task holds in hash maps then does not grow with the input.
TASK_ROWS = 1 << 18


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it proves small; otherwise leave the join to Catalyst.

    At most ``max_rows + 1`` rows reach the driver. The small copy also stops
    the dimension from being recomputed by every plan that uses it.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema))


def tasks_for(rows: int, task_rows: int = TASK_ROWS) -> int:
    """Tasks that ``rows`` rows are dealt over."""
    return max(1, -(-rows // task_rows))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over ``tasks`` tasks, which adaptive execution leaves as they are; unchanged where one or none is asked for."""
    return df.repartition(tasks, *keys) if tasks and tasks > 1 else df


def each_of(df: DataFrame, names: DataFrame, col: str) -> DataFrame:
    """Every row once per value of a vocabulary, nulls left out, as an explode of one array that an aggregate gathers.

    The array holds the vocabulary of a dimension (motifs, categories), so it is short beside the rows; no size takes
    another way, and nothing runs while the plan is built.
    """
    words = names.where(F.col(col).isNotNull()).agg(F.sort_array(F.collect_set(col)).alias("words")).scalar()
    return df.withColumn("_words", words).withColumn(col, F.explode("_words")).drop("_words")


def hot_keys(big: DataFrame, on: Sequence[str], rows: int = HOT_ROWS, tasks: int | None = None) -> DataFrame:
    """The keys with more than ``rows`` rows, and over how many tasks (``_salts``) each is to be spread.

    At most one key per ``rows`` rows of ``big``, so the result is small whatever the data. ``tasks`` deals the keys over
    that many tasks while they are counted.
    """
    n = dealt(big.select(*on), tasks, *on).groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    return n.select(*on, F.ceil(F.col("_n") / F.lit(rows)).cast("int").alias("_salts"))


def spread_keys(big: DataFrame, small: DataFrame, on: Sequence[str], rows: int = HOT_ROWS,
                spread: Sequence[str] | None = None, tasks: int | None = None,
                seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: rows of a hot key of ``big`` are dealt over as many salts as it needs, and only the rows
    of ``small`` with that key are repeated. Keys that are not hot have salt 0 on both sides. ``tasks`` deals both sides
    by key and salt over that many tasks (Spark's own if None). Keys are counted in ``big``, or in ``seen`` if given: other
    counts make other salts, never other pairs."""
    hot = F.broadcast(hot_keys(big if seen is None else seen, on, rows, tasks))
    # the partition id spreads exact copies of one row too
    mix = F.xxhash64(*(spread or big.columns), F.spark_partition_id())
    salts = F.coalesce("_salts", F.lit(1))
    left = big.join(hot, list(on), "left").withColumn("_salt", F.pmod(mix, salts).cast("int")).drop("_salts")
    right = small.join(hot, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt(left, tasks, *on, "_salt"), dealt(right, tasks, *on, "_salt")


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                rows: int = HOT_ROWS, spread: Sequence[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Equi-join where one key of ``big`` may hold a large share of its rows.

    A histogram of the keys plans the salts: a hot key is spread in proportion to its rows, other keys join as they are.
    ``tasks`` as in ``spread_keys``.
    """
    left, right = spread_keys(big, small, on, rows, spread, tasks)
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def running_totals(df: DataFrame, by: Sequence[str], order: str, bucket: Column,
                   values: Sequence[str]) -> DataFrame:
    """Inclusive running sums of ``values`` in ``order`` without one global window.

    ``df`` holds one row per (by, order); ``bucket`` must never fall as ``order``
    rises. Sums run inside each bucket, and bucket totals (few rows) carry the
    offset. Adds ``cum_<v>`` and ``all_<v>``.
    """
    by = list(by)
    d = df.withColumn("_b", bucket)
    inside = W.partitionBy(*by, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    totals = d.groupBy(*by, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    totals = totals.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_t_{v}").over(whole).alias(f"all_{v}") for v in values],
    )
    d = d.select("*", *[F.sum(v).over(inside).alias(f"_c_{v}") for v in values])
    joined = d.join(totals, [*by, "_b"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_c_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values],
        *[F.col(f"all_{v}") for v in values],
    )


def unit_bucket(x: str | Column) -> Column:
    """Buckets of a value in [0, 1] that rise with it.

    Each halving of the distance to 0, and above one half to 1, is cut into 64
    steps. Even scores that crowd towards 0 or 1 spread over many buckets.
    """
    c = F.col(x) if isinstance(x, str) else x
    end = F.lit(64 * 1100)
    low = F.greatest(F.floor(F.log2(c) * 64), -end)
    high = F.least(F.floor(-F.log2(F.lit(1.0) - c) * 64), end)
    return F.when(c <= 0, -end).when(c >= 1, end).when(c <= 0.5, low).otherwise(high).cast("int")


#: Buckets that the distinct values of a group are cut into.
VALUE_BUCKETS = 256


def value_buckets(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``_q``, a bucket of ``value`` that rises with it within ``by``.

    Borders are approximate quantiles of the rows of each group, so values that crowd into a narrow range spread as well
    as others. They steer the work only; what is computed from the buckets stays exact.
    """
    share = F.array(*[F.lit(i / VALUE_BUCKETS) for i in range(1, VALUE_BUCKETS)])
    borders = df.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), share, F.lit(4 * VALUE_BUCKETS)).alias("_borders"))
    below = F.size(F.filter("_borders", lambda border: border < F.col(value)))
    return salted_join(df, borders, by, spread=[value]).withColumn("_q", below).drop("_borders")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, from distinct values and running counts.

    ``points`` maps column names to probabilities. NULL values do not count. No
    task holds all values of a group.
    """
    by = list(by)
    d = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("m"))
    t = running_totals(value_buckets(d, by, value), by, value, F.col("_q"), ["m"])
    v = F.col(value).cast("double")

    def quantile(p: float) -> Column:
        at = (F.max("all_m") - 1) * p
        # values at the two whole positions around ``at``; positions are found per row
        lo = F.min(F.when(F.col("cum_m") > F.floor((F.col("all_m") - 1) * p), v))
        hi = F.min(F.when(F.col("cum_m") > F.ceil((F.col("all_m") - 1) * p), v))
        return lo + (hi - lo) * (at - F.floor(at))

    return t.groupBy(*by).agg(F.max("all_m").alias("n"), F.min(v).alias("smallest"), F.max(v).alias("largest"),
                              *[quantile(p).alias(name) for name, p in points.items()])


def numbered_names(names: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Distinct names in order, numbered from 0 by range buckets and their offsets; no task holds all of them.

    The buckets are written once, so that the numbers stay what they are however often they are read.
    """
    one = names.select(col).where(F.col(col).isNotNull()).distinct()
    dealt = durable(one.repartitionByRange(col).sortWithinPartitions(col).select(
        col, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    size = dealt.groupBy("_part").agg(F.count("*").alias("_m"), F.min("_row").alias("_first"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a bucket
    shift = size.select("_part", (F.coalesce(F.sum("_m").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(shift, "_part").select(col, (F.col("_row") + F.col("_shift")).alias(out))


def hashed_places(df: DataFrame, by: Sequence[str], mix: str, *tie: str, bucket: Column | None = None) -> DataFrame:
    """Zero-based ``place`` of each row in the order of a digest, within ``by``.

    Rows are numbered inside buckets of the digest and bucket totals carry the offset, so one group is never numbered
    by a single task. Without a ``bucket`` (which must never fall as the digest rises) the first two hex digits serve.
    """
    by = list(by)
    d = df.withColumn("_b", F.substring(mix, 1, 2) if bucket is None else bucket)
    size = d.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    size = size.select(*by, "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(W.partitionBy(*by, "_b").orderBy(mix, *tie)) - 1
    return d.withColumn("_r", inside).join(size, [*by, "_b"]).select(
        *df.columns, (F.col("_r") + F.col("_o")).alias("place"))
