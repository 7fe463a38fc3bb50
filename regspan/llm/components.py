"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regspan.session import durable


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _own_rows(least: DataFrame) -> DataFrame:
    """Deal the minima out again, so that their join with a much linked node's edges can be split among tasks."""
    return least.repartition(F.xxhash64("u"))


def _large_star(edges: DataFrame) -> DataFrame:
    # AQE splits a skewed join when both sides come straight from a shuffle
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(_own_rows(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.where("v < u").join(_own_rows(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint); root is the smallest node it reaches.

    Each round is written to the shared folder, which cuts lineage. Rounds needed grow with
    the logarithm of a component's size; not converging within ``rounds`` is an error, never a
    partial result. Self-links and repeated links are allowed, nulls are not. Nodes without an
    edge are absent.
    """
    now = durable(_small_star(edges))
    seen = _digest(now)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        now = durable(_small_star(_large_star(now)))
        new = _digest(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
