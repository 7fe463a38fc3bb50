"""Named sets of elements: membership, exact intersections, parents and majorities; Jaccard between cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from regspan.operators.presence import SPAN
from regspan.operators.scale import checked_broadcast, dealt, salted_join, tasks_for
from regspan.session import durable


def set_membership(members: DataFrame, set_names: list[str], element: str = "element", name: str = "set") -> DataFrame:
    """Element x set table of 0 and 1 with the number of sets."""
    has = [F.max(F.when(F.col(name) == s, 1).otherwise(0)).alias(s) for s in set_names]
    return members.groupBy(element).agg(*has, F.count_distinct(name).alias("n_sets"))


def set_unique(members: DataFrame, element: str = "element", name: str = "set") -> DataFrame:
    """Elements that belong to exactly one set."""
    return members.groupBy(element).agg(F.count_distinct(name).alias("n"), F.min(name).alias("unique_to")).where(
        "n = 1").drop("n")


def set_intersections(members: DataFrame, element: str = "element", name: str = "set") -> DataFrame:
    """Exact membership pattern, its degree, size and elements.

    Elements of one pattern are named in one row, so ``members`` must be a
    vocabulary (TF names), not regions.
    """
    pat = members.groupBy(element).agg(F.array_join(F.sort_array(F.collect_set(name)), " & ").alias("sets"),
                                       F.count_distinct(name).alias("degree"))
    return pat.groupBy("sets", "degree").agg(F.count("*").alias("n_elements"),
                                             F.array_join(F.sort_array(F.collect_list(element)), ", ").alias("elements"))


def set_node_aggregate(members: DataFrame, parents: DataFrame, element: str = "element", name: str = "set") -> DataFrame:
    """Sets rolled up to their parent; ``parents`` has set and node."""
    return members.join(checked_broadcast(parents), name).select("node", element).distinct()


def set_majority(flags: DataFrame, rosters: DataFrame, element: str = "tf") -> DataFrame:
    """Elements flagged in a majority of the subtypes of a group; one flag is enough for a single subtype.

    ``flags`` has grp, subtype and element; ``rosters`` has grp and subtype.
    """
    n = rosters.groupBy("grp").agg(F.count_distinct("subtype").alias("k"))
    c = flags.groupBy("grp", element).agg(F.count_distinct("subtype").alias("n_flagged"))
    need = F.when(F.col("k") == 1, 1).otherwise(F.expr("(k + 1) div 2"))
    return c.join(checked_broadcast(n), "grp").where(F.col("n_flagged") >= need).drop("k")


#: A region with up to so many cells gives its pairs directly; the pairs of cells that one task counts.
DIRECT_CELLS, TASK_PAIRS = 4096, 1 << 21


def _shared_in_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Shared regions of every pair of cells in one block pair and one shard of regions."""
    cells, first, ci = np.unique(pdf["cell_id"].to_numpy(), return_index=True, return_inverse=True)
    _, ri = np.unique(pdf["region"].to_numpy(), return_inverse=True)
    size = pdf["n"].to_numpy()[first]
    block = np.zeros(len(cells), dtype=np.int64)
    block[ci] = pdf["block"].to_numpy()
    x = np.zeros((len(cells), ri.max() + 1), dtype=np.float32)
    x[ci, ri] = 1.0
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    shared = x[left] @ x[right].T
    a, b = np.nonzero(shared)
    keep = left[a] < right[b] if lo == hi else np.ones(len(a), dtype=bool)
    a, b, n = left[a[keep]], right[b[keep]], shared[a[keep], b[keep]]
    return pd.DataFrame({"subtype": pdf["subtype"].iloc[0], "x": cells[a], "nx": size[a], "y": cells[b], "ny": size[b], "k": n.astype("int64")})


def _pairs_by_blocks(held: DataFrame, block_cells: int, shard_regions: int) -> DataFrame:
    """Pairs of cells over regions that very many cells hold, as rows of ``_pairs_by_regions`` with one other cell each.

    Cells are cut into blocks and regions into shards: each task multiplies two small blocks and hands on counts per pair
    of cells, never per region. The number of shards follows the rows of a block, not of the subtype, so a task stays
    near ``2 * block_cells`` cells times ``2 * shard_regions`` regions and more cells give more pairs of blocks only.
    """
    size = held.groupBy("subtype", "cell_id").agg(F.count("*").alias("n_regions"))
    plan = size.groupBy("subtype").agg(
        F.ceil(F.count("*") / block_cells).alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.sum("n_regions") / F.ceil(F.count("*") / block_cells) / shard_regions)).alias("shards"))
    d = held.join(checked_broadcast(plan), "subtype").withColumns({
        "block": F.pmod(F.xxhash64("cell_id"), F.col("blocks")),
        "shard": F.pmod(F.xxhash64("region"), F.col("shards"))})
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    d = d.withColumn("other", other).select("subtype", "cell_id", "n", "region", "block", "shard",
                                            F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    kind = held.schema["cell_id"].dataType.simpleString()
    part = d.groupBy("subtype", "lo", "hi", "shard").applyInPandas(
        _shared_in_block, f"subtype string, x {kind}, nx bigint, y {kind}, ny bigint, k bigint")
    x, y = F.struct(F.col("x").alias("c"), F.col("nx").alias("n")), F.struct(F.col("y").alias("c"), F.col("ny").alias("n"))
    pair = part.select("subtype", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "k")
    return pair.select("subtype", F.col("a.c").alias("cell_a"), F.col("a.n").alias("na"), F.array("b.c").alias("cells"),
                       F.array("b.n").alias("sizes"), "k")


def _pairs_by_regions(held: DataFrame) -> DataFrame:
    """(subtype, cell_a, na, cells, sizes, k): per region and cell, the later cells of the region, as plain arrays."""
    one = held.groupBy("subtype", "region").agg(F.sort_array(F.collect_list(F.struct("cell_id", "n"))).alias("e")).where("size(e) > 1")
    each = one.select("subtype", F.col("e.cell_id").alias("c"), F.col("e.n").alias("s"), F.posexplode("e").alias("at", "a")).where("at + 1 < size(c)")
    later = lambda c: F.slice(c, F.col("at") + 2, F.size(c))
    return each.select("subtype", F.col("a.cell_id").alias("cell_a"), F.col("a.n").alias("na"), later("c").alias("cells"),
                       later("s").alias("sizes"), F.lit(1).cast("bigint").alias("k"))


def _narrow(held: DataFrame) -> tuple[str, str]:
    """The smallest types that hold every cell number and every ``n``: an array takes as many bytes a member as its type has.
    Cells that are no numbers keep their type."""
    kind = held.schema["cell_id"].dataType.simpleString()
    numbers = kind in ("bigint", "int", "smallint", "tinyint")
    cells = [F.min("cell_id"), F.max("cell_id")] if numbers else [F.lit(None), F.lit(None)]
    low, high, most = held.agg(*cells, F.max("n")).first()

    def least(low: int, high: int, own: str) -> str:
        return next((x for x, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)) if -(1 << bits) <= low and high < 1 << bits), own)

    return kind if low is None else least(low, high, kind), "bigint" if most is None else least(0, most, "bigint")


def _shared_counts(held: DataFrame, block_cells: int, shard_regions: int, direct_cells: int, near: Column | None = None) -> DataFrame:
    """(subtype, cell_a, na, cell_b, nb, k): pairs of cells and the number of regions they share, from distinct (subtype, cell_id, n, region).

    ``held`` is read several times. A region with up to ``direct_cells`` cells sends each of its cells one array of the
    later ones, to the task that counts all pairs of that cell; a pair is neither a row of a shuffle nor shuffled again,
    and the number of tasks follows the number of pairs. Arrays hold cells and sizes in the smallest types that fit. Regions with more cells go by blocks. ``near`` (over na, nb)
    drops pairs before they are counted.
    """
    often = held.groupBy("subtype", "region").agg(F.count("*").alias("m"))
    many = often.where(F.col("m") > direct_cells).drop("m")
    m = F.when(F.col("m") <= direct_cells, F.col("m"))
    pairs, n_many = often.agg(F.sum(m * (m - 1) / 2), F.count_if(F.col("m") > direct_cells)).first()
    kind, slim, slim_n = held.schema["cell_id"].dataType.simpleString(), *_narrow(held)
    held = held.withColumns({"cell_id": F.col("cell_id").cast(slim), "n": F.col("n").cast(slim_n)})
    if n_many:
        many = checked_broadcast(many)
        rows = _pairs_by_regions(held.join(many, ["subtype", "region"], "left_anti")).unionByName(
            _pairs_by_blocks(held.join(many, ["subtype", "region"], "left_semi"), block_cells, shard_regions).withColumns(
                {"na": F.col("na").cast(slim_n), "sizes": F.col("sizes").cast(f"array<{slim_n}>")}))
    else:
        rows = _pairs_by_regions(held)
    rows = dealt(rows, tasks_for(int(pairs or 0), TASK_PAIRS), "subtype", "cell_a")
    each = rows.select("subtype", "cell_a", "na", "k", F.explode(F.arrays_zip("cells", "sizes")).alias("b")).select(
        "subtype", "cell_a", F.col("na").cast("bigint").alias("na"), "k", F.col("b.cells").alias("cell_b"),
        F.col("b.sizes").cast("bigint").alias("nb"))
    each = each if near is None else each.where(near)
    # cells get their own type back after the grouping, which is by the columns that rows were dealt by
    counted = each.groupBy("subtype", "cell_a", "cell_b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("k").alias("k"))
    return counted.withColumns({c: F.col(c).cast(kind) for c in ("cell_a", "cell_b")})


def _regions_of_cells(peaks: DataFrame, by: str | None) -> DataFrame:
    """(subtype, cell_id, region); a row without cell or subtype pairs with nothing."""
    return peaks.select((F.col(by) if by else F.lit("ALL")).alias("subtype"), "cell_id", F.concat_ws(":", *SPAN).alias("region")).where(
        "cell_id IS NOT NULL AND subtype IS NOT NULL")


def _held(peaks: DataFrame, by: str | None) -> DataFrame:
    """Distinct (subtype, cell_id, region)."""
    return _regions_of_cells(peaks, by).distinct()


def sim_jaccard_cells(peaks: DataFrame, by: str | None = "subtype", block_cells: int = 256,
                      shard_regions: int = 8192, direct_cells: int = DIRECT_CELLS, tasks: int | None = None) -> DataFrame:
    """Jaccard percent between cells of a subtype (all cells with ``by=None``) that share a region.

    The work follows the pairs that share a region, not the pairs of cells. A region held by very many cells would give
    their square once more each, so regions with more than ``direct_cells`` cells are multiplied block by block
    (``block_cells`` cells, ``shard_regions`` regions). Pairs that share nothing have no row. Rows are dealt by cell, over
    ``tasks`` tasks (Spark's own if None), and find their cell's regions and their number there.
    """
    cell = ["subtype", "cell_id"] if by else ["cell_id"]  # Spark drops a constant from the keys of a join and then deals rows anew
    held = _regions_of_cells(peaks, by)
    held = (held.repartition(tasks, *cell) if tasks else held.repartition(*cell)).distinct()
    sized = durable(held.join(held.groupBy(*cell).agg(F.count("*").alias("n")), cell))
    union = F.col("na") + F.col("nb") - F.col("k")
    return _shared_counts(sized, block_cells, shard_regions, direct_cells).select(
        "subtype", "cell_a", "cell_b", F.col("k").alias("n_shared"), (F.col("k") * 100.0 / union).alias("jaccard_pct"))


def _ordered_sets(held: DataFrame) -> DataFrame:
    """(subtype, cell_id, regions, n): each cell's regions from the rarest in its subtype to the most frequent."""
    often = held.groupBy("subtype", "region").agg(F.count("*").alias("often"))
    ranked = salted_join(held, often, ["subtype", "region"], spread=["cell_id"])
    entry = F.struct("often", "region")
    return ranked.groupBy("subtype", "cell_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["region"]).alias("regions")).withColumn(
        "n", F.size("regions").cast("bigint"))


def _met_cells(sets: DataFrame, t: float, direct_cells: int = DIRECT_CELLS) -> DataFrame:
    """Pairs of ``_ordered_sets`` that can reach the share ``t``, from the regions their prefixes share.

    A region that two sets share outside both prefixes lies behind the prefix that ends first, where the set has only
    ceil(t n) - 1 regions; so the regions shared in the prefixes and the longer of the two rests bound the overlap.
    """
    need = lambda n: F.ceil(F.col(n) * t - 1e-9)
    prefix = sets.select("subtype", "cell_id", "n", F.explode(F.slice("regions", F.lit(1), (F.col("n") - need("n") + 1).cast("int"))).alias("region"))
    near = (F.col("na") >= F.col("nb") * t - 1e-9) & (F.col("nb") >= F.col("na") * t - 1e-9)
    overlap = F.ceil((F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-9)
    shared = _shared_counts(prefix, 256, 8192, direct_cells, near)
    return shared.where(F.col("k") + F.greatest(need("na"), need("nb")) - 1 >= overlap).select("subtype", "cell_a", "cell_b")


def sim_jaccard_cells_least(peaks: DataFrame, least_pct: float, by: str | None = "subtype", direct_cells: int = DIRECT_CELLS) -> DataFrame:
    """Pairs of cells of a subtype with a Jaccard percent of ``least_pct`` or more, exactly.

    With a share t, a set of n regions can only reach another one through its n - ceil(t n) + 1 rarest regions, so cells
    meet on these alone. Sizes must lie within a factor of t, and what two cells share there must leave the overlap that
    t asks for within reach of what is behind it. Only pairs that pass are compared whole.
    """
    t = least_pct / 100.0
    if not 0 < t <= 1:
        raise ValueError("the least percent lies above 0 and at most at 100")
    sets = durable(_ordered_sets(durable(_held(peaks, by))))
    met = durable(_met_cells(sets, t, direct_cells))
    whole = lambda c: sets.select("subtype", F.col("cell_id").alias(f"cell_{c}"), F.col("regions").alias(f"r{c}"))
    both = salted_join(salted_join(met, whole("a"), ["subtype", "cell_a"], spread=["cell_b"]), whole("b"), ["subtype", "cell_b"], spread=["cell_a"])
    shared = F.size(F.array_intersect("ra", "rb")).cast("bigint")
    out = both.select("subtype", "cell_a", "cell_b", shared.alias("n_shared"), (F.size("ra") + F.size("rb")).alias("total"))
    return out.select("subtype", "cell_a", "cell_b", "n_shared", (F.col("n_shared") * 100.0 / (F.col("total") - F.col("n_shared"))).alias(
        "jaccard_pct")).where(F.col("jaccard_pct") >= least_pct)
