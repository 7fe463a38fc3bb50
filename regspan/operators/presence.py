"""How many cells of each subtype hold a region, and what follows from those counts.

Counts stay long: one row per (grp, region, subtype) with at least one cell; an
absent row is a zero. Subtypes are few (tens), so state per region is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from regspan.functions import recode as R
from regspan.functions.coords import log2_ratio, stars
from regspan.operators.scale import checked_broadcast, dealt, salted_join

SPAN = ["chrom", "r_start", "r_end"]
REGION = ["grp", *SPAN]
MIN_CELLS = 10
PSEUDO = 0.1
PSEUDO_FIRST_STAGE = 1.0
#: Ranks up to which Spark limits a window's groups before the shuffle, and hash parts of a group beyond it.
GROUP_LIMIT, PARTS = 1000, 64


def group_sizes(cells: DataFrame) -> DataFrame:
    """Cells per (grp, subtype) from the roster, so cells without regions count too; ``ord`` breaks ties."""
    n = cells.groupBy("grp", "subtype").agg(F.count_distinct("cell_id").alias("n_cells"))
    w = W.partitionBy("grp").orderBy("subtype")
    every = W.partitionBy("grp")
    return checked_broadcast(n.select("*", F.row_number().over(w).alias("ord"),
                                      F.count("*").over(every).alias("n_subtypes")))


def numbered_cells(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_no``, a whole number per cell; other ids than whole numbers are numbered within (grp, subtype)."""
    if isinstance(rows.schema["cell_id"].dataType, T.IntegralType):
        return rows.withColumn("_no", F.col("cell_id").cast("bigint"))
    key = ["grp", "subtype", "cell_id"]
    order = F.row_number().over(W.partitionBy("grp", "subtype").orderBy("cell_id"))
    return rows.join(rows.select(*key).distinct().withColumn("_no", order.cast("bigint")), key)


def presence_bitmaps(rows: DataFrame, *more: Column, tasks: int | None = None) -> DataFrame:
    """The cells that hold a region, as words of 64 bits: one row per (region, subtype, 64 cell numbers with a holder).

    Repeated rows of a cell set the same bit, so nothing is made distinct first. A word is a number, so it is summed in
    hash maps and is never longer than the row it came from, however few cells share a region. ``tasks`` deals the rows
    over that many tasks; one region goes to several. ``grp`` takes no part in that: where it is a constant, Spark drops it
    from the groups and would shuffle once more.
    """
    no = numbered_cells(rows).withColumn("word", F.shiftright("_no", 6))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_no").bitwiseAND(F.lit(63)).cast("int"))
    key = [*REGION, "subtype", "word"]
    return dealt(no, tasks, *key[1:]).groupBy(*key).agg(F.bit_or(bit).alias("bits"), *more)


def agg_presence_counts(source_rows: DataFrame, sizes: DataFrame, region_tags: DataFrame | None = None,
                        tasks: int | None = None) -> DataFrame:
    """Distinct cells per (region, subtype), count over all subtypes, percent, and the union of tags.

    A cell may hold a region in several rows and through several sources; it is counted once. Tags stand in the rows, or
    in ``region_tags`` (chrom, r_start, r_end, tag) where they belong to regions whatever the cell; a region without any
    is then uncharacterized. ``tasks`` is the number of tasks that rows and regions are dealt over (Spark's own if None).
    """
    tags = [F.collect_set("tag").alias("tags")] if region_tags is None else []
    named = [F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags")] if region_tags is None else []
    # by span, so that regions meet their tags without another shuffle
    words = dealt(presence_bitmaps(source_rows, *tags, tasks=tasks), tasks, *SPAN)
    held = F.coalesce(F.bit_count("bits"), F.lit(0)).cast("bigint")
    per = words.groupBy(*REGION, "subtype").agg(F.sum(held).alias("cnt"), *named)
    # subtypes of a region are few: they travel as one short array, and a region is one row
    region = per.groupBy(*REGION).agg(F.collect_list(F.struct("subtype", "cnt")).alias("held"), F.sum("cnt").alias("global_count"), *named)
    if region_tags is not None:
        types = dealt(region_tags, tasks, *SPAN).groupBy(*SPAN).agg(F.collect_set("tag").alias("tags"))
        region = region.join(types, SPAN, "left").withColumn("tags", F.coalesce("tags", F.array(F.lit("uncharacterized"))))
    whole = region.select(*REGION, "global_count", F.array_join(F.sort_array("tags"), ";").alias("region_type"), F.inline("held"))
    return whole.join(sizes.select("grp", "subtype", "n_cells"), ["grp", "subtype"]).withColumn("pct", F.col("cnt") * 100.0 / F.col("n_cells"))


def filter_min_cells(counts: DataFrame, min_cells: int = MIN_CELLS) -> DataFrame:
    return counts.where(F.col("global_count") >= min_cells)


def join_semi_filtered(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Source rows of the regions that survived the census."""
    return rows.join(kept.select(*REGION).distinct(), REGION, "left_semi")


def filter_regulatory_multi(df: DataFrame) -> DataFrame:
    """Drop rows whose simplified type is gene_body; a compound with a lesser class goes too."""
    return df.where(R.recode_simplify_type("region_type") != "gene_body")


def filter_regulatory_single(df: DataFrame) -> DataFrame:
    """Drop rows whose only tag is gene_body."""
    rest = F.array_except(F.split("region_type", ";"), F.array(F.lit("gene_body")))
    return df.where(F.size(rest) > 0)


def agg_presence_sample(peaks: DataFrame) -> DataFrame:
    """Cells per region by subtype, by sample and by both, with the cells that hold any region as total."""
    held = peaks.select("sample", "subtype", "cell_id", *SPAN).distinct()
    fam = [["subtype"], ["sample"], ["sample", "subtype"]]
    label = (F.when(F.grouping("sample") == 1, "subtype").when(F.grouping("subtype") == 1, "sample")
             .otherwise("sample+subtype").alias("family"))
    cnt = held.groupingSets([[*f, *SPAN] for f in fam], "sample", "subtype", *SPAN).agg(
        label, F.count("*").alias("cnt"))
    total = held.select("sample", "subtype", "cell_id").distinct().groupingSets(fam, "sample", "subtype").agg(
        label, F.count("*").alias("n_cells"))
    total = checked_broadcast(total).withColumnsRenamed({"sample": "s", "subtype": "t", "family": "f"})
    same = (F.col("family") == F.col("f")) & F.col("sample").eqNullSafe(F.col("s")) & F.col("subtype").eqNullSafe(
        F.col("t"))
    return cnt.join(total, same).drop("s", "t", "f").withColumn("pct", F.col("cnt") * 100.0 / F.col("n_cells"))


def agg_pct_metrics(counts: DataFrame, sizes: DataFrame, pseudo: float = PSEUDO,
                    key: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Max, min, difference, log2 ratio, leading and exclusive subtype of each region.

    Subtypes without a row are zeros: the minimum is zero as soon as one is
    absent. Equal leaders give the first subtype in order. ``key`` names the
    region columns when there are more than the usual ones. The leader is found
    by sorting; ``tasks`` deals the rows over that many tasks before it.
    """
    k = sizes.select("grp", "subtype", "ord", "n_subtypes")
    d = dealt(counts, tasks, *SPAN).join(k, ["grp", "subtype"])
    key = key or [*REGION, "region_type"]
    m = d.groupBy(*key).agg(
        F.max("pct").alias("max_pct"),
        F.when(F.count("*") < F.max("n_subtypes"), 0.0).otherwise(F.min("pct")).alias("min_pct"),
        (F.sum("pct") / F.max("n_subtypes")).alias("mean_pct"),
        F.max_by("subtype", F.struct("pct", -F.col("ord"))).alias("max_subtype"),
        F.when(F.count_if(F.col("cnt") > 0) == 1, F.max("subtype")).otherwise("").alias("exclusive_subtype"))
    return m.select("*", (F.col("max_pct") - F.col("min_pct")).alias("diff_pct"),
                    log2_ratio(F.col("max_pct"), F.col("min_pct"), pseudo).alias("log2fc"))


def agg_single_group_master(counts: DataFrame) -> DataFrame:
    """Groups with one subtype: its percent stands for the difference, the ratio is zero."""
    return counts.select(
        *REGION, "region_type", "subtype", "cnt", "pct", F.col("pct").alias("max_pct"), F.col("pct").alias("min_pct"),
        F.col("pct").alias("diff_pct"), F.lit(0.0).alias("log2fc"), F.col("subtype").alias("max_subtype"),
        F.col("subtype").alias("exclusive_subtype"))


def agg_type_breakdown(counts: DataFrame) -> DataFrame:
    """Active regions per subtype and raw tag, and per subtype and simplified type."""
    both = F.concat(
        F.transform(F.split("region_type", ";"), lambda tag_name: F.struct(
            F.lit("raw").alias("level"), tag_name.alias("region_class"))),
        F.array(F.struct(F.lit("simple").alias("level"), R.recode_simplify_type("region_type").alias("region_class"))))
    per = counts.where("cnt > 0").groupBy("grp", "subtype", "region_type").agg(F.count("*").alias("n"))
    return per.select("grp", "subtype", F.inline(both), "n").groupBy("grp", "subtype", "level", "region_class").agg(
        F.sum("n").alias("n_regions"))


def agg_exclusive_by_type(metrics: DataFrame) -> DataFrame:
    return metrics.where("exclusive_subtype <> ''").groupBy(
        "grp", F.col("exclusive_subtype").alias("subtype"),
        R.recode_simplify_type("region_type").alias("simple_type")).agg(F.count("*").alias("n_regions"))


def agg_common_high(metrics: DataFrame, min_pct: float = 50.0) -> DataFrame:
    return metrics.where(F.col("min_pct") >= min_pct)


def pattern_counts(members: DataFrame, by: list[str], element: list[str], member: str) -> DataFrame:
    """Distinct membership patterns of elements with the number of elements that share each.

    Members are few, so a pattern is a short array; elements with one pattern
    collapse before any pair is formed.
    """
    pat = members.select(*by, *element, member).distinct().groupBy(*by, *element).agg(
        F.sort_array(F.collect_set(member)).alias("pattern"))
    return pat.groupBy(*by, "pattern").agg(F.count("*").alias("n"))


def member_pairs(patterns: DataFrame, by: list[str], with_self: bool = False) -> DataFrame:
    """Elements shared by each ordered pair of members (a before b)."""
    skip = 0 if with_self else 1
    pairs = F.flatten(F.transform("pattern", lambda first_member, first_at: F.transform(
        F.slice("pattern", first_at + 1 + skip, F.greatest(F.size("pattern") - first_at - skip, F.lit(0))),
        lambda second_member: F.struct(first_member.alias("a"), second_member.alias("b")))))
    return patterns.select(*by, "n", F.inline(pairs)).groupBy(*by, "a", "b").agg(F.sum("n").alias("n_shared"))


def sim_jaccard_subtypes(counts: DataFrame) -> DataFrame:
    """Jaccard percent of active regions for subtype pairs of a group; the diagonal is 100.

    Pairs that share nothing have no row: they are zero.
    """
    pat = pattern_counts(counts.where("cnt > 0"), ["grp"], SPAN, "subtype")
    pairs = member_pairs(pat, ["grp"], with_self=True)
    own = pairs.where("a = b").select("grp", F.col("a").alias("m"), F.col("n_shared").alias("size"))
    out = pairs.join(own.select("grp", F.col("m").alias("a"), F.col("size").alias("n_a")), ["grp", "a"]).join(
        own.select("grp", F.col("m").alias("b"), F.col("size").alias("n_b")), ["grp", "b"])
    union = F.col("n_a") + F.col("n_b") - F.col("n_shared")
    return out.select("grp", "a", "b", "n_shared", (F.col("n_shared") * 100.0 / union).alias("jaccard_pct"))


def win_rankings(sample_counts: DataFrame) -> DataFrame:
    """Regions of each (sample, subtype) ranked by percent; equal percents share a rank.

    Ranks come from the few distinct counts of a group, so no window holds all
    of its regions.
    """
    d = sample_counts.where("family = 'sample+subtype'")
    dist = d.groupBy("sample", "subtype", "cnt").agg(F.count("*").alias("m"))
    above = W.partitionBy("sample", "subtype").orderBy(F.desc("cnt")).rowsBetween(W.unboundedPreceding, -1)
    dist = dist.select("sample", "subtype", "cnt", (F.coalesce(F.sum("m").over(above), F.lit(0)) + 1).alias("rank"))
    return salted_join(d, dist, ["sample", "subtype", "cnt"]).select(
        "sample", "subtype", *SPAN, "cnt", "pct", "rank")


def win_topn_per_group(df: DataFrame, by: list[str], score: str, n: int, tie: list[str]) -> DataFrame:
    """Top ``n`` rows per group by score; ties go to the smaller key.

    Spark cuts groups short before the shuffle up to a rank of 1,000. Above it the rows of a group are first cut to
    ``n`` inside hash parts, so that no task orders a whole group.
    """
    order = [F.col(score).desc(), *tie]
    if n > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*tie), F.lit(PARTS))
        df = df.withColumn("_part", part).withColumn("_r", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))).where(
            F.col("_r") <= n).drop("_part", "_r")
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def win_anchor_dedup(counts: DataFrame, sizes: DataFrame, n: int = 10) -> DataFrame:
    """Top regions by percent in each anchor subtype; a region stays with its first anchor."""
    d = counts.join(sizes.select("grp", "subtype", "ord"), ["grp", "subtype"])
    top = win_topn_per_group(d, ["grp", "subtype"], "pct", n, SPAN)
    first = F.row_number().over(W.partitionBy(*REGION).orderBy("ord"))
    return top.withColumn("_f", first).where("_f = 1").select(
        *REGION, F.col("subtype").alias("anchor"), F.col("pct").alias("anchor_pct"), "region_type")


def region_companion(regions: DataFrame, counts: DataFrame, sizes: DataFrame, min_fdr: DataFrame) -> DataFrame:
    """Per selected region: first and second subtype, breadth at 5 and 25 percent, mean presence, stars."""
    d = counts.join(regions.select(*REGION), REGION, "left_semi").join(
        sizes.select("grp", "subtype", "ord", "n_subtypes"), ["grp", "subtype"])
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("pct")).alias("neg"), "ord", "subtype"))), 1, 2)
    agg = d.groupBy(*REGION).agg(
        best.alias("best"), F.count_if(F.col("pct") >= 5).alias("n_ge5"), F.count_if(F.col("pct") >= 25).alias("n_ge25"),
        (F.sum("pct") / F.max("n_subtypes")).alias("mean_pct"))
    one = lambda i, f: F.get("best", F.lit(i))[f]
    return agg.join(min_fdr, REGION, "left").select(
        *REGION, one(0, "subtype").alias("first_subtype"), (-one(0, "neg")).alias("first_pct"),
        one(1, "subtype").alias("second_subtype"), (-one(1, "neg")).alias("second_pct"),
        "n_ge5", "n_ge25", "mean_pct", "min_fdr", stars(F.coalesce("min_fdr", F.lit(1.0))).alias("stars"))


def coord_lookup(regions: DataFrame, wanted: list[str] | None = None, contains: str | None = None,
                 order: str = "diff") -> DataFrame:
    """Regions whose coordinate text equals or holds one of ``wanted``, or holds ``contains``.

    ``order``: ``diff`` (largest first), ``source_group`` (then difference), or
    ``input`` (position of the first wanted text that matches).
    """
    clean = [w.strip().replace(",", "").replace(" ", "") for w in wanted or []]
    key = F.regexp_replace("region", "[, ]", "")
    if contains is not None:
        hit, pos = F.col("region").contains(contains), F.lit(0)
    else:
        at = [F.when(key.contains(w), i) for i, w in enumerate(clean)]
        pos = F.coalesce(*at, F.lit(None).cast("int")) if at else F.lit(None).cast("int")
        hit = pos.isNotNull()
    out = regions.withColumn("input_order", pos).where(hit).dropDuplicates(["region"])
    keys = {"diff": [F.desc("diff_pct"), "region"], "source_group": ["grp", F.desc("diff_pct"), "region"],
            "input": ["input_order", "region"]}[order]
    return out.orderBy(*keys)
