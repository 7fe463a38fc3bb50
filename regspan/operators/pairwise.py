"""Exact tests over all pairs of subtypes, with false-discovery control."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from regspan.functions import recode as R
from regspan.functions.coords import log2_ratio, stars
from regspan.functions.stats import hypergeometric_p, odds_ratio
from regspan.operators.presence import PSEUDO, REGION, SPAN, win_topn_per_group
from regspan.operators.scale import checked_broadcast, exact_quantiles, running_totals, salted_join, unit_bucket
from regspan.session import durable

PAIR = ["grp", "a", "b"]


def subtype_pairs(sizes: DataFrame) -> DataFrame:
    """Ordered pairs of subtypes of a group with both cell totals."""
    x = sizes.select("grp", F.col("subtype").alias("a"), F.col("n_cells").alias("na"), F.col("ord").alias("oa"))
    y = sizes.select("grp", F.col("subtype").alias("b"), F.col("n_cells").alias("nb"), F.col("ord").alias("ob"))
    return checked_broadcast(x.join(y, "grp").where("oa < ob").drop("oa", "ob"))


def fdr_bh(df: DataFrame, p: str, by: list[str], weight: str | None = None, out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg within ``by``; ``weight`` says how many tests share a row.

    Works on distinct p with their multiplicity. Ranks and the reverse running
    minimum are taken inside buckets of p and carried across buckets through
    their totals, so no window holds all p of a group.
    """
    w8 = F.col(weight) if weight else F.lit(1)
    d = df.groupBy(*by, p).agg(F.sum(w8).alias("_w"))
    ranked = running_totals(d, by, p, unit_bucket(p), ["_w"])
    raw = ranked.select(*by, p, unit_bucket(p).alias("_b"),
                        (F.col(p) * F.col("all__w") / F.col("cum__w")).alias("_raw"))
    inside = W.partitionBy(*by, "_b").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    floor = raw.groupBy(*by, "_b").agg(F.min("_raw").alias("_m")).select(
        *by, "_b", F.min("_m").over(later).alias("_later"))
    adj = raw.withColumn("_in", F.min("_raw").over(inside)).join(floor, [*by, "_b"]).select(
        *by, p, F.least(F.col("_in"), F.coalesce("_later", F.lit(1.0)), F.lit(1.0)).alias(out))
    return salted_join(df, adj, [*by, p])  # very many tests may share one p


TABLE = [*PAIR, "ca", "cb"]


def member_counts(counts: DataFrame, key: list[str]) -> DataFrame:
    """One row per region with its subtypes and their cells as a short sorted array ``held``; absent subtypes have no entry."""
    entry = F.struct("subtype", "cnt")
    return counts.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("cnt") > 0, entry))).alias("held"))


def contingency(held: DataFrame, sizes: DataFrame, zeros: bool = True) -> DataFrame:
    """The 2x2 tables of every pair of subtypes with their multiplicity ``m``: (grp, a, b, na, nb, ca, cb, m).

    ``held`` comes from ``member_counts``. Only pairs that a region really holds are counted from regions, in one sum per
    (pair, ca, cb). Regions that hold one side alone are what is left of that side's count; regions that hold neither are
    what is left of the group, one weighted row per pair. ``zeros=False`` leaves these out.
    """
    nobody = F.struct(F.lit(None).cast("string").alias("subtype"), F.lit(None).cast("bigint").alias("cnt"))
    member = F.concat(F.array(nobody), F.transform("held", lambda h: F.struct(h["subtype"], h["cnt"].cast("bigint").alias("cnt"))))
    # the entry before all others stands for the region itself: beside it, each subtype is counted on its own
    pairs = F.flatten(F.transform(member, lambda x, i: F.transform(
        F.slice(member, i + 2, F.greatest(F.size("held") - i, F.lit(0))),
        lambda y: F.struct(x["subtype"].alias("a"), y["subtype"].alias("b"), x["cnt"].alias("ca"), y["cnt"].alias("cb")))))
    whole = F.array(F.struct(nobody["subtype"].alias("a"), nobody["subtype"].alias("b"), nobody["cnt"].alias("ca"), nobody["cnt"].alias("cb")))
    seen = durable(held.select("grp", F.inline(F.concat(whole, pairs))).groupBy("grp", "a", "b", "ca", "cb").agg(F.count("*").alias("m")))
    n = seen.where("b IS NULL").select("grp", F.col("m").alias("regions"))
    alone = seen.where("a IS NULL AND b IS NOT NULL").select("grp", F.col("b").alias("s"), F.col("cb").alias("c"), "m")
    both = seen.where("a IS NOT NULL").select(*TABLE, "m")
    roster = subtype_pairs(sizes)

    def one_side(side: str) -> DataFrame:
        held_by, count = side, f"c{side}"
        met = both.groupBy(*PAIR, count).agg(F.sum("m").alias("met"))
        every = roster.join(alone.withColumnsRenamed({"s": held_by, "c": count}), ["grp", held_by])
        left = every.join(met, [*PAIR, count], "left").withColumn("m", F.col("m") - F.coalesce("met", F.lit(0)))
        other = "cb" if side == "a" else "ca"
        return left.where("m > 0").withColumn(other, F.lit(0).cast("bigint")).select(*PAIR, "na", "nb", "ca", "cb", "m")

    some = both.join(roster, PAIR).select(*PAIR, "na", "nb", "ca", "cb", "m").union(one_side("a")).union(one_side("b"))
    if not zeros:
        return some
    used = some.groupBy(*PAIR).agg(F.sum("m").alias("used"))
    none = roster.join(n, "grp").join(used, PAIR, "left").withColumn("m", F.col("regions") - F.coalesce("used", F.lit(0)))
    zero = F.lit(0).cast("bigint")
    return some.union(none.where("m > 0").select(*PAIR, "na", "nb", zero.alias("ca"), zero.alias("cb"), "m"))


def fisher_tables(tables: DataFrame) -> DataFrame:
    """``p_value`` of the distinct (na, nb, ca, cb) of ``tables``, two-sided and exact.

    Tables with the same margins share one mass function: it is laid out once per (na, nb, drawn), sorted by probability
    with running totals, and each observed count looks its total up. Work grows with margins times support, not with
    tables. A count above its total gives p = 1.
    """
    seen = tables.select(*[F.col(c).cast("bigint").alias(c) for c in ("na", "nb", "ca", "cb")]).withColumn("drawn", F.col("ca") + F.col("cb"))
    margins = seen.groupBy("na", "nb", "drawn").agg(F.collect_set("ca").alias("observed"))

    def run(batches):
        for batch in batches:
            out = []
            for na, nb, drawn, observed in zip(*[c.to_pylist() for c in batch.columns]):
                p = hypergeometric_p(na, nb, drawn, np.array(observed, np.int64))
                out += [(na, nb, ca, drawn - ca, float(x)) for ca, x in zip(observed, p)]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.float64())], ["na", "nb", "ca", "cb", "p_value"])

    return margins.mapInArrow(run, "na bigint, nb bigint, ca bigint, cb bigint, p_value double")


def tested_tables(tables: DataFrame) -> DataFrame:
    """Tables of ``contingency`` with p, odds ratio, and FDR per pair and over all pairs of a group; ``m`` regions weigh m tests."""
    tables = durable(tables)
    p = fisher_tables(tables)
    tested = durable(tables.join(p, ["na", "nb", "ca", "cb"]).withColumn("odds_ratio", odds_ratio("ca", "na", "cb", "nb")))
    return durable(fdr_bh(fdr_bh(tested, "p_value", PAIR, "m", "fdr"), "p_value", ["grp"], "m", "global_fdr"))


def _percents(df: DataFrame) -> DataFrame:
    pct = lambda c, n: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col(n)), F.lit(0.0))
    return df.withColumns({"pct_a": pct("ca", "na"), "pct_b": pct("cb", "nb")})


def signed(df: DataFrame, pseudo: float = PSEUDO) -> DataFrame:
    """Percents, signed difference and log2 ratio of rows or tables with ca, na, cb, nb."""
    return _percents(df).withColumns({"diff_pct": F.col("pct_a") - F.col("pct_b"), "log2fc": log2_ratio(F.col("pct_a"), F.col("pct_b"), pseudo)})


def fisher_pair_tables(counts: DataFrame, sizes: DataFrame, pseudo: float = PSEUDO) -> DataFrame:
    """All tests of ``test_fisher_pairs`` as weighted tables: what summaries, histograms, directions and minima need."""
    return test_direction(signed(tested_tables(contingency(member_counts(counts, REGION), sizes)), pseudo))


def with_tests(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Region rows with the results of their table; rows without a cell on either side know theirs and are not shuffled."""
    some = salted_join(rows.where("ca + cb > 0"), tables.select(*TABLE, "p_value", "odds_ratio", "fdr", "global_fdr"), TABLE)
    sure = {"p_value": F.lit(1.0), "odds_ratio": F.lit(None).cast("double"), "fdr": F.lit(1.0), "global_fdr": F.lit(1.0)}
    return some.unionByName(rows.where("ca + cb = 0").withColumns(sure))


def test_direction(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significance flags, and which side is up where the FDR is below ``alpha``."""
    sig = F.col("fdr") < alpha
    side = (F.when(sig & (F.col("log2fc") > 0), F.concat(F.lit("up_in_"), "a"))
            .when(sig & (F.col("log2fc") < 0), F.concat(F.lit("up_in_"), "b")).otherwise("ns"))
    return df.select("*", (F.col("fdr") < 0.05).alias("sig_005"), (F.col("fdr") < 0.01).alias("sig_001"),
                     (F.col("fdr") < 0.001).alias("sig_0001"), side.alias("direction"))


def pair_rows(held: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every region against every pair of its group's subtypes, from the array of ``member_counts``."""
    found = F.map_from_entries("held")
    got = lambda c: F.coalesce(F.col("_m")[F.col(c)], F.lit(0)).cast("bigint")
    d = held.withColumn("_m", found).drop("held").join(subtype_pairs(sizes), "grp")
    return d.withColumns({"ca": got("a"), "cb": got("b")}).drop("_m")


def test_fisher_pairs(counts: DataFrame, sizes: DataFrame, pseudo: float = PSEUDO, tables: DataFrame | None = None) -> DataFrame:
    """Two-sided exact test of every region in every pair of subtypes, signed difference and log2 ratio.

    One row per region and pair, for those who want them; ``tables`` are those of ``fisher_pair_tables`` if at hand.
    """
    held = member_counts(counts, [*REGION, "region_type"])
    tables = tested_tables(contingency(held, sizes)) if tables is None else tables
    return test_direction(signed(with_tests(pair_rows(held, sizes), tables), pseudo))


def agg_pair_summary(tables: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Totals, significant regions at three levels and by side, extreme ratios and smallest FDR per pair, from weighted tables."""
    cuts = [("005", 0.05), ("001", 0.01), ("0001", 0.001)]
    counted = lambda c: F.sum(F.when(c, F.col("m")).otherwise(0))
    aggs = [F.sum("m").alias("total_regions"), F.first("na").alias("na"), F.first("nb").alias("nb")]
    for name, cut in cuts:
        sig = F.col("fdr") < cut
        aggs += [counted(sig).alias(f"sig_{name}"), counted(sig & (F.col("log2fc") > 0)).alias(f"up_a_{name}"),
                 counted(sig & (F.col("log2fc") < 0)).alias(f"up_b_{name}")]
        for basket in extra or []:
            aggs.append(counted(sig & (F.col("basket") == basket)).alias(f"sig_{name}_{basket}"))
    aggs += [F.max("log2fc").alias("max_log2fc"), F.min("log2fc").alias("min_log2fc"), F.min("fdr").alias("min_fdr")]
    return tables.groupBy(*PAIR).agg(*aggs)


def _with_partners(held: DataFrame, tables: DataFrame) -> DataFrame:
    """Each region's subtypes (s, with c cells) beside the tables that s enters with c: ``partners`` of (other, its count, fdr).

    One row per region and subtype that it holds; never one per pair.
    """
    sides = [tables.where(f"c{x} > 0").select("grp", F.col(x).alias("s"), F.col(f"c{x}").alias("c"), F.struct(
        F.col(y).alias("o"), F.col(f"c{y}").alias("co"), "fdr").alias("t")) for x, y in (("a", "b"), ("b", "a"))]
    partners = durable(sides[0].union(sides[1]).groupBy("grp", "s", "c").agg(F.collect_list("t").alias("partners")))
    rows = held.select("*", F.inline("held")).withColumnsRenamed({"subtype": "s", "cnt": "c"})
    return salted_join(rows, partners, ["grp", "s", "c"], "left", spread=SPAN)


def agg_min_fdr(counts: DataFrame, tables: DataFrame) -> DataFrame:
    """Smallest FDR of each region over all pairs of its group, with stars.

    A region's tables are those of its subtypes with partners that it holds with the same count, or does not hold. Tables
    with an FDR of 1 tell nothing and stay out.
    """
    held = member_counts(counts, REGION)
    mine = lambda t: F.exists("held", lambda h: (h["subtype"] == t["o"]) & (h["cnt"] == t["co"])) | (
        (t["co"] == 0) & ~F.exists("held", lambda h: h["subtype"] == t["o"]))
    low = F.array_min(F.transform(F.filter("partners", mine), lambda t: t["fdr"]))
    found = _with_partners(held, tables.where("fdr < 1")).groupBy(*REGION).agg(F.coalesce(F.min(low), F.lit(1.0)).alias("min_fdr"))
    return found.withColumn("stars", stars("min_fdr"))


def pair_points(tested: DataFrame) -> DataFrame:
    """Volcano and mean-presence coordinates of each test."""
    neg = -F.log10(F.greatest(F.col("fdr"), F.lit(1e-300)))
    return tested.select(*REGION, "a", "b", "region_type", "diff_pct", "log2fc", "fdr",
                         neg.alias("neg_log10_fdr"), ((F.col("pct_a") + F.col("pct_b")) / 2).alias("mean_presence"))


def agg_pair_points(counts: DataFrame, sizes: DataFrame, tables: DataFrame, n: int = 8, pseudo: float = PSEUDO, places: int = 15) -> DataFrame:
    """The ``n`` most significant points of each pair, equal ones by coordinate; significance counts to ``places`` decimals.

    Only regions with one of a pair's ``n`` lowest tables can be among them, and where these are too few, the first ``n``
    regions of the group: all other tests have an FDR of 1, so coordinates alone decide.
    """
    held = member_counts(counts, [*REGION, "region_type"])
    first = win_topn_per_group(held.withColumn("_one", F.lit(1)), ["grp"], "_one", n, SPAN).drop("_one", "rank")
    neg = F.round(-F.log10(F.greatest(F.col("fdr"), F.lit(1e-300))), places)
    ranked = tables.withColumn("_neg", neg).where("_neg > 0").withColumn("_r", F.rank().over(W.partitionBy(*PAIR).orderBy(F.desc("_neg"))))
    low = durable(ranked.where(F.col("_r") <= n).select(*TABLE))
    rows = held.select("*", F.inline("held")).withColumnsRenamed({"subtype": "s", "cnt": "c"})
    by_a = salted_join(rows, low.where("ca > 0").withColumnsRenamed({"a": "s", "ca": "c"}), ["grp", "s", "c"], spread=SPAN).withColumnsRenamed({"s": "a", "c": "ca"})
    by_b = salted_join(rows, low.where("ca = 0").withColumnsRenamed({"b": "s", "cb": "c"}), ["grp", "s", "c"], spread=SPAN).withColumnsRenamed({"s": "b", "c": "cb"})
    cell = lambda side: F.coalesce(F.map_from_entries("held")[F.col(side)], F.lit(0))
    hit = by_a.unionByName(by_b).where((cell("a") == F.col("ca")) & (cell("b") == F.col("cb")))
    cols = [*REGION, "region_type", *PAIR[1:], "ca", "cb"]
    few = hit.select(*cols).join(subtype_pairs(sizes).select(*PAIR, "na", "nb"), PAIR)
    both = few.unionByName(pair_rows(first, sizes).select(few.columns)).distinct()
    points = pair_points(signed(with_tests(both, tables), pseudo)).withColumn("neg_log10_fdr", F.round("neg_log10_fdr", places) + 0.0)
    return win_topn_per_group(points, PAIR, "neg_log10_fdr", n, SPAN)


def agg_fdr_histogram(tables: DataFrame, bins: int = 50) -> DataFrame:
    b = F.least(F.floor(F.col("fdr") * bins), F.lit(bins - 1)).cast("int")
    return tables.groupBy("grp", b.alias("bin")).agg(F.sum("m").alias("n"))


def agg_diff_spread(metrics: DataFrame) -> DataFrame:
    """Quartiles of the difference per simplified type."""
    typed = metrics.withColumn("simple_type", R.recode_simplify_type("region_type"))
    q = exact_quantiles(typed, ["grp", "simple_type"], "diff_pct", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return q.withColumnsRenamed({"smallest": "q0", "largest": "q4"})


def sig_region_union(counts: DataFrame, tables: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Regions significant in any pair of a group."""
    return agg_min_fdr(counts, tables.where(F.col("fdr") < alpha)).where(F.col("min_fdr") < alpha).select(*REGION)
