"""Model-predicted (novel) regions on bins, stacked on known regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from regspan.functions import recode as R
from regspan.functions.coords import log2_ratio, midpoint, region_id
from regspan.operators.intervals import join_interval_exists
from regspan.operators.pairwise import contingency, member_counts, pair_rows, tested_tables, with_tests
from regspan.operators.presence import MIN_CELLS, PSEUDO, REGION, agg_pct_metrics
from regspan.operators.scale import dealt, salted_join

BIN = 1000
JOINT = [*REGION, "basket", "region_class"]
REGULATORY = ["novel|enhancer", "novel|silencer", "novel|dual"]
COUNTS = {"enhancer": "c_enh", "silencer": "c_sil", "enhancer_silencer": "c_dual", "neither": "c_neither"}


def _leading(counts: dict[str, str]):
    """Name of the largest of several count columns; the earlier one wins ties."""
    marks = [F.struct(F.col(c).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name"))
             for i, (name, c) in enumerate(counts.items())]
    return F.array_max(F.array(*marks))["name"]


def agg_bin_consensus(predictions: DataFrame, sizes: DataFrame, bin_size: int = BIN, tasks: int | None = None) -> DataFrame:
    """Novel loci per subtype: peaks merged on the bin of their midpoint.

    A cell counts once per locus; categories and probabilities count every
    peak. Rows are first summed per cell, so the final group sees one row per
    cell and bin; ``tasks`` is the number of tasks that these are dealt over.
    """
    keys = ["grp", "subtype", "chrom", "bin"]
    p = predictions.withColumn("bin", F.expr(f"((peak_start + peak_end) div 2) div {bin_size}"))
    cell = p.groupBy(*keys, "cell_id").agg(
        *[F.count_if(F.col("category") == cat).alias(c) for cat, c in COUNTS.items()],
        F.sum("p_enhancer").alias("se"), F.sum("p_silencer").alias("ss"), F.sum("n_tfs").alias("st"),
        F.min("peak_start").alias("lo"), F.max("peak_end").alias("hi"))
    loci = dealt(cell, tasks, *keys[1:]).groupBy(*keys).agg(
        F.count("*").alias("n_cells"), *[F.sum(c).alias(c) for c in COUNTS.values()],
        F.sum("se").alias("se"), F.sum("ss").alias("ss"), F.sum("st").alias("st"),
        F.min("lo").alias("r_start"), F.max("hi").alias("r_end"))
    rows = sum((F.col(c) for c in list(COUNTS.values())[1:]), F.col("c_enh"))
    return loci.join(sizes.select("grp", "subtype", F.col("n_cells").alias("_n")), ["grp", "subtype"]).select(
        "grp", "subtype", "chrom", "bin", "r_start", "r_end", "n_cells",
        (F.col("n_cells") * 100.0 / F.col("_n")).alias("pct"), _leading(COUNTS).alias("consensus_category"),
        *COUNTS.values(), (F.col("se") / rows).alias("mean_p_enhancer"), (F.col("ss") / rows).alias("mean_p_silencer"),
        (F.col("st") / rows).alias("mean_n_tfs"))


def _rebinned(loci: DataFrame, min_cells: int, bin_size: int) -> DataFrame:
    """Loci with enough cells, binned again on the midpoint of their merged span.

    A locus can move to a neighbour bin here, and two loci of one subtype can meet.
    """
    return loci.where(F.col("n_cells") >= min_cells).withColumn(
        "bin", F.floor(midpoint("r_start", "r_end") / F.lit(bin_size)).cast("bigint"))


def agg_novel_merge(loci: DataFrame, sizes: DataFrame, how: str = "max", min_cells: int = MIN_CELLS,
                    bin_size: int = BIN, tasks: int | None = None) -> DataFrame:
    """Novel loci across the subtypes of a group, long: one row per (locus, subtype).

    Probabilities are weighted by cells, the category is the one with most
    cells. ``how="max"`` keeps the largest percent of a subtype, ``"sum"`` adds
    cell counts (which may exceed the cells of the subtype). ``tasks`` is the
    number of tasks that loci are dealt over.
    """
    key = ["grp", "chrom", "bin"]
    d = dealt(_rebinned(loci, min_cells, bin_size), tasks, *key[1:])
    means = ["mean_p_enhancer", "mean_p_silencer", "mean_n_tfs"]
    w = F.col("n_cells")
    votes = [F.sum(F.when(F.col("consensus_category") == cat, w).otherwise(0)).alias(c) for cat, c in COUNTS.items()]
    cnt = F.max(w) if how == "max" else F.sum(w)
    per = d.groupBy(*key, "subtype").agg(
        F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end"), F.sum(w).alias("w"), cnt.alias("cnt"),
        F.max("pct").alias("pct"), *votes, *[F.sum(F.col(m) * w).alias(m) for m in means])
    if how != "max":
        per = per.join(sizes.select("grp", "subtype", F.col("n_cells").alias("_n")), ["grp", "subtype"]).withColumn(
            "pct", F.col("cnt") * 100.0 / F.col("_n"))
    # subtypes of a locus are few, so they travel as a short array while the locus is summed
    locus = per.groupBy(*key).agg(
        F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end"), *[F.sum(c).alias(c) for c in COUNTS.values()],
        *[(F.sum(m) / F.sum("w")).alias(m) for m in means],
        F.collect_list(F.struct("subtype", "cnt", "pct")).alias("subtypes"))
    return locus.select(*key, "r_start", "r_end", *means, _leading(COUNTS).alias("consensus_category"),
                        F.inline("subtypes")).withColumn("region_class", R.novel_class("consensus_category"))


def join_known_novel(known: DataFrame, novel: DataFrame) -> DataFrame:
    """Known and novel long counts as one table; fields only novel regions have are NULL on known ones."""
    k = known.select(*REGION, "subtype", "cnt", "pct", F.lit("known").alias("basket"),
                     R.recode_known_class("region_type").alias("region_class"))
    n = novel.select(*REGION, "subtype", "cnt", "pct", F.lit("novel").alias("basket"), "region_class",
                     "mean_p_enhancer", "mean_p_silencer", "mean_n_tfs")
    return k.unionByName(n, allowMissingColumns=True)


def joint_master(joint: DataFrame, sizes: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per joint region with percent metrics and its id."""
    m = agg_pct_metrics(joint, sizes, PSEUDO, JOINT, tasks).drop("exclusive_subtype")
    return m.withColumn("region_id", region_id("region_class", "chrom", "r_start", "r_end"))


def joint_regulatory(joint: DataFrame) -> DataFrame:
    """The version without gene bodies and without non-regulatory loci."""
    return joint.where(~F.col("region_class").isin("known|gene_body", "novel|nonregulatory"))


def agg_composition(master: DataFrame) -> DataFrame:
    """Regions per basket and class, with their share of the group."""
    n = master.groupBy("grp", "basket", "region_class").agg(F.count("*").alias("n_regions"))
    share = F.col("n_regions") * 100.0 / F.sum("n_regions").over(W.partitionBy("grp"))
    return n.select("*", share.alias("pct_of_group"))


def agg_rediscovery(master: DataFrame, tasks: int | None = None) -> DataFrame:
    """Share of novel regulatory regions of a group that meet a known region of the same group."""
    novel = master.where((F.col("basket") == "novel") & F.col("region_class").isin(REGULATORY)).select(
        "grp", "chrom", "r_start", "r_end")
    known = master.where("basket = 'known'").select("grp", "chrom", F.col("r_start").alias("ks"),
                                                    F.col("r_end").alias("ke"))
    met = join_interval_exists(novel, known, ("r_start", "r_end"), ("ks", "ke"), on=("grp", "chrom"), tasks=tasks)
    total = novel.groupBy("grp").agg(F.count("*").alias("n_novel_regulatory"))
    hit = met.groupBy("grp").agg(F.count("*").alias("n_overlapping_known"))
    has_known = known.select("grp").distinct()
    return total.join(has_known, "grp", "left_semi").join(hit, "grp", "left").select(
        "grp", "n_novel_regulatory", F.coalesce("n_overlapping_known", F.lit(0)).alias("n_overlapping_known"),
        (F.coalesce("n_overlapping_known", F.lit(0)) * 100.0 / F.col("n_novel_regulatory")).alias("pct_rediscovered"))


def _unsigned(df: DataFrame, pseudo: float) -> DataFrame:
    """Difference and ratio without a sign, the higher side, and flags."""
    d = df.withColumns({"pct_a": F.col("ca") * 100.0 / F.col("na"), "pct_b": F.col("cb") * 100.0 / F.col("nb")})
    hi, lo = F.greatest("pct_a", "pct_b"), F.least("pct_a", "pct_b")
    side = F.concat(F.lit("up_in_"), F.when(F.col("pct_a") >= F.col("pct_b"), F.col("a")).otherwise(F.col("b")))
    return d.withColumns({"diff_pct": hi - lo, "log2fc": log2_ratio(hi, lo, pseudo), "direction": side,
                          "sig_005": F.col("fdr") < 0.05, "sig_001": F.col("fdr") < 0.01, "sig_0001": F.col("fdr") < 0.001})


def fisher_novel_tables(novel: DataFrame, sizes: DataFrame, pseudo: float = PSEUDO) -> DataFrame:
    """All tests of ``test_fisher_novel`` as weighted tables."""
    return _unsigned(tested_tables(contingency(member_counts(novel, [*REGION, "region_class"]), sizes, zeros=False)), pseudo)


def test_fisher_novel(novel: DataFrame, sizes: DataFrame, pseudo: float = PSEUDO) -> DataFrame:
    """Exact tests on novel loci with at least one cell in the pair.

    Difference and ratio carry no sign and the direction does not wait for
    significance.
    """
    held = member_counts(novel, [*REGION, "region_class"])
    tables = tested_tables(contingency(held, sizes, zeros=False))
    rows = with_tests(pair_rows(held, sizes).where("ca + cb > 0"), tables)
    return _unsigned(rows.drop("global_fdr", "odds_ratio"), pseudo)


def region_bins(master: DataFrame, bin_size: int = BIN, tasks: int | None = None) -> DataFrame:
    """Bins a region touches, known before novel when a bin has both. ``tasks`` is the number of tasks that bins are dealt over."""
    b = master.select("grp", "chrom", "basket", F.explode(F.sequence(
        F.expr(f"r_start div {bin_size}"), F.expr(f"r_end div {bin_size}"))).alias("bin"))
    return dealt(b, tasks, "chrom", "bin").groupBy("grp", "chrom", "bin").agg(F.min("basket").alias("basket"))


def join_bin_class(predictions: DataFrame, master: DataFrame, bin_size: int = BIN, tasks: int | None = None) -> DataFrame:
    """Regulatory peaks of each cell that lie in a bin of the tested regions, as known or novel.

    ``tasks`` is the number of tasks that peaks and bins are dealt over (Spark's own if None).
    """
    reg = predictions.where(F.col("category") != "neither").withColumn(
        "bin", F.floor(midpoint("peak_start", "peak_end") / F.lit(bin_size)).cast("bigint"))
    return salted_join(reg, region_bins(master, bin_size, tasks), ["grp", "chrom", "bin"], tasks=tasks)


def percell_novel_burden(classified: DataFrame, min_peaks: int = 5) -> DataFrame:
    """Novel share of the classified peaks of a cell, for cells with enough of them."""
    n = classified.groupBy("grp", "subtype", "cell_id").agg(
        F.count("*").alias("n_reg_peaks"), F.count_if(F.col("basket") == "novel").alias("_nn"))
    return n.where(F.col("n_reg_peaks") >= min_peaks).select(
        "grp", "subtype", "cell_id", "n_reg_peaks", (F.col("_nn") * 100.0 / F.col("n_reg_peaks")).alias("novel_pct"))


def agg_category_rollup(predictions: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells, peaks and categories per subtype, group and in all, with shares of peaks.

    Cells come from the roster of prediction files, so empty files count.
    """
    cats = predictions.groupBy("grp", "subtype").agg(
        F.count("*").alias("total_peaks"), *[F.count_if(F.col("category") == cat).alias(c) for cat, c in COUNTS.items()])
    n = cells.groupBy("grp", "subtype").agg(F.count_distinct("cell_id").alias("n_cells"))
    d = n.join(cats, ["grp", "subtype"], "left").na.fill(0)
    cols = ["n_cells", "total_peaks", *COUNTS.values()]
    r = d.rollup("grp", "subtype").agg(*[F.sum(c).alias(c) for c in cols], F.count("*").alias("n_subtypes"),
                                       F.grouping_id().cast("int").alias("level"))
    pct = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("total_peaks")), F.lit(0.0))
    return r.withColumns({"pct_enh": pct("c_enh"), "pct_sil": pct("c_sil"), "pct_both": pct("c_dual")})


def agg_per_sample_fraction(predictions: DataFrame) -> DataFrame:
    n = predictions.groupBy("sample", "category").agg(F.count("*").alias("n"))
    return n.select("*", (F.col("n") / F.sum("n").over(W.partitionBy("sample"))).alias("fraction"))


def agg_ntfs_quartiles(predictions: DataFrame) -> DataFrame:
    """Quartiles of the TF count per category, from distinct values and their counts."""
    v = predictions.groupBy("category", "n_tfs").agg(F.count("*").alias("m"))
    q = lambda p: F.percentile("n_tfs", F.lit(p), F.col("m"))
    return v.groupBy("category").agg(F.sum("m").alias("n"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))
