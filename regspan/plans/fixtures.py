"""The driver's tables seen as footprints, annotations, genes and scores."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from regspan.functions import recode as R
from regspan.operators.scale import dealt, tasks_for
from regspan.session import durable


def _sites() -> list[Column]:
    """Chromosome, start and end of a line's footprint."""
    base = F.expr("1000 + (l_partkey div 22) * 700")
    return [F.concat(F.lit("chr"), (F.col("l_partkey") % 22 + 1).cast("string")).alias("chrom"),
            (base + F.col("l_linenumber") * 20).cast("bigint").alias("fp_start"),
            (base + F.col("l_linenumber") * 21 + 10).cast("bigint").alias("fp_end")]


def _as_footprints(rows: DataFrame) -> DataFrame:
    """Lines with their cells as footprints."""
    base = F.expr("1000 + (l_partkey div 22) * 700")
    tf = (F.col("l_suppkey") % 40)
    return rows.select(
        "grp", "subtype", "sample", "cell_id", *_sites(),
        F.concat(F.lit("TF"), tf.cast("string"), F.lit("_MA"), (tf + 1000).cast("string")).alias("tf_motif"),
        F.col("l_quantity").alias("motif_score"),
        F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"),
        base.cast("bigint").alias("peak_start"),
        (base + 200 + F.col("l_partkey") % 100).cast("bigint").alias("peak_end"),
        F.col("l_discount").alias("fp_score"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_tax").alias("tax"),
    )


class Fixtures:
    """Lazy DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def cells(self) -> DataFrame:
        """Cell roster: every cell counts, with or without footprints."""
        c, n = self.table("customer"), self.table("nation")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            F.concat(F.lit("G"), F.col("n_regionkey").cast("string")).alias("grp"),
            F.col("c_mktsegment").alias("subtype"),
            F.col("n_name").alias("sample"),
            F.col("c_custkey").alias("cell_id"),
        )

    @cached_property
    def tasks(self) -> int:
        """Tasks that footprints are dealt over, from the rows that the table's files state."""
        return tasks_for(self.table("lineitem").count())

    @cached_property
    def footprints(self) -> DataFrame:
        li, o = self.table("lineitem"), self.table("orders")
        owner = dealt(o.select("o_orderkey", F.col("o_custkey").alias("cell_id")), self.tasks, "o_orderkey")
        placed = dealt(li, self.tasks, "l_orderkey").join(owner, li.l_orderkey == F.col("o_orderkey"))
        return _as_footprints(dealt(placed, self.tasks, "cell_id").join(dealt(self.cells, self.tasks, "cell_id"), "cell_id"))

    @cached_property
    def footprints_by_order(self) -> DataFrame:
        """The rows of ``footprints`` where nothing asks for a cell's rows together: orders find their cells first, so that
        lines are dealt once."""
        li, o = self.table("lineitem"), self.table("orders")
        owner = dealt(o.select("o_orderkey", F.col("o_custkey").alias("cell_id")), self.tasks, "cell_id").join(
            dealt(self.cells, self.tasks, "cell_id"), "cell_id")
        return _as_footprints(dealt(li, self.tasks, "l_orderkey").join(
            dealt(owner, self.tasks, "o_orderkey"), li.l_orderkey == F.col("o_orderkey")))

    @cached_property
    def annotations(self) -> DataFrame:
        tile = F.expr("(o_orderkey div 22) * 90")
        prio = F.col("o_orderpriority")
        return self.table("orders").select(
            F.concat(F.lit("chr"), (F.col("o_orderkey") % 22 + 1).cast("string")).alias("chrom"),
            tile.cast("bigint").alias("ann_start"),
            (tile + 30 + F.col("o_custkey") % 120).cast("bigint").alias("ann_end"),
            F.when(prio == "1-URGENT", "enhancer").when(prio == "2-HIGH", "silencer")
            .when(prio == "3-MEDIUM", "promoter").when(prio == "4-NOT SPECIFIED", "response_element")
            .otherwise("protein_bind_x").alias("ann_class"),
        )

    @cached_property
    def genes(self) -> DataFrame:
        tile = F.expr("(c_custkey div 22) * 900")
        return self.table("customer").select(
            F.concat(F.lit("chr"), (F.col("c_custkey") % 22 + 1).cast("string")).alias("chrom"),
            (tile + 1).cast("bigint").alias("gene_start"),
            (tile + 401 + F.col("c_custkey") % 300).cast("bigint").alias("gene_end"),
            F.when(F.col("c_acctbal") >= 5000, "-").otherwise("+").alias("strand"),
            F.col("c_name").alias("gene_name"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "protein_coding")
            .otherwise("lncRNA").alias("gene_type"),
        )

    @cached_property
    def tf_pct(self) -> DataFrame:
        """Percent per (nucleus, TF); an absent pair is zero."""
        hit = F.sum(F.when(F.col("flag") == "R", 1).otherwise(0))
        return self.footprints.groupBy(
            "grp", "subtype", F.col("cell_id").alias("nucleus"), F.col("tf_motif").alias("tf"),
        ).agg(((hit * 100).cast("double") / F.count("*")).alias("pct"))

    @cached_property
    def predictions(self) -> DataFrame:
        return self.footprints.groupBy("grp", "subtype", "sample", "cell_id", "chrom", "peak_start", "peak_end").agg(
            (F.max("fp_score") * 10).alias("p_enhancer"),
            (F.max("tax") * 12.5).alias("p_silencer"),
            F.count_distinct("tf_motif").alias("n_tfs"),
        ).withColumn("category", R.categorize_2head("p_enhancer", "p_silencer"))

    @cached_property
    def rna(self) -> DataFrame:
        return self.table("events").groupBy(
            F.col("user_id").alias("cell_id"),
            F.concat(F.lit("C"), (F.col("user_id") % 10).cast("string")).alias("cluster_id"),
            F.col("event_type").alias("gene"),
        ).agg(F.sum(F.floor("value")).cast("bigint").alias("umi"))

    @cached_property
    def rna_cells(self) -> DataFrame:
        """Cells of the RNA table with library size and dissection."""
        return self.rna.groupBy("cell_id", "cluster_id").agg(F.sum("umi").alias("total_umis")).select(
            "*", F.when(F.col("cell_id") % 3 == 0, "Midbrain (M) - Substantia").when(
                F.col("cell_id") % 3 == 1, "Septal nuclei").otherwise("Pons").alias("dissection"))

    @cached_property
    def scored(self) -> DataFrame:
        """Long truth and scores, one row per (row, head)."""
        d = self.table("documents").select("doc_id", "n_chars")
        wide = self.table("labels").join(d, "doc_id").select(
            "doc_id", F.col("quality").alias("y_a"), F.col("toxic").alias("y_b"),
            ((F.col("n_chars") % 997).cast("double") / F.lit(997.0)).alias("p_a"),
            ((F.col("doc_id") % 89).cast("double") / F.lit(89.0)).alias("p_b"),
        )
        return wide

    @cached_property
    def scored_long(self) -> DataFrame:
        return self.scored.select(
            F.col("doc_id").alias("row_id"),
            F.inline(F.array(
                F.struct(F.lit("is_enhancer").alias("head"), F.col("y_a").alias("y"), F.col("p_a").alias("p")),
                F.struct(F.lit("is_silencer").alias("head"), F.col("y_b").alias("y"), F.col("p_b").alias("p")),
            )))

    @cached_property
    def genome(self) -> DataFrame:
        """Letters of a text stand for bases; anything else is N."""
        src = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        dst = ("ACGT" * 7)[:26] * 2
        return self.table("documents").select(
            F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"),
            F.regexp_replace(F.translate("text", src, dst), "[^ACGT]", "N").alias("seq"),
        )

    @cached_property
    def peak_rows(self) -> DataFrame:
        """The peak of each footprint; a cell repeats a peak as often as it has footprints in it."""
        return self.footprints.select("grp", "subtype", "sample", "cell_id", "chrom", F.col("peak_start").alias("r_start"),
                                      F.col("peak_end").alias("r_end"))

    @cached_property
    def peaks(self) -> DataFrame:
        """Peaks seen in each cell, kept as a stage because many counts start from it."""
        return durable(self.peak_rows.distinct())

    @cached_property
    def region_tags(self) -> DataFrame:
        return self.classified_peaks.withColumnRenamed("raw", "tag")

    @cached_property
    def classified_peaks(self) -> DataFrame:
        """Per-cell peaks with the raw class of each annotation or gene they touch."""
        from regspan.operators.intervals import join_interval

        key = ["chrom", "r_start", "r_end"]
        # a stage, because the joins read the sites several times
        sites = durable(dealt(self.peak_rows.select(*key), self.tasks, *key).distinct())
        # sites and footprints are short spans
        ann = join_interval(sites, self.annotations, ("r_start", "r_end"), ("ann_start", "ann_end"), left_levels=1, tasks=self.tasks)
        gene = join_interval(sites, self.genes.select("chrom", (F.col("gene_start") - 1).alias("g0"), "gene_end"),
                             ("r_start", "r_end"), ("g0", "gene_end"), left_levels=1, tasks=self.tasks)
        raw = ann.select(*key, F.col("ann_class").alias("raw")).union(gene.select(*key, F.lit("gene_body").alias("raw")))
        return durable(dealt(raw, self.tasks, *key).distinct())

    def source_rows(self) -> dict[str, DataFrame]:
        """The five per-cell sources that presence counting reads."""
        key = ["chrom", "r_start", "r_end"]
        tags = self.classified_peaks
        hit = self.peaks.join(tags, key)
        pick = lambda raw: hit.where(F.col("raw") == raw).drop("raw")
        return {
            "enhancer": pick("enhancer"),
            "gtf": pick("gene_body"),
            "promoter": pick("promoter"),
            "regulome": hit.where(~F.col("raw").isin("enhancer", "gene_body", "promoter")).withColumnRenamed(
                "raw", "regulome_type"),
            "unknown": self.peaks.join(tags.select(*key).distinct(), key, "left_anti"),
        }

    @cached_property
    def source_tags(self) -> DataFrame:
        """The union of the five sources, formed in one pass over the peaks."""
        key = ["chrom", "r_start", "r_end"]
        return self.peaks.join(self.classified_peaks, key, "left").withColumn(
            "tag", F.coalesce("raw", F.lit("uncharacterized"))).drop("raw")

    def one_group(self, df: DataFrame) -> DataFrame:
        """The same rows as a single group of subtypes."""
        return df.withColumn("grp", F.lit("ALL"))

    def one_group_of_labels(self, df: DataFrame) -> DataFrame:
        """A single group in which every (group, subtype) is a subtype of its own."""
        return df.withColumn("subtype", F.concat("grp", F.lit("__"), "subtype")).withColumn("grp", F.lit("ALL"))

    def peak_labels(self) -> DataFrame:
        """Overlap rows of footprint peaks with typed annotations and genes, in the corpus schema.

        Annotations and genes are one reference side, so footprints go through one shuffle of the interval join; its salts
        are planned from the lines as they are read, without joins.
        """
        from regspan.operators.intervals import join_interval

        cols = ["chrom", "peak_start", "peak_end", "tf_motif", "motif_score", "fp_score"]
        f = self.footprints_by_order.select("fp_start", "fp_end", *cols)
        ann = self.annotations.select("chrom", F.col("ann_start").alias("ref_start"), F.col("ann_end").alias("ref_end"),
                                      R.recode_regulome("ann_class").alias("label"))
        gene = self.genes.select("chrom", (F.col("gene_start") - 1).alias("ref_start"), F.col("gene_end").alias("ref_end"),
                                 F.lit("genic").alias("label"))
        return join_interval(f, ann.unionByName(gene), ("fp_start", "fp_end"), ("ref_start", "ref_end"), left_levels=1,
                             tasks=self.tasks, seen=self.table("lineitem").select(*_sites())).select(*cols, "label")
