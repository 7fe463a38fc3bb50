"""Source alignment, file resolution, rosters, ledgers and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from regspan.functions import recode as R
from regspan.functions.coords import coord, number, whole
from regspan.session import durable

# ---- fixed values: where each overlap layout keeps the common fields ----
COMMON_FIELDS = {
    "enhancer": ("Chromosome", "Extra7_b", "Extra8_b", "Extra3_b", "Extra4_b", "Extra16"),
    "regulome": ("Chromosome", "Extra7", "Extra8", "Extra3_b", "Extra4_b", "Extra16"),
    "promoter": ("chrom", "peak_start", "peak_end", "tf_motif", "motif_score", "fp_score"),
    "gtf": ("Chromosome", "Extra7", "Extra8", "Extra3", "Extra4", "Extra16"),
}
FIXED_LABEL = {"enhancer": "enhancer", "promoter": "promoter", "gtf": "genic"}

OVERLAP_SUFFIXES = {
    "enhancer": ["_merged_overlaps_enhancer.csv", "_BD_merged_overlaps_enhancer.csv"],
    "regulome": ["_merged_overlaps_REGULOME.csv", "_BD_merged_overlaps_REGULOME.csv"],
    "promoter": ["_merged_overlaps_PROMOTER.bed", "_BD_merged_overlaps_PROMOTER.bed"],
    "gtf": ["__merged_overlaps_GTF.csv", "_merged_overlaps_GTF.csv", "_BD__merged_overlaps_GTF.csv",
            "_BD_merged_overlaps_GTF.csv"],
}
# ---- end of fixed values ----


def proj_common_schema(overlaps: DataFrame, kind: str) -> DataFrame:
    """One overlap layout as (chrom, peak_start, peak_end, tf_motif, motif_score, fp_score, label)."""
    chrom, lo, hi, motif, score, fp = COMMON_FIELDS[kind]
    label = F.lit(FIXED_LABEL[kind]) if kind in FIXED_LABEL else R.recode_regulome("Extra3")
    rows = overlaps if kind != "regulome" else overlaps.where(F.col("Extra3").isNotNull())
    return rows.select(
        (R.fix_chrom(chrom) if kind == "regulome" else F.col(chrom)).alias("chrom"),
        whole(lo).alias("peak_start"), whole(hi).alias("peak_end"), F.col(motif).alias("tf_motif"),
        number(score).alias("motif_score"), number(fp).alias("fp_score"), label.alias("label"),
    ).where("peak_start IS NOT NULL AND peak_end IS NOT NULL AND tf_motif <> ''")


def scan_source_map(enhancer: DataFrame, gtf: DataFrame, promoter: DataFrame, regulome: DataFrame,
                    unknown: DataFrame) -> DataFrame:
    """Five per-cell sources as one table with a ``tag``; the regulome brings its own tag per row."""
    typ = F.trim("regulome_type")
    blank = typ.isNull() | typ.isin("", "nan", "None")
    tagged = [
        enhancer.withColumn("tag", F.lit("enhancer")),
        gtf.withColumn("tag", F.lit("gene_body")),
        promoter.withColumn("tag", F.lit("promoter")),
        regulome.withColumn("tag", F.when(blank, "regulome").otherwise(typ)).drop("regulome_type"),
        unknown.withColumn("tag", F.lit("uncharacterized")),
    ]
    return reduce(DataFrame.unionByName, tagged)


def scan_resolve_file(listing: DataFrame) -> DataFrame:
    """One overlap file per (dir, cell stem, kind): ordered suffixes first, then any name that fits.

    ``listing`` has dir, stem and path: the files seen next to a cell. Of
    fall-back matches the first path in name order is taken.
    """
    table = [F.struct(F.lit(kind).alias("kind"), F.lit(s).alias("suffix"), F.lit(i).alias("prio"))
             for kind, suffixes in OVERLAP_SUFFIXES.items() for i, s in enumerate(suffixes)]
    table += [F.struct(F.lit(kind).alias("kind"), F.lit("").alias("suffix"), F.lit(99).alias("prio"))
              for kind in OVERLAP_SUFFIXES]
    word = F.when(F.col("c.kind") == "enhancer", "enhancer").otherwise(F.upper("c.kind"))
    name = F.element_at(F.split("path", "/"), -1)
    tail = F.substring(name, F.instr(name, F.col("stem")) + F.length("stem"), 1 << 20)
    exact = name == F.concat("stem", F.col("c.suffix"))
    loose = (F.col("c.prio") == 99) & (F.instr(name, F.col("stem")) > 0) & (F.instr(tail, word) > 0)
    hits = listing.select("*", F.explode(F.array(*table)).alias("c")).where(
        F.when(F.col("c.prio") == 99, loose).otherwise(exact))
    return hits.groupBy("dir", "stem", F.col("c.kind").alias("kind")).agg(
        F.min_by("path", F.struct("c.prio", "path")).alias("path"))


def path_roster(files: DataFrame, groups: Sequence[str] = tuple(R.ROSTER_GROUPS)) -> DataFrame:
    """(group, subtype) with directories and cell counts; ``files`` has source, subtype, dir, path.

    Only ``groups`` enter; ``place`` is the position of a group among them, from 1, to order the roster by.
    """
    named = files.withColumn("grp", R.recode_group("source")).where(F.col("grp").isin(*groups))
    per_dir = named.groupBy("grp", "subtype", "dir").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, groups)), F.col("grp")).cast("int")
    return per_dir.groupBy("grp", "subtype").agg(
        F.count("*").alias("n_dirs"), F.sum("n").alias("total_cells"),
        F.array_join(F.sort_array(F.collect_list("dir")), ";").alias("dirs")).withColumn("place", place)


def incr_skip_done(cells: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Cells with no finished, non-empty output yet; ``ledger`` has the key and ``size``."""
    return cells.join(ledger.where("size > 0").select(*key).distinct(), key, "left_anti")


def dataset_info(corpus: DataFrame, rows: DataFrame) -> DataFrame:
    """Long summary: totals, vocabulary sizes and rows per class, from one pass over each side."""
    per = durable(corpus.groupBy("primary_label").agg(F.count("*").alias("n")))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("n_regions").alias("item"), "n")
    sizes = rows.agg(F.count_distinct("tf_motif").alias("tfs"), F.count_distinct("label").alias("labels"))
    words = sizes.select(F.inline(F.array(*[F.struct(F.lit(name).alias("item"), F.col(c).cast("bigint").alias("n"))
                                            for name, c in (("n_tfs", "tfs"), ("n_classes", "labels"))])))
    return total.union(words).union(per.select(F.concat(F.lit("class:"), "primary_label").alias("item"), "n"))


def sort_corpus(corpus: DataFrame) -> DataFrame:
    """Total order, so that row position never depends on the plan."""
    return corpus.orderBy("chrom", "peak_start", "peak_end")


def sink_parquet(corpus: DataFrame, path: str) -> None:
    """Zstd Parquet by chromosome, ordered by position.

    Tasks write sampled ranges of positions, so a long chromosome is shared by as many as its size asks for.
    """
    (corpus.repartitionByRange("chrom", "peak_start", "peak_end").sortWithinPartitions("chrom", "peak_start", "peak_end")
     .write.mode("overwrite").option("compression", "zstd").partitionBy("chrom").parquet(path))


def metadata_rows(corpus: DataFrame) -> DataFrame:
    return corpus.select(coord("chrom", "peak_start", "peak_end").alias("coord"),
                         F.col("primary_label").alias("label"),
                         F.array_join(F.sort_array("all_labels"), "|").alias("all_labels"), "n_tfs")


def sink_metadata(corpus: DataFrame, path: str) -> None:
    metadata_rows(corpus).write.mode("overwrite").option("header", True).csv(path)


def sink_topn_exports(ranked: DataFrame, path: str, by: str = "subtype", score: str = "divergence_std",
                      tie: str = "tf", sizes: tuple[int, ...] = (25, 50)) -> DataFrame:
    """Full ranking and top-n lists per group, written by (list, group)."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie)))
    full = ranked.withColumn("rank", rn)
    lists = F.array(*[F.when(F.col("rank") <= n, F.lit(f"top{n}")) for n in sizes], F.lit("full"))
    out = full.withColumn("list", F.explode(F.array_compact(lists)))
    out.write.mode("overwrite").partitionBy("list", by).parquet(path)
    return out.sparkSession.read.parquet(path)
