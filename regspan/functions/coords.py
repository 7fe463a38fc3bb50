"""Coordinates, names and other small column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole(x: str | Column) -> Column:
    """Text to a whole number, junk to NULL; a fraction is cut off, not rounded."""
    c = F.col(x) if isinstance(x, str) else x
    return c.try_cast("double").try_cast("bigint")


def number(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return c.try_cast("double")


def clean_number(x: str | Column) -> Column:
    """NULL and NaN scores count as zero."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def midpoint(start: str, end: str) -> Column:
    return F.expr(f"({start} + {end}) div 2")


def coord(chrom: str, start: str, end: str) -> Column:
    """``chr1:10-20``."""
    return F.concat(F.col(chrom), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def region_id(cls: str, chrom: str, start: str, end: str) -> Column:
    """``class|chr1:10-20``."""
    return F.concat(F.col(cls), F.lit("|"), coord(chrom, start, end))


def parse_coord(x: str) -> list[Column]:
    """chrom, start and end of ``chr1:10-20``; NULL when the text has another form."""
    pat = r"^(chr\w+):(\d+)-(\d+)"
    part = lambda i: F.nullif(F.regexp_extract(x, pat, i), F.lit(""))
    return [part(1).alias("chrom"), part(2).cast("bigint").alias("r_start"), part(3).cast("bigint").alias("r_end")]


def tf_short(motif: str | Column) -> Column:
    """Name before the matrix accession: ``TF1_MA0001`` gives ``TF1``."""
    c = F.col(motif) if isinstance(motif, str) else motif
    return F.substring_index(c, "_MA", 1)


def log2_ratio(a: Column, b: Column, pseudo: float) -> Column:
    return F.log2((a + F.lit(pseudo)) / (b + F.lit(pseudo)))


def stars(fdr: str | Column) -> Column:
    c = F.col(fdr) if isinstance(fdr, str) else fdr
    return F.when(c < 0.001, "***").when(c < 0.01, "**").when(c < 0.05, "*").otherwise("")
