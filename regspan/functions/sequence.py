"""Base-level column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seq_base_codes(seq: str | Column) -> Column:
    """A, C, G, T as 0..3, any other letter as 255."""
    codes = F.create_map(*[F.lit(v) for pair in zip("ACGT", range(4)) for v in pair])
    letters = F.filter(F.split(F.upper(_col(seq)), ""), lambda base_letter: base_letter != "")
    return F.transform(letters, lambda base_letter: F.coalesce(codes[base_letter], F.lit(255)))


def seq_revcomp(seq: str | Column) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


def kmers(seq: str | Column, k: int = 6) -> Column:
    """All k-mers of a sequence in order, overlapping; N and other letters are read as A.

    A zero-width lookahead finds every start in one pass over the text.
    """
    return F.regexp_extract_all(F.regexp_replace(_col(seq), "[^ACGT]", "A"), F.lit(f"(?=(.{{{k}}}))"), F.lit(1))
