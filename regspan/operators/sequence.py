"""Sequence windows from a tiled genome, and k-mer frequencies.

A genome travels as rows of bounded size: pieces (chrom, offset, piece), or tiles that run one window into the next tile.
k-mers are integer codes, two bits a base, that roll along the pieces and are counted into cells inside tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regspan.operators.scale import salted_join

WINDOW = 512
TILE = 65_536
#: Bases of a sequence that are counted at once; up to this many cells a count is dense.
PIECE, DENSE_CELLS = 65_536, 1 << 20


def _stretches(seq: str, step: int, extra: int) -> tuple[Column, Column]:
    """Where stretches of ``step`` bases begin (to be exploded), and the stretch at ``_at`` with ``extra`` more bases.

    Stretches are cut from the bytes, where a position needs no walk from the start; a base is one ASCII letter.
    """
    n = F.octet_length(seq).cast("bigint")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)), F.lit(step).cast("bigint")))
    return starts, F.substring(F.col(seq).cast("binary"), (F.col("_at") + 1).cast("int"), F.lit(step + extra))


def genome_pieces(genome: DataFrame, size: int = PIECE) -> DataFrame:
    """(chrom, offset, piece) of chromosomes that come as one text each."""
    starts, piece = _stretches("seq", size, 0)
    return genome.where("seq IS NOT NULL").select("chrom", "seq", starts.alias("_at")).select("chrom", F.col("_at").alias("offset"), piece.cast("string").alias("piece"))


def tile_genome(genome: DataFrame, tile: int = TILE, window: int = WINDOW) -> DataFrame:
    """Chromosomes that come as one text each, cut into tiles that run ``window`` bases into the next one; no shuffle."""
    if tile < window:
        raise ValueError("a tile must be at least one window long")
    starts, piece = _stretches("seq", tile, window)
    d = genome.where("seq IS NOT NULL").select("chrom", "seq", F.octet_length("seq").cast("bigint").alias("chrom_len"), starts.alias("_at"))
    return d.select("chrom", "chrom_len", F.expr(f"_at div {tile}").alias("tile"), piece.cast("string").alias("piece"))


def tile_pieces(pieces: DataFrame, tile: int = TILE, window: int = WINDOW) -> DataFrame:
    """The tiles of ``tile_genome`` from pieces (chrom, offset, piece) without gaps, of any bounded size, such as text lines.

    A piece goes to each tile that needs some of it; no row is longer than a piece or a tile and a window.
    """
    if tile < window:
        raise ValueError("a tile must be at least one window long")
    end = F.col("offset") + F.length("piece")
    size = pieces.groupBy("chrom").agg(F.max(end).alias("chrom_len"))
    first = F.greatest(F.floor((F.col("offset") - window) / F.lit(tile)), F.lit(0).cast("bigint"))
    last = F.greatest(F.floor((end - 1) / F.lit(tile)), F.lit(0).cast("bigint"))
    d = pieces.select("chrom", "offset", "piece", F.explode(F.sequence(first, F.greatest(first, last))).alias("tile"))
    lo = F.greatest(F.col("offset"), F.col("tile") * tile)
    hi = F.least(F.col("offset") + F.length("piece"), (F.col("tile") + 1) * tile + window)
    part = F.substring("piece", (lo - F.col("offset") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(lo.alias("at"), part.alias("part")))), lambda x: x["part"]), "")
    return d.groupBy("chrom", "tile").agg(whole.alias("piece")).join(size, "chrom").select("chrom", "chrom_len", "tile", "piece")


def seq_window(peaks: DataFrame, tiles: DataFrame, start: str = "peak_start", end: str = "peak_end",
               tile: int = TILE, window: int = WINDOW) -> DataFrame:
    """``window`` bases around the midpoint, cut at the chromosome ends, padded with N on the right, upper case.

    At a chromosome start the padding is on the right too, so the centre moves.
    Windows are made distinct before the join; many cells share a peak.
    """
    left = F.expr(f"({start} + {end}) div 2 - {window // 2}")
    spans = peaks.select("chrom", start, end).distinct().withColumn("_l", left).withColumn(
        "_s", F.greatest(F.col("_l"), F.lit(0))).withColumn("tile", F.expr(f"_s div {tile}"))
    d = spans.join(tiles, ["chrom", "tile"])
    n = F.greatest(F.least(F.col("_l") + window, F.col("chrom_len")) - F.col("_s"), F.lit(0))
    raw = F.substring("piece", (F.col("_s") - F.col("tile") * tile + 1).cast("int"), n.cast("int"))
    got = d.select("chrom", start, end, F.rpad(F.upper(raw), window, "N").alias("sequence"))
    return salted_join(peaks, got, ["chrom", start, end])


_CODE = np.zeros(256, np.int64)  # other letters are read as A
_CODE[[*b"CGT"]] = 1, 2, 3


def kmer_codes(bases: bytes, k: int) -> np.ndarray:
    """The code of each k-mer in order, two bits a base, the first base highest."""
    code = _CODE[np.frombuffer(bases, np.uint8)]
    n = max(0, len(code) - k + 1)
    out = np.zeros(n, np.int64)
    for j in range(k):
        out = out << 2 | code[j:j + n]
    return out


def kmer_names(codes: np.ndarray, k: int) -> pa.Array:
    """The letters of codes."""
    letters = np.frombuffer(b"ACGT", np.uint8)[codes[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3]
    return pa.array(np.ascontiguousarray(letters).view(f"S{k}").ravel().astype(str), pa.string())


def _count_pieces(key: list[str], k: int):
    cells = 4 ** k

    def run(batches):
        for b in batches:
            at, pieces = b.column("_at").to_pylist(), b.column("_piece").to_pylist()
            rows, codes, counts = [], [], []
            open_: list[np.ndarray] = []

            def close(row: int) -> None:
                every = np.concatenate(open_)
                if len(every):
                    if cells <= DENSE_CELLS:
                        n = np.bincount(every, minlength=cells)
                        found = np.flatnonzero(n)
                        n = n[found]
                    else:
                        found, n = np.unique(every, return_counts=True)
                    rows.append(row)
                    codes.append(found)
                    counts.append(n)
                open_.clear()

            for i, (lo, piece) in enumerate(zip(at, pieces)):
                if open_ and lo == 0:
                    close(i - 1)
                open_.append(kmer_codes(piece, k))  # pieces of one sequence follow each other
            if open_:
                close(len(at) - 1)
            places = np.cumsum([0, *map(len, codes)])
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([*codes, np.zeros(0, np.int64)])), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]))], ["code", "n"])
            hist = pa.ListArray.from_arrays(pa.array(places, pa.int32()), flat)
            keys = [b.column(c).take(pa.array(rows, pa.int64())) for c in [*key, "_n"]]
            yield pa.RecordBatch.from_arrays([*keys, hist], [*key, "_n", "hist"])

    return run


def _name_kmers(key: list[str], k: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in key], kmer_names(b.column("code").to_numpy(), k), b.column("freq")], [*key, "kmer", "freq"])

    return run


def seq_kmer(seqs: DataFrame, key: list[str], seq: str = "sequence", k: int = 6) -> DataFrame:
    """k-mer frequencies per sequence, long; the divisor is the number of places in the full length.

    Letters other than A, C, G, T are read as A. A sequence is counted piece by piece into 4^k cells; what crosses the
    shuffle is one row of counts per sequence (and batch of its pieces), not one per base.
    """
    ascii_only = F.when(F.octet_length(seq) == F.length(seq), F.col(seq)).otherwise(F.regexp_replace(seq, "[^\\x00-\\x7F]", "N"))
    d = seqs.select(*key, ascii_only.alias("_seq")).where("_seq IS NOT NULL")
    starts, piece = _stretches("_seq", PIECE, k - 1)
    places = F.greatest(F.octet_length("_seq").cast("bigint") - (k - 1), F.lit(1).cast("bigint"))
    cut = d.select(*key, "_seq", places.alias("_n"), starts.alias("_at")).select(*key, "_n", "_at", piece.alias("_piece"))
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    typed = ", ".join(f"{c} {kinds[c]}" for c in key)
    counted = cut.mapInArrow(_count_pieces(key, k), f"{typed}, _n bigint, hist array<struct<code: bigint, n: bigint>>")
    held = counted.groupBy(*key, "_n").agg(F.collect_list("hist").alias("hists"))
    one = held.where(F.size("hists") == 1).select(*key, "_n", F.inline(F.get("hists", F.lit(0))))
    more = held.where(F.size("hists") > 1).select(*key, "_n", F.inline(F.flatten("hists"))).groupBy(*key, "_n", "code").agg(F.sum("n").alias("n"))
    every = one.union(more).select(*key, "code", (F.col("n") / F.col("_n")).alias("freq"))
    return every.mapInArrow(_name_kmers(key, k), f"{typed}, kmer string, freq double")
