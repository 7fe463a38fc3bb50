"""SimHash fingerprints and their groups within a Hamming radius, found by covering locality-sensitive hashing.

A covering family for radius r maps each of the 64 bit positions to a non-zero vector of r + 1 bits. There is a
table for every non-zero vector v; its mask holds the positions whose vector has an odd inner product with v. The
vectors of any r differing positions span at most r dimensions, so some v is orthogonal to all of them and the two
fingerprints agree under its mask: a pair within the radius always meets in some table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame, functions as F

from regspan.llm import components as CC
from regspan.llm.common import map_rows
from regspan.session import durable

SEED, SECOND_SEED = 42, 43
#: Fingerprints compared at once inside one bucket; a larger bucket is compared block by block.
BLOCK = 4096
_SPACE = re.compile(rb"[ \t-\r]")
_HASHES = 1 << 16


def word_blocks(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of ``raw`` in order, a bounded stretch of bytes at a time (one longer word stays whole)."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            gap = _SPACE.search(raw, end)
            end = gap.start() if gap else len(raw)
        yield raw[at:end].split()
        at = end


def _digests(raw: bytes, words: int, seed: int) -> Iterator[bytes]:
    """Joined big-endian XXH64 digests of all shingles, in bounded runs."""
    carry: list[bytes] = []
    any_shingle = False
    for block in word_blocks(raw):
        carry += block
        n = len(carry) - words + 1
        for lo in range(0, n, _HASHES):
            part = carry[lo:min(lo + _HASHES, n) + words - 1]
            shingles = map(b" ".join, zip(*(part[i:] for i in range(words))))
            yield b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed)))
            any_shingle = True
        if n > 0:
            carry = carry[n:]
    if not any_shingle and carry:
        yield xxhash.xxh64_digest(b" ".join(carry), seed)


def fingerprint(text: str | None, words: int = 4, seed: int = SEED) -> int:
    """Unsigned fingerprint of one whole text; 0 without words."""
    counts, n = np.zeros(64, np.int64), 0
    for run in _digests((text or "").encode().lower(), words, seed):
        bits = np.unpackbits(np.frombuffer(run, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
        n += len(bits)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 4, second: bool = False) -> DataFrame:
    """(doc_id, fp, second: signed 64-bit) of every row of ``df`` (doc_id, text); null texts count as empty.

    ``second`` is a fingerprint under another seed, or 0 for all.
    """

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            seeds = (SEED, SECOND_SEED) if second else (SEED,)
            raw = [np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64) for seed in seeds]
            raw += [np.zeros(len(texts), np.int64)] * (2 - len(raw))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, raw)], ["doc_id", "fp", "second"])

    return map_rows(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")),
                    run, "doc_id bigint, fp bigint, second bigint")


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering family, as signed 64-bit numbers."""
    if radius > 6:
        raise ValueError("64 positions cannot fill the masks of a radius above 6")
    # every mask holds 32 positions or more: all non-zero vectors in turn, or for radius 6 those with the highest bit
    vectors = [64 + i if radius == 6 else 1 + i % ((1 << radius + 1) - 1) for i in range(64)]
    out = []
    for v in range(1, 1 << radius + 1):
        bits = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        out.append(bits - (1 << 64) if bits >> 63 else bits)
    return out


def spanning(rows: np.ndarray, radius: int, second_radius: int | None = None) -> list[tuple[int, np.ndarray]]:
    """Links (one id, other ids) that join all of ``rows`` (fp, second, id) that reach each other.

    Two link when their fp differ in ``radius`` bits at most and their seconds in ``second_radius`` (twice ``radius``
    unless given). Breadth-first over what is left, so a dense group costs a few passes and gives fewer links than members.
    """
    beside = 2 * radius if second_radius is None else second_radius
    out, left = [], rows
    while left.shape[1] > 1:
        queue, left = [left[:, 0]], left[:, 1:]
        while queue and left.shape[1]:
            fp, second, one = queue.pop()
            near = (np.bitwise_count((left[0] ^ fp).view(np.uint64)) <= radius) & (np.bitwise_count((left[1] ^ second).view(np.uint64)) <= beside)
            if near.any():
                found = left[:, near]
                out.append((one, found[2]))
                queue.extend(found.T)
                left = left[:, ~near]
    return out


_ROW = ["t", "k", "fp", "second", "id"]
_LINKS = "u bigint, v bigint, t int, k bigint, fp bigint, second bigint, id bigint, block int"


def _bucket_links(radius: int, block_rows: int, second_radius: int | None):
    """Links inside the buckets of rows sorted by (t, k); blocks of a larger bucket are passed on as well."""

    def batch(edges: list, tagged: list) -> pa.RecordBatch:
        u = np.concatenate([np.full(len(v), one) for one, v in edges] + [np.zeros(0, np.int64)]).astype(np.int64)
        v = np.concatenate([v for _, v in edges] + [np.zeros(0, np.int64)]).astype(np.int64)
        rows = np.hstack([np.vstack([part, np.full(part.shape[1], block)]) for part, block in tagged] + [np.zeros((6, 0), np.int64)])
        none = lambda n: pa.nulls(n, pa.int64())
        join = lambda x, n: pa.concat_arrays([pa.array(x, pa.int64()), none(n)])
        after = lambda x: pa.concat_arrays([none(len(u)), pa.array(x, pa.int64())])
        cols = [join(u, rows.shape[1]), join(v, rows.shape[1]), after(rows[0]).cast(pa.int32()), *[after(r) for r in rows[1:5]], after(rows[5]).cast(pa.int32())]
        return pa.RecordBatch.from_arrays(cols, ["u", "v", *_ROW, "block"])

    def run(batches):
        held = np.zeros((5, 0), np.int64)  # rows of the bucket that may go on
        block = 0  # how many blocks of it were passed on
        for b in batches:
            edges: list = []
            tagged: list = []
            held = np.hstack([held, np.vstack([b.column(c).to_numpy().astype(np.int64) for c in _ROW])])
            change = np.flatnonzero((held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [held.shape[1]]])
            for s, e in zip(starts[:-1], ends[:-1]):  # closed buckets
                goes_on = s == 0 and block > 0
                if e - s > 1 or goes_on:
                    for nth, lo in enumerate(range(s, e, block_rows)):
                        part = held[:, lo:min(e, lo + block_rows)]
                        edges += spanning(part[2:], radius, second_radius)
                        if goes_on or e - s > block_rows:
                            tagged.append((part, nth + block * goes_on))
                if s == 0:
                    block = 0
            held = held[:, starts[-1]:]
            while held.shape[1] > block_rows:
                part, held = held[:, :block_rows], held[:, block_rows:]
                edges += spanning(part[2:], radius, second_radius)
                tagged.append((part, block))
                block += 1
            yield batch(edges, tagged)
        yield batch(spanning(held[2:], radius, second_radius), [(held, block)] if block and held.shape[1] else [])

    return run


def links(nodes: DataFrame, radius: int = 4, block_rows: int = BLOCK, second_radius: int | None = None) -> DataFrame:
    """(u, v) links that connect all ids of ``nodes`` (id, fp, second) whose fingerprints lie near each other.

    Exact up to connectivity: two nodes that link are always in one connected set of the result. A bucket above
    ``block_rows`` is cut into blocks, and all pairs of blocks are compared in tasks of their own.
    """
    family = masks(radius)
    # the key follows from t and fp, so it is found again after the shuffle instead of being shipped
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, family)), F.col("t") + 1))
    tables = F.explode(F.sequence(F.lit(0), F.lit(len(family) - 1))).alias("t")
    rows = nodes.select("fp", "second", "id", tables).repartition("t", key).withColumn("k", key).sortWithinPartitions("t", "k", "fp")
    found = durable(rows.select(*_ROW).mapInArrow(_bucket_links(radius, block_rows, second_radius), _LINKS))
    edges = found.where("u IS NOT NULL").select("u", "v")
    hot = found.where("u IS NULL").select(*_ROW, "block")
    if hot.isEmpty():
        return edges

    last = hot.groupBy("t", "k").agg(F.max("block").alias("last"))
    paired = hot.join(last, ["t", "k"]).select(*_ROW, "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")).where("block <> other")
    keyed = paired.select(*_ROW, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def across(table: pa.Table) -> pa.Table:
        got = spanning(np.vstack([table.column(c).to_numpy() for c in _ROW[2:]]), radius, second_radius)
        u = np.concatenate([np.full(len(v), one) for one, v in got] + [np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({"u": u, "v": np.concatenate([v for _, v in got] + [np.zeros(0, np.int64)]).astype(np.int64)})

    return edges.union(keyed.groupBy("t", "k", "lo", "hi").applyInArrow(across, "u bigint, v bigint"))


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4, second: bool = False, block_rows: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Fingerprints link within ``radius`` bits; with ``second``, fingerprints under another seed must also lie within twice
    as many. ``component_id`` is the smallest doc_id reachable. Copies share a fingerprint and are one node from the start.
    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay repeated. A row without a
    doc_id is kept and has no component. A very long text is hashed in bounded stretches; a bit that exactly half of the
    hashes set is 0. An empty table gives no rows.
    """
    fps = durable(fingerprints(docs, words, second))
    nodes = durable(fps.where("doc_id IS NOT NULL").groupBy("fp", "second").agg(F.min("doc_id").alias("id")))
    roots = CC.components(links(nodes, radius, block_rows)).withColumnRenamed("node", "id")
    named = nodes.join(roots, "id", "left").select("fp", "second", F.coalesce("root", "id").alias("component_id"))
    return fps.join(named, ["fp", "second"], "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Near copies: five-word shingles, fingerprints of the set of words under so many seeds, bits in which one of them may
#: differ, and bits in which the sketches of the shingles may differ.
WORDS, WORD_SEEDS, WORD_RADIUS, SKETCH_RADIUS = 5, (42, 43), 4, 10
FINGERPRINTS = 2 * len(WORD_SEEDS)
_MIX = np.random.default_rng(7).integers(1, 1 << 63, (2, 64), dtype=np.uint64) * 2 + 1
_SKETCH_RUN = 2048


def _word_fingerprints(raw: bytes) -> list[int]:
    """Fingerprints of the set of words of ``raw``: each seed's 128-bit digest gives two."""
    words: set[bytes] = set()
    for block in word_blocks(raw):
        words.update(block)
    if not words:
        return [0] * FINGERPRINTS
    counts = []
    for seed in WORD_SEEDS:
        total = np.zeros(128, np.int64)
        each = iter(words)
        while run := list(islice(each, _HASHES)):
            digests = b"".join(map(xxhash.xxh3_128_digest, run, repeat(seed)))
            total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
        counts.append(total)
    packed = np.packbits(np.concatenate(counts) * 2 > len(words)).tobytes()
    return [int.from_bytes(packed[8 * i:8 * i + 8], "big") for i in range(FINGERPRINTS)]


def _sketch(raw: bytes, words: int) -> int:
    """64 bits, one of the least hash of the shingles under each of 64 mixes.

    A bit is the same with probability 1 where two sets have that least shingle in common, so sets of Jaccard similarity J
    differ in 32 (1 - J) bits on average, whatever kind of words they differ in.
    """
    least = np.full(64, np.iinfo(np.uint64).max, np.uint64)
    for run in _digests(raw, words, SEED):
        h = np.frombuffer(run, ">u8").astype(np.uint64)
        for lo in range(0, len(h), _SKETCH_RUN):
            np.minimum(least, ((h[lo:lo + _SKETCH_RUN, None] ^ _MIX[0]) * _MIX[1]).min(axis=0), out=least)
    return int.from_bytes(np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(bool)).tobytes(), "big")


def marks(text: str | None, words: int = WORDS) -> tuple[list[int], int]:
    """Word-set fingerprints and the shingle sketch of a whole text, unsigned; those of an empty text are fixed values."""
    raw = (text or "").encode().lower()
    return _word_fingerprints(raw), _sketch(raw, words)


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = WORD_RADIUS, sketch_radius: int = SKETCH_RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its near-copy group; one row of each repeated doc_id stays.

    A changed word changes five shingles but one word, so near copies lie much closer in the fingerprints of their words
    than in one of their shingles: at a shingle similarity of 0.8, four bits of 64 instead of ten. Four word fingerprints go
    through the covering tables, a pair within ``radius`` in any of them is a candidate, and its shingle sketches must
    differ in ``sketch_radius`` bits at most (a similarity of about 0.7 on average, so that one of 0.8 seldom fails).
    Texts of equal marks are one node from the start. Null and empty texts are copies of each other. Rows without a doc_id
    cannot be told apart by id and stay. An empty table stays empty; other columns are kept as they are.
    """
    cols = [f"f{i}" for i in range(FINGERPRINTS)]

    def run(batches):
        for b in batches:
            got = [marks(t, words) for t in b.column("text").to_pylist()]
            every = np.array([[*fps, sketch] for fps, sketch in got], np.uint64).reshape(-1, len(cols) + 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, np.ascontiguousarray(every.T))], ["doc_id", *cols, "second"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    marked = durable(map_rows(texts, run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in [*cols, "second"])))
    nodes = durable(marked.groupBy(*cols, "second").agg(F.min("doc_id").alias("id")))
    edges = None
    for c in cols:
        found = links(nodes.select("id", F.col(c).alias("fp"), "second"), radius, second_radius=sketch_radius)
        edges = found if edges is None else edges.union(found)
    roots = CC.components(edges).withColumnRenamed("node", "id")
    named = nodes.join(roots, "id", "left").where("root IS NULL OR root = id").select(F.col("id").alias("_kept"))
    kept = durable(named.join(marked.groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_n")), "_kept"))
    # the kept ids grow with the documents: never a broadcast, and no sort of texts; whole texts are shuffled once
    once = docs.join(kept.where("_n = 1").hint("shuffle_hash"), docs.doc_id == F.col("_kept"), "left_semi")
    again = docs.join(kept.where("_n > 1"), docs.doc_id == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return once.union(again).union(docs.where("doc_id IS NULL"))
