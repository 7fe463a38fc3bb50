"""Ranked lexical search by buckets of vector lengths.

A document is the vector of its impacts: for each term of the queries the term's weight times its saturated frequency, all
in integers. A query is the vector of its terms' repeats, so a score is an inner product. Vectors are ordered by length and
cut into buckets. A query skips a bucket when its own length times the longest vector there stays below the score that it
already holds as its k-th best (Cauchy-Schwarz). Inside a bucket the largest impact of each coordinate says which
coordinates can be left aside without losing a winner; only documents with one of the others are looked at, and their
partial score plus a bound of the rest (the smaller of the coordinates' largest impacts and Cauchy-Schwarz on what is left
of the vector) must reach that score. Survivors are scored again over all coordinates in 64-bit integers.

The partition with the longest vectors is searched first; the k-th scores found there bound the search of all others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from regspan.llm.common import map_slices
from regspan.session import durable

TOP = 10
#: Documents of one bucket, and bytes of query texts that are searched at once.
BUCKET, QUERY_BYTES = 4096, 16 << 20
_STRETCH = 1 << 22
#: Bounds are floating; they are widened by this share so that rounding never drops a document.
_SLACK = 1e-9
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term (UTF-8) of a whole text, a bounded stretch at a time; null has none."""
    raw, found, at = (text or "").encode().translate(_FOLD), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + _STRETCH)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


@dataclass
class Collection:
    """What scores need from all documents: ``docs`` with a term, ``length`` in terms, and the weight of each query term."""

    docs: int
    length: int
    weight: np.ndarray

    @staticmethod
    def of(docs: int, length: int, holding: np.ndarray) -> Collection:
        return Collection(docs, length, np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(df) + 1))) for df in holding], np.int64))

    def impacts(self, terms: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Impact of each (term, tf) entry in a document of ``n`` terms."""
        m = 25 + 75 * n.astype(np.int64) * self.docs // self.length
        tf = tf.astype(np.int64)
        return self.weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


@dataclass
class Rows:
    """Sparse vectors one after another: row i holds the entries from ``starts[i]`` to ``starts[i + 1]``."""

    ids: np.ndarray
    unnamed: np.ndarray  # rows whose id is null
    starts: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, collection: Collection) -> Rows:
        doc, terms = batch.column("doc_id"), batch.column("terms")
        starts = terms.offsets.to_numpy().astype(np.int64)
        flat = terms.values.to_numpy()[starts[0]:starts[-1]]  # a slice keeps the values of the whole
        at = batch.column("tfs").offsets.to_numpy()
        tf = batch.column("tfs").values.to_numpy()[at[0]:at[-1]]
        starts = starts - starts[0]
        impacts = collection.impacts(flat, tf, np.repeat(batch.column("n").to_numpy(), np.diff(starts)))
        norm = np.sqrt(_row_sums(impacts.astype(np.float64) ** 2, starts))
        return Rows(doc.fill_null(0).to_numpy(), np.asarray(doc.is_null()), starts, flat.astype(np.int64), impacts, norm)


def _row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's entries; no row is empty."""
    return np.add.reduceat(values, starts[:-1]) if len(values) else np.zeros(len(starts) - 1, values.dtype)


class Bucket:
    """Documents of similar vector length, with the entries of each coordinate in one run."""

    def __init__(self, rows: Rows):
        self.rows = rows
        n = len(rows.ids)
        order = np.argsort(rows.terms, kind="stable")
        self.row = np.repeat(np.arange(n), np.diff(rows.starts))[order]
        self.impact = rows.impacts[order].astype(np.float64)
        terms = rows.terms[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        self.terms, self.run = terms[first], np.append(first, len(terms))
        self.largest = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.longest = rows.norm.max(initial=0.0)

    def _entries(self, runs: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, impacts and repeats of all entries of some coordinates."""
        spans = [slice(a, b) for a, b in zip(self.run[runs], self.run[runs + 1])]
        sizes = self.run[runs + 1] - self.run[runs]
        return np.concatenate([self.row[s] for s in spans]), np.concatenate([self.impact[s] for s in spans]), np.repeat(repeats, sizes)

    def survivors(self, terms: np.ndarray, repeats: np.ndarray, least: int) -> np.ndarray:
        """Rows that may score ``least`` or more; ``terms`` ascend."""
        none = np.zeros(0, np.int64)
        if math.sqrt(float((repeats ** 2).sum())) * self.longest * (1 + _SLACK) < least or not len(self.terms):
            return none
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        runs, repeats = at[here], repeats[here].astype(np.float64)
        most = self.largest[runs] * repeats
        order = np.argsort(-most, kind="stable")
        rest = np.cumsum(most[order][::-1])[::-1]  # what the coordinates from here on can give at most
        if not len(rest) or rest[0] * (1 + _SLACK) < least:
            return none
        kept = int((rest * (1 + _SLACK) >= least).sum())
        focus, left = order[:kept], order[kept:]
        row, impact, times = self._entries(runs[focus], repeats[focus])
        n = len(self.rows.ids)
        partial = np.bincount(row, impact * times, n)
        beyond = np.sqrt(np.maximum(self.rows.norm ** 2 * (1 + _SLACK) - np.bincount(row, impact ** 2, n), 0.0))
        bound = np.minimum(rest[kept] if kept < len(rest) else 0.0, beyond * math.sqrt(float((repeats[left] ** 2).sum())))
        return np.flatnonzero((partial > 0) & ((partial + bound) * (1 + _SLACK) + 1 >= least))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``query`` has the repeats of every term."""
        starts = self.rows.starts
        sizes = starts[rows + 1] - starts[rows]
        ends = np.cumsum(sizes)
        entries = np.repeat(starts[rows] - ends + sizes, sizes) + np.arange(ends[-1])
        return np.add.reduceat(self.rows.impacts[entries] * query[self.rows.terms[entries]], ends - sizes)


class Best:
    """The best ``k`` documents of one query so far: higher scores first, then lower ids, null ids last."""

    def __init__(self, k: int, least: int = 1):
        self.k, self.least = k, least
        self.score, self.ids, self.unnamed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        good = score >= self.least
        score, ids, unnamed = (np.concatenate(x) for x in ((self.score, score[good]), (self.ids, ids[good]), (self.unnamed, unnamed[good])))
        order = np.lexsort((ids, unnamed, -score))[:self.k]
        self.score, self.ids, self.unnamed = score[order], ids[order], unnamed[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


Queries = list[tuple[np.ndarray, np.ndarray]]  # ascending terms and their repeats, per item


def _searcher(queries: Queries, collection: Collection, k: int, least: list[int], bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, low) for low in least]
        query = np.zeros(len(collection.weight), np.int64)
        for b in batches:
            held = Bucket(Rows.of(b, collection))
            for (terms, repeats), top in zip(queries, best):
                found = held.survivors(terms, repeats, top.least)
                if len(found):
                    query[terms] = repeats
                    top.add(held.scores(found, query), held.rows.ids[found], held.rows.unnamed[found])
                    query[terms] = 0
        item = np.repeat(np.arange(len(best)), [len(t.score) for t in best])
        ids = pa.array(np.concatenate([t.ids for t in best]), mask=np.concatenate([t.unnamed for t in best]))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(np.concatenate([t.score for t in best]), pa.int64())],
                                         ["item", "doc_id", "score"])

    return run


_FOUND = "item bigint, doc_id bigint, score bigint"
_VECTOR = "is_total boolean, doc_id bigint, docs bigint, n bigint, terms array<int>, tfs array<int>"


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(is_total, doc_id, docs, n, terms, tfs): the query terms of every row of ``docs`` that has any, and one total a task.

    A total has the documents with a term, their terms with repeats, and for each query term the documents that hold it.
    """
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in _VECTOR.split(", ")]

    def run(batches):
        holding = np.zeros(len(vocabulary), np.int32)
        docs = length = 0
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                counts = term_counts(text)
                n = counts.total()
                docs, length = docs + (n > 0), length + n
                pairs = sorted((vocabulary[t], counts[t]) for t in counts.keys() & vocabulary.keys())
                if pairs:
                    terms, tfs = map(list, zip(*pairs))
                    holding[terms] += 1
                    out.append((False, doc, None, n, terms, tfs))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        held = np.flatnonzero(holding)
        total = (True, None, docs, length, held.tolist(), holding[held].tolist())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(total, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, run, _VECTOR)


def _collection(found: DataFrame, terms: int) -> Collection | None:
    """One row a term and one sum reach the driver."""
    totals = found.where("is_total")
    docs, length = totals.agg(F.sum("docs"), F.sum("n")).first()
    if not length:
        return None
    each = totals.select(F.explode(F.arrays_zip("terms", "tfs")).alias("e")).groupBy(F.col("e.terms").alias("t")).agg(F.sum("e.tfs").alias("df"))
    holding = np.zeros(terms, np.int64)
    for r in each.collect():
        holding[r["t"]] = r["df"]
    return Collection.of(docs, length, holding)


def _with_norm(collection: Collection):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(Rows.of(b, collection).norm)], [*b.schema.names, "norm"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.select("*", place.alias("rank")).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list, k: int, bucket: int) -> DataFrame | None:
    counts = [term_counts(r["text"]) for r in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    queries = []
    for c in counts:
        pairs = sorted((vocabulary[t], m) for t, m in c.items())
        queries.append((np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)))
    found = durable(vectors(docs, vocabulary))
    collection = _collection(found, len(vocabulary))
    if collection is None or not vocabulary:
        return None
    rows = found.where("NOT is_total").select("doc_id", "n", "terms", "tfs")
    normed = map_slices(rows, _with_norm(collection), "doc_id bigint, n bigint, terms array<int>, tfs array<int>, norm double", bucket)
    order = [F.desc("norm"), F.asc("doc_id"), F.asc("_tie")]  # copies have one length: their ids and numbers part them
    ranged = normed.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = durable(ranged.select("doc_id", "n", "terms", "tfs", F.spark_partition_id().alias("part")))
    vector = ("doc_id", "n", "terms", "tfs")
    first = map_slices(ordered.where("part = 0").select(*vector), _searcher(queries, collection, k, [1] * len(items), bucket), _FOUND, bucket)
    least = [1] * len(items)
    for r in _merged(first, k).where(F.col("rank") == k).collect():
        least[r["item"]] = r["score"]
    every = map_slices(ordered.select(*vector), _searcher(queries, collection, k, least, bucket), _FOUND, bucket)
    names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item bigint, item_id bigint")
    return _merged(every, k).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, bucket: int = BUCKET, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text).

    Only scores above 0 rank; equal scores go by doc_id, null ids last, and rows that repeat rank each on its own. Null and
    empty texts have no terms: such a document is never found and counts for nothing, such an item finds nothing. Items that
    repeat are searched each on its own. Texts are read whole whatever their length. Other columns are ignored. An empty
    table gives no rows. Items go to the tasks in blocks of about ``query_bytes``, each searched against all documents.
    """
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    dealt = durable(asked.withColumn("block", F.monotonically_increasing_id() % blocks))
    found = None
    for block in range(blocks):
        one = _search_block(docs, dealt.where(F.col("block") == block).collect(), k, bucket)
        if one is not None:
            found = one if found is None else found.union(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
