"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run over byte embeddings, each
chunk keeps every filter's largest response, and the chunks' largest, smallest and mean responses are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regspan.llm.common import labelled_sample, map_rows, sigmoid

CHUNK, HOP = 512, 448
KERNEL, STRIDE, WIDTH, FILTERS = 8, 4, 8, 24
#: Most labelled rows that the fit reads, and most chunks of one of them, spread evenly over it; scoring reads whole texts.
FIT_ROWS, FIT_CHUNKS = 2_500, 36
EPOCHS, GROUP, RATE = 10, 32, 0.01
#: Chunks convolved at once.
RUN = 64
_AT = np.arange(0, CHUNK - KERNEL + 1, STRIDE)


@dataclass
class Net:
    embedding: np.ndarray  # 257 bytes (256 stands for nothing) x WIDTH
    filters: np.ndarray  # KERNEL * WIDTH x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 3 * FILTERS
    out_bias: np.ndarray  # 1

    @staticmethod
    def new(seed: int = 0) -> Net:
        rng = np.random.default_rng(seed)
        f32 = np.float32
        return Net(rng.normal(0, 0.5, (257, WIDTH)).astype(f32), rng.normal(0, (KERNEL * WIDTH) ** -0.5, (KERNEL * WIDTH, FILTERS)).astype(f32),
                   np.zeros(FILTERS, f32), rng.normal(0, 0.1, 3 * FILTERS).astype(f32), np.zeros(1, f32))


def chunks(raw: bytes) -> np.ndarray:
    """(n, CHUNK) byte codes that cover all of ``raw``; neighbours share CHUNK - HOP bytes or more, as the last one ends with the text.

    A shorter text is one chunk, filled with 256.
    """
    if len(raw) <= CHUNK:
        out = np.full((1, CHUNK), 256, np.int16)
        out[0, :len(raw)] = np.frombuffer(raw, np.uint8)
        return out
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), CHUNK)
    starts = np.append(np.arange(0, len(raw) - CHUNK, HOP), len(raw) - CHUNK)
    return view[starts].astype(np.int16)


def windows(net: Net, codes: np.ndarray) -> np.ndarray:
    """(n, positions, KERNEL * WIDTH) embedded bytes below each filter position."""
    x = np.take(net.embedding, codes, axis=0).reshape(len(codes), CHUNK * WIDTH)
    view = np.lib.stride_tricks.sliding_window_view(x, KERNEL * WIDTH, axis=1)
    return view[:, ::STRIDE * WIDTH]


def pooled(net: Net, codes: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(n, FILTERS) largest response of each filter per chunk, none below 0; and its position if asked for."""
    best, at = [], []
    for lo in range(0, len(codes), RUN):
        # one product of the same shape per chunk: how it rounds does not depend on the chunks beside it
        r = np.matmul(np.ascontiguousarray(windows(net, codes[lo:lo + RUN])), net.filters)
        if where:
            a = r.argmax(axis=1)
            at.append(a)
            best.append(np.take_along_axis(r, a[:, None], 1)[:, 0])
        else:
            best.append(r.max(axis=1))
    return np.maximum(np.concatenate(best) + net.bias, 0.0), np.concatenate(at) if where else None


def _combine(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents, 3 * FILTERS): largest, smallest and mean response over the chunks of each document."""
    sizes = np.diff(np.append(starts, len(h)))
    return np.hstack([np.maximum.reduceat(h, starts, axis=0), np.minimum.reduceat(h, starts, axis=0), np.add.reduceat(h, starts, axis=0) / sizes[:, None]])


def probabilities(net: Net, texts: list[str | None]) -> np.ndarray:
    """Score of each whole text. Texts go through in runs of chunks; a long one is read run by run."""
    out = []
    for group in _groups([(t or "").encode() for t in texts]):
        codes = [chunks(raw) for raw in group]
        starts = np.cumsum([0, *map(len, codes)])[:-1]
        h, _ = pooled(net, np.concatenate(codes) if len(codes) > 1 else codes[0])
        z = _combine(h, starts).astype(np.float64)
        out.append(sigmoid((z * net.out.astype(np.float64)).sum(axis=1) + float(net.out_bias[0])))
    return np.concatenate(out) if out else np.zeros(0)


def _groups(raws: list[bytes], most: int = 1 << 18) -> Iterator[list[bytes]]:
    group, size = [], 0
    for raw in raws:
        if group and size + len(raw) > most:
            yield group
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    if group:
        yield group


def spread_chunks(raw: bytes, most: int = FIT_CHUNKS) -> np.ndarray:
    """At most ``most`` chunks of a text, the first and the last among them and the others at even distances."""
    every = chunks(raw)
    return every if len(every) <= most else every[np.linspace(0, len(every) - 1, most).round().astype(int)]


def train(codes: list[np.ndarray], y: np.ndarray, seed: int = 0, epochs: int = EPOCHS) -> Net:
    """Fit by Adam on the log loss; ``codes`` are the chunks of each text. The gradient of a maximum reaches only the position that gave it."""
    net, rng = Net.new(seed), np.random.default_rng(seed)
    names = [f.name for f in fields(Net)]
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names}
    step = 0
    net.out_bias[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)) if len(y) else 0.0
    for epoch in range(epochs):
        order = rng.permutation(len(codes))
        for lo in range(0, len(order), GROUP):
            rows = order[lo:lo + GROUP]
            part = np.concatenate([codes[i] for i in rows])
            sizes = np.array([len(codes[i]) for i in rows])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            h, at = pooled(net, part, where=True)
            z = _combine(h, starts)
            d = (sigmoid(z @ net.out + net.out_bias) - y[rows]).astype(np.float32) / len(rows)
            grads = {"out": z.T @ d + 1e-4 * net.out, "out_bias": np.array([d.sum()], np.float32)}
            dz = d[:, None] * net.out
            owner = np.repeat(np.arange(len(rows)), sizes)
            dh = (dz[:, 2 * FILTERS:] / sizes[:, None])[owner]
            for side in (slice(0, FILTERS), slice(FILTERS, 2 * FILTERS)):
                dh += np.where(h == z[owner, side], dz[owner, side], 0.0)
            dh = np.where(h > 0, dh, 0.0).astype(np.float32)
            grads["bias"] = dh.sum(axis=0)
            bytes_at = part[np.arange(len(part))[:, None, None], _AT[at][:, :, None] + np.arange(KERNEL)]  # n, FILTERS, KERNEL
            x = net.embedding[bytes_at].reshape(len(part), FILTERS, KERNEL * WIDTH)
            grads["filters"] = np.einsum("nfk,nf->kf", x, dh, optimize=True)
            dx = (dh[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH)
            grads["embedding"] = np.stack([np.bincount(bytes_at.ravel(), dx[:, k], 257) for k in range(WIDTH)], axis=1).astype(np.float32)
            step += 1
            rate = RATE * min(1.0, step / 20) * (0.5 * (1 + np.cos(np.pi * (epoch / epochs))))
            for n in names:
                m, v = moments[n]
                m += 0.1 * (grads[n] - m)
                v += 0.001 * (grads[n] ** 2 - v)
                w = getattr(net, n)
                w -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, left_out: int = 0,
        rows: int = FIT_ROWS, most_chunks: int = FIT_CHUNKS) -> Net:
    """Learn from ``labels`` (doc_id, label) outside the left-out fold: ``rows`` of them, by hash of the id, ``most_chunks`` chunks of each.

    What reaches the driver is bounded by ``rows`` times ``most_chunks``; that bound holds for the fit alone. Long texts
    teach by chunks from all over them.
    """
    known = labelled_sample(labels, "doc_id", label, divisor, left_out, 2 * rows)
    spark = docs.sparkSession
    ids = spark.createDataFrame([(int(k), y) for k, y in known.items()], "_id bigint, _y int")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = texts.join(F.broadcast(ids), "_id").dropDuplicates(["text"]).orderBy(F.xxhash64("_id"), "_id").limit(rows).select("_id", "_y", "text")

    def run(batches):
        for b in batches:
            codes = [spread_chunks(t.encode(), most_chunks).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(codes, pa.binary())], ["_id", "_y", "codes"])

    got = map_rows(first, run, "_id bigint, _y int, codes binary").toPandas().sort_values("_id")
    return train([np.frombuffer(c, np.int16).reshape(-1, CHUNK) for c in got["codes"]], got["_y"].to_numpy(np.float32))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text), over whole texts.

    Null texts count as empty, which is one empty chunk. Null and repeated doc_ids are kept; other columns are ignored. A very
    long text is read in runs of chunks, equal texts have equal scores beside any others, and an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            p = probabilities(net, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, score double")
