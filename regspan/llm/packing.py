"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenized and cut once, in tasks. Only the counts per length (at most ``size`` rows) reach the driver,
where best-fit decreasing runs over counts. The plan says which ranks of a length go where; each piece finds its own
slot from its rank within its length. No task holds all pieces of a length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from functools import lru_cache
from itertools import islice
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from regspan.llm.common import map_rows
from regspan.session import durable

SIZE = 2048
END_ID = 0
#: Words whose ids a process remembers.
CACHE_WORDS = 600_000
#: ASCII signs that may end a word; they are pre-tokens of their own.
_SIGNS = "!\"#$%&()*+,-./:;=?@[]^_`{}~"
#: Letters for which the vocabulary's normal form only lowers the case.
_LETTERS = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff\u00df]+").fullmatch


def _byte_map(tok) -> dict[str, str]:
    """What the vocabulary writes for a lower-case Latin-1 letter: one character per byte."""
    letters = [c for c in map(chr, range(0x61, 0x100)) if c.isalpha() and c.islower() and c not in "\u00aa\u00ba\u00b5"]
    return {c: tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}


def _keep_first_half(known: dict) -> None:
    """Forget the words met last: frequent words are met early."""
    if len(known) > CACHE_WORDS:
        for word in list(islice(reversed(known), len(known) // 2)):
            del known[word]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> Callable[[str | None], bytes]:
    """A function from a text to its ids (little-endian unsigned 32-bit).

    Blanks and line ends always separate pre-tokens in this vocabulary and are dropped, so the ids of a text are those
    of its stretches in a row, and each distinct stretch is encoded once. A run of Latin letters goes straight to the
    merges, as normalising and splitting it would only lower its case.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    merges, written = tok.model.tokenize, str.maketrans(_byte_map(tok))
    known: dict[str, bytes] = {"": b""}
    cores: dict[str, bytes] = {}
    tails: dict[str, bytes] = {"": b""}

    def whole(part: str) -> bytes:
        return np.array(tok.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def ids_of(word: str) -> bytes:
        low = word.lower()
        core = low.rstrip(_SIGNS)
        got = cores.get(core)
        if got is None:
            if len(word) > 60 or not _LETTERS(core):
                got = whole(word)
                if len(word) <= 60:
                    known[word] = got
                return got
            ids = [t.id for t in merges(core if core.isascii() else core.translate(written))]
            got = cores[core] = pack_ids(f"<{len(ids)}I", *ids)
        tail = word[len(core):]
        end = tails.get(tail)
        if end is None:
            end = whole(tail)
            if len(tails) < CACHE_WORDS and len(tail) <= 60:
                tails[tail] = end
        known[word] = got = got + end
        return got

    def encode(text: str | None) -> bytes:
        words = (text or "").replace("\n", " ").split(" ")
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            got = b"".join([known[w] if w in known else ids_of(w) for w in words])
            _keep_first_half(known)
            _keep_first_half(cores)
            return got

    return encode


def cut(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, and (task, nth).

    ``nth`` numbers the pieces of one length within the task that made them.
    """

    def run(batches):
        encode, task = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = memoryview(encode(text) + END_ID.to_bytes(4, "little"))
                n = len(ids) // 4
                for piece, lo in enumerate(range(0, n, size)):
                    length = min(size, n - lo)
                    out.append((doc, piece, lo, length, zlib.crc32(ids[4 * lo:4 * (lo + length)]), task, int(seen[length])))
                    seen[length] += 1
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run,
                    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, nth bigint")


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where runs of equal pieces go.

    Best-fit decreasing over groups of equal sequences. A group is (free room, first sequence, how many); placing a run
    of equal pieces takes the group with the least room that fits and splits it if the run is shorter. Rows depend on the
    number of different lengths, not on the number of pieces.
    """
    rooms: list[int] = []  # distinct free rooms, rising
    groups: dict[int, list[tuple[int, int]]] = {}
    rows, sequences = [], 0

    def add(room: int, first: int, many: int) -> None:
        if room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = size // length  # as many in a row as fit in a new sequence
                whole, rest = divmod(left, per)
                for many, copies in ((whole, per), (1 if rest else 0, rest)):
                    for place in range(copies if many else 0):
                        rows.append((length, rank, sequences, place * length))
                        rank += many
                    if many:
                        add(size - copies * length, sequences, many)
                        sequences += many
                break
            room = rooms[at]
            first, many = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            used = min(many, left)
            rows.append((length, rank, first, size - room))
            rank, left = rank + used, left - used
            add(room - length, first, used)
            if used < many:
                add(room, first + used, many - used)
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence and its place there.

    A text's ids are followed by id 0; only what is longer than ``size`` is cut. Null texts count as empty and give one
    piece of one id. Null and repeated doc_ids are kept as they are. Other columns are ignored. Pieces of one length are
    interchangeable, so which of them takes which place follows the tasks that made them. An empty table gives no rows.
    """
    pieces = durable(cut(docs, tokenizer_path, size))
    by_task = durable(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    total = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(total, size)
    from pyspark.sql import Window as W
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    ranks = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(ranks, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    # rank within length, as one number per (length, rank) so that a sorted search finds the run
    shift = max(total.values(), default=0) + 1
    starts = rows[:, 0] * shift + rows[:, 1]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(starts, length * shift + rank, side="right") - 1
            sequence = rows[at, 2] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(5)] + [pa.array(sequence), pa.array(rows[at, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                    "sequence_id bigint, offset bigint")
