"""Token ids of a corpus as files of bit- or byte-planes.

Documents are dealt out by range of doc_id, so each partition holds the next stretch of the corpus. A task encodes its
texts and closes a container whenever it holds enough ids. Inside a container the ids form one stream, cut into blocks of a
fixed number of ids. A block is transposed: the first bytes (or bits) of all its ids, then the second ones, and so on. Each
such plane is compressed by zstandard, an all-zero plane takes no space, and a chunk index tells where the planes of each
block lie. A reader decodes only the blocks that a document touches.

Container: magic, plane bits (u1), ids per block (u4), documents (u8), ids (u8), ids of its part before it (u8); then the
compressed document table (id i8, null flag u1, ids u8), the planes, the chunk index (end offset u8 per plane of a block),
and last the offset of the document table's end (u8), of the index (u8) and the magic again. Numbers are little-endian.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from regspan.llm.common import map_slices

MAGIC = b"IDPLANE1"
BLOCK_IDS, CONTAINER_IDS = 1 << 14, 1 << 17
PLANE_BITS, ZSTD_LEVEL = 8, 1
END_ID = 0
#: Signs that may end a word; they hold neither letters nor digits nor white space.
_SIGNS = "!\"#$%&()*+,-./:;=?@[]^_`{}~"
#: Letters below this one are letters to every library alike.
_LATIN_END = "\u0250"
#: Words whose ids a process remembers.
CACHE_WORDS = 800_000
_HEAD, _TAIL = struct.Struct("<8sBIQQQ"), struct.Struct("<QQ8s")


def byte_characters(alphabet: list[str]) -> dict[int, str]:
    """The character that stands for each byte: its own if the alphabet has it, else the next one from U+0100 on."""
    own, rest = set(alphabet), iter(range(0x100, 0x200))
    return {b: chr(b) if chr(b) in own else chr(next(rest)) for b in range(256)}


class Encoder:
    """Ids of texts under a byte-level vocabulary of the tokenizers library.

    The vocabulary's pre-tokens break before a blank or line end that follows a visible sign, and in longer white space
    before its last character. So a text is cut into words that carry the one blank or line end before them, and each
    distinct word is encoded once. Texts that hold an added token or a separator control go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(["[\x1c-\x1f]", *added])).search
        self.runs = re.compile(r"(\s{2,})").split
        self.written = byte_characters(ByteLevel.alphabet())
        self.merges = self.tok.model.tokenize
        merged = set().union(*(t for t in self.tok.get_vocab() if len(t) > 1))
        self.apart = next(c for c in self.written.values() if c not in merged)  # no merge joins it to anything
        self.apart_id = self.tok.token_to_id(self.apart)
        self.known: dict[str, bytes] = {}  # a word with the blank before it, a line end and a word where it begins with one
        self.tails: dict[str, bytes] = {"": b"", "\n": self._exact("\n")}

    def _tail(self, signs: str) -> bytes:
        got = self.tails.get(signs)
        if got is None:
            got = self._exact(signs)
            if len(signs) <= 8 and len(self.tails) < CACHE_WORDS:
                self.tails[signs] = got
        return got

    def _merged(self, cores: list[str], lead: str) -> list[bytes]:
        """Ids of runs of letters, each behind ``lead`` (a character of the vocabulary, or nothing), all in one go."""
        if not cores:
            return []
        written = [lead + (c if c.isascii() else c.encode().decode("latin-1").translate(self.written)) for c in cores]
        ids = np.array([t.id for t in self.merges(self.apart.join([*written, ""]))], "<u4")
        raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.apart_id)).tolist()
        return [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]

    def _learn(self, words: set[str]) -> None:
        """Put the ids of words into ``known``. A word carries a line end that it begins with, else the blank before it.

        Behind that come Latin letters, which go straight to the merges, and signs, a pre-token of their own; what is made
        otherwise goes through the library.
        """
        known, line = self.known, self.tails["\n"]
        whole, signed, lines = [], [], []  # words of letters, those with signs behind, and those behind a line end
        for word in words:
            core = word.rstrip(_SIGNS)
            if core.isalpha() and (core.isascii() or max(core) < _LATIN_END):
                if len(core) == len(word):
                    whole.append(word)
                else:
                    signed.append((word, core))
                continue
            behind = word[1:] if word[:1] == "\n" else None
            core = behind.rstrip(_SIGNS) if behind else ""
            if core.isalpha() and (core.isascii() or max(core) < _LATIN_END):
                lines.append((word, core, behind[len(core):]))
            elif behind is None:
                known[word] = self._exact(" " + word)
            else:
                known[word] = line + (self._exact(behind) if behind else b"")
        whole += {core for _, core in signed}.difference(known, whole)
        known.update(zip(whole, self._merged(whole, self.written[0x20])))
        for word, core in signed:
            known[word] = known[core] + self._tail(word[len(core):])
        for (word, _, signs), ids in zip(lines, self._merged([core for _, core, _ in lines], "")):
            known[word] = line + ids + self._tail(signs)

    def _exact(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stretch(self, text: str) -> bytes:
        """Ids of a stretch without white space of two characters or more."""
        # a first word with nothing before it counts as one behind a line end, whose ids are then taken off
        words = ("\n" + text.replace("\n", " \n")).split(" ")
        known = self.known
        new = set(words).difference(known)
        if new:
            self._learn(new)
        out = b"".join(map(known.__getitem__, words))[len(self.tails["\n"]):]
        for w in new:
            if len(w) > 60:
                known.pop(w, None)
                known.pop(w.rstrip(_SIGNS), None)
        if len(known) > CACHE_WORDS:  # frequent words are met early and stay
            for w in list(islice(reversed(known), len(known) // 2)):
                del known[w]
        return out

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.whole(text):
            return self._exact(text)
        parts = self.runs(text)
        if len(parts) == 1:
            return self._stretch(text)
        out, lead = [], ""
        for i in range(0, len(parts), 2):  # a visible stretch (none at an end of the text), and the run behind it
            last = i + 1 == len(parts)
            if lead + parts[i]:
                out.append(self._stretch(lead + parts[i]))
            if not last:
                run = parts[i + 1]
                ends = i + 3 == len(parts) and not parts[i + 2]
                before, lead = (run, "") if ends else (run[:-1], run[-1])
                out.append(self._exact(before))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def transpose(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block: 4 planes of bytes, or 32 of bits (8 ids a byte, the last byte filled with zeros)."""
    columns = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [p.tobytes() for p in columns.T]
    return [p.tobytes() for p in np.packbits(np.unpackbits(columns, axis=1, bitorder="little").T, axis=1)]


def restore(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    """The ``n`` ids of a block; an empty plane is one of zeros."""
    wide = n if bits == 8 else -(-n // 8)
    rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(wide, np.uint8) for p in planes])
    if bits == 1:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def pack_container(docs: list[int | None], counts: list[int], ids: bytes, start: int, block: int = BLOCK_IDS, bits: int = PLANE_BITS) -> bytes:
    """A container of whole documents; ``ids`` is their joined stream and ``start`` the ids of its part before it."""
    import zstandard

    press = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress
    stream = np.frombuffer(ids, "<u4")
    known = np.array([d is not None for d in docs], np.uint8)
    table = press(np.array([d or 0 for d in docs], "<i8").tobytes() + known.tobytes() + np.array(counts, "<u8").tobytes())
    out, ends = [_HEAD.pack(MAGIC, bits, block, len(docs), len(stream), start), table], []
    end = docs_end = _HEAD.size + len(table)
    for lo in range(0, len(stream), block):
        for plane in transpose(stream[lo:lo + block], bits):
            if plane.count(0) < len(plane):
                out.append(press(plane))
                end += len(out[-1])
            ends.append(end)
    return b"".join([*out, np.array(ends, "<u8").tobytes(), _TAIL.pack(docs_end, end, MAGIC)])


class Container:
    """Reads a container; blocks are decoded when their ids are asked for."""

    def __init__(self, data: bytes):
        import zstandard

        self.data, self._press = memoryview(data), zstandard.ZstdDecompressor()
        magic, self.bits, self.block, n_docs, self.n_ids, self.start = _HEAD.unpack_from(data)
        docs_end, index, end_magic = _TAIL.unpack_from(data, len(data) - _TAIL.size)
        if magic != MAGIC or end_magic != MAGIC:
            raise ValueError("not a container of token planes")
        table = self._press.decompress(self.data[_HEAD.size:docs_end], max_output_size=17 * n_docs)
        ids, known = np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, np.uint8, n_docs, 8 * n_docs)
        self.docs = [d if k else None for d, k in zip(ids.tolist(), known.tolist())]
        self.counts = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        ends = np.frombuffer(data, "<u8", (len(data) - _TAIL.size - index) // 8, index).astype(np.int64)
        self.ends = np.append(docs_end, ends)
        self.planes = 32 // self.bits
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _block(self, nth: int) -> np.ndarray:
        if self._last[0] != nth:
            n = min(self.block, self.n_ids - nth * self.block)
            ends = self.ends[nth * self.planes:(nth + 1) * self.planes + 1]
            size = n if self.bits == 8 else -(-n // 8)
            planes = [self._press.decompress(self.data[a:b], max_output_size=size) if b > a else b"" for a, b in zip(ends[:-1], ends[1:])]
            self._last = nth, restore(planes, n, self.bits)
        return self._last[1]

    def ids(self, lo: int, hi: int) -> bytes:
        """Ids ``lo`` up to ``hi`` of the container, from the blocks that hold them."""
        parts = []
        for nth in range(lo // self.block, -(-hi // self.block)):
            at = nth * self.block
            parts.append(self._block(nth)[max(0, lo - at):hi - at].tobytes())
        return b"".join(parts)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, first id, number of ids) in order."""
        at = 0
        for doc, n in zip(self.docs, self.counts.tolist()):
            yield doc, at, n
            at += n


_STORED = "part int, nth bigint, start bigint, n_ids bigint, n_docs bigint, first_doc bigint, last_doc bigint, data binary"


def write(docs: DataFrame, folder: str, tokenizer_path: str, block: int = BLOCK_IDS, bits: int = PLANE_BITS, container: int = CONTAINER_IDS) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text) to ``folder``, each document's followed by id 0.

    Documents ascend by doc_id; null ids come first, equal ids are ordered by a hash of their texts, and rows that repeat
    stay. Null texts count as empty and give the end id alone. A container ends with the document that fills it, so a very
    long text makes one longer container of many blocks. Other columns are ignored. An empty table gives no container.
    The folder is a Parquet table with one container a row; its other columns serve to find containers without opening them.
    """
    if bits not in (1, 8):
        raise ValueError("planes are of 1 or 8 bits")

    def run(batches):
        encode, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        nth = start = held = 0
        ids: list[bytes] = []
        names: list[int | None] = []
        counts: list[int] = []

        def close() -> pa.RecordBatch:
            row = (part, nth, start, held, len(names), names[0], names[-1], pack_container(names, counts, b"".join(ids), start, block, bits))
            kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in _STORED.split(", ")])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                one = encode(text) + END_ID.to_bytes(4, "little")
                ids.append(one)
                names.append(doc)
                counts.append(len(one) // 4)
                held += counts[-1]
                if held >= container:
                    yield close()
                    nth, start, held, ids, names, counts = nth + 1, start + held, 0, [], [], []
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", "_mix", "_tie"]  # the last one parts rows that repeat
    rows = rows.withColumn("_mix", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    map_slices(dealt, run, _STORED).write.option("compression", "none").parquet(folder)


def _stored_documents(spark: SparkSession, folder: str, columns: Callable[[list[bytes]], list[pa.Array]], schema: str) -> DataFrame:
    """(doc_id, start, and what ``columns`` makes of the ids) of every stored document.

    One number a partition reaches the driver; containers know their place within their partition.
    """
    stored = spark.read.schema(_STORED).parquet(folder)
    sizes = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    parts = sorted(sizes)
    before = dict(zip(parts, np.cumsum([0, *[sizes[p] for p in parts]]).tolist()))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
                box = Container(data)
                rows = list(box.documents())
                first = before[part] + box.start
                for lo in range(0, len(rows), 512):
                    some = rows[lo:lo + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in some], pa.int64()), pa.array([first + r[1] for r in some], pa.int64()),
                         *columns([box.ids(at, at + n) for _, at, n in some])], names)

    return map_slices(stored.select("part", "data"), run, schema, rows=1)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every stored document: the ids before it in the corpus, and its own as little-endian unsigned 32-bit numbers."""
    return _stored_documents(spark, folder, lambda ids: [pa.array(ids, pa.binary())], "doc_id bigint, start bigint, ids binary")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, from the ids that are read back."""
    made = lambda ids: [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64())]
    return _stored_documents(spark, folder, made, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """(doc_id, ids) of the stored documents from ``low`` to ``high``; containers beyond are not opened, nor blocks beyond decoded."""
    near = spark.read.schema(_STORED).parquet(folder).where((F.col("last_doc") >= low) & (F.coalesce("first_doc", F.lit(-1 << 63)) <= high))

    def run(batches):
        for b in batches:
            for data in b.column("data").to_pylist():
                box = Container(data)
                some = [r for r in box.documents() if r[0] is not None and low <= r[0] <= high]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()),
                                                  pa.array([box.ids(at, at + n) for _, at, n in some], pa.binary())], ["doc_id", "ids"])

    return map_slices(near.select("data"), run, "doc_id bigint, ids binary", rows=1)
