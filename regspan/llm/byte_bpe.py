"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Each byte stands for one printable character, each token for the string of its bytes' characters, scored by its
negative rank. Normalisation is the identity, so a pre-token goes in as the characters of its bytes and the merges of
lowest rank come first. Ids decode by the inverse mapping.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regspan.llm.common import map_rows

#: Pre-tokens whose ids a process remembers.
CACHE_WORDS = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """One character per byte; none of them is white space, so that nothing is trimmed or escaped."""
    return [chr(0x100 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(value)) if kind == 2 else b"") + value


def serialise(ranks: dict[bytes, int]) -> tuple[bytes, int]:
    """The model as protocol-buffer bytes, and the number that its piece ids exceed the ranks by.

    Fields: pieces 1 (piece 1, score 2, type 3), trainer 2 (model type 3 = BPE, vocabulary size 4), normalizer 3
    (name 1, dummy prefix 3, extra white space 4, escaped white space 5). Piece 0 is the unknown piece.
    """
    char = byte_characters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2))]
    for rank, token in enumerate(by_rank):
        name = "".join(char[b] for b in token).encode()
        pieces.append(_field(1, 2, name) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, _varint(1)))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces)))
    normalizer = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return b"".join(_field(1, 2, p) for p in pieces) + _field(2, 2, trainer) + _field(3, 2, normalizer), 1


#: Texts whose characters all lie below this one take a plain form of the pattern.
LATIN_END = 0x250


def latin_pattern(pattern: str) -> str:
    """``pattern`` with its Unicode classes written out for characters below ``LATIN_END``, as the standard module has no such classes."""
    import regex

    def members(kind: str) -> str:
        return "".join(re.escape(c) if c.isascii() else c for c in map(chr, range(LATIN_END)) if regex.match(kind, c))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    inside = re.sub(r"\[[^]]*\]", lambda m: m[0].replace(r"\p{L}", letter).replace(r"\p{N}", number).replace(r"\s", space), pattern)
    return inside.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")


class Codec:
    """Encodes and decodes texts; one per task."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        model, self.shift = serialise(self.ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.find_latin = re.compile(latin_pattern(pattern)).findall
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]").search
        self.char = dict(enumerate(byte_characters()))
        self.tokens: list[bytes] = sorted(self.ranks, key=self.ranks.__getitem__)
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens; a pre-token that is itself in the vocabulary is one id."""
        got, rest = {}, []
        for w in words:
            raw = w.encode()
            rank = self.ranks.get(raw)
            if rank is None:
                rest.append((w, raw.decode("latin-1").translate(self.char)))
            else:
                got[w] = rank.to_bytes(4, "little")
        shift = self.shift
        for (w, _), ids in zip(rest, self.model.encode([x for _, x in rest], num_threads=1)):
            got[w] = struct.pack(f"<{len(ids)}I", *[i - shift for i in ids])
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        known, out = self.known, []
        for part in self._stretches(text or ""):
            words = (self.find if self.beyond(part) else self.find_latin)(part)
            try:
                out.append(b"".join([known[w] for w in words]))
                continue
            except KeyError:
                new = self.learn([w for w in dict.fromkeys(words) if w not in known])
            out.append(b"".join([known[w] if w in known else new[w] for w in words]))
            known.update((w, x) for w, x in new.items() if len(w) <= 60)  # what is kept stays small
            if len(known) > CACHE_WORDS:  # frequent pre-tokens are met early and stay
                for w in list(islice(reversed(known), len(known) // 2)):
                    del known[w]
        return b"".join(out)

    @staticmethod
    def _stretches(text: str, size: int = 1 << 20):
        """A long text in bounded stretches, cut before a blank between two visible ASCII letters, where a match always ends."""
        at = 0
        while len(text) - at > size:
            end = at + size
            while end < len(text) - 1 and not (text[end] == " " and text[end - 1].isascii() and text[end - 1].isalpha()
                                               and text[end + 1].isascii() and text[end + 1].isalpha()):
                end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def decode(self, ids: bytes) -> bytes:
        tokens, out = self.tokens, []
        for lo in range(0, len(ids), 1 << 22):
            out.append(b"".join([tokens[i] for i in np.frombuffer(ids[lo:lo + (1 << 22)], "<u4").tolist()]))
        return b"".join(out)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids: binary, little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text).

    Null texts count as empty and have no ids. Null and repeated doc_ids are kept; other columns are ignored. A very long text
    is encoded in bounded stretches that end where a pre-token ends; among merges of equal rank the leftmost comes first, and
    an empty table gives no rows.
    """

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([c.encode(t) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "ids"])

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, raw: binary) with the bytes that the ids of ``encode`` stand for; null ids give no bytes."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("ids"), pa.array([c.decode(x or b"") for x in b.column("ids").to_pylist()], pa.binary())],
                ["doc_id", "ids", "raw"])

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id bigint, ids binary, raw binary")
