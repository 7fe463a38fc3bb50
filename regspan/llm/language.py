"""Language of words and texts by a linear-chain conditional random field.

Each word of a chain has features: its beginnings and endings, character n-grams, itself, and whether a lexicon of frequent
words knows it for a language. Feature and transition weights are learned together from chains whose words carry their
text's language; some chains join two texts, so that switching is learned too. Forward-backward gives each word's
probabilities, and a text is told by their sum over all its words.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regspan.llm.common import map_rows, remainder

UNDECIDED = "und"
#: Words of a chain; a text is a row of chains.
CHAIN = 64
#: Features are told apart by 16 bits of their hash.
BUCKETS = 1 << 16
#: Documents per language, and chains of one document, that the fit reads (spread over the whole text).
FIT_DOCS, FIT_CHAINS = 250, 8
#: Words of a language's lexicon.
LEXICON = 300
EPOCHS, GROUP, RATE, SWITCHED = 3, 64, 0.15, 0.25
CACHE_WORDS = 200_000
#: Words whose chains are run through at once.
RUN = 1 << 17
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case, over the whole text."""
    return _WORD.findall((text or "").lower())


def has_letter(words: list[str]) -> bool:
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owner): the features of each of ``words`` and which word has them.

    They are its bigrams and trigrams between edge marks (so beginnings and endings of one and two letters too), its
    beginning of three letters, its endings of three and four, and itself; each kind is hashed apart.
    """
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()), _STEP)]))

    def grams(at: np.ndarray, n: int, kind: int) -> np.ndarray:
        mixed = np.full(len(at), kind, np.uint64)
        for i in range(n):
            mixed = mixed * _STEP + codes[at + i]
        return (mixed * _MIX) >> np.uint64(48)

    out, by = [], []
    for n, kind in ((2, 2), (3, 3)):
        at = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:])
        out.append(grams(at, n, kind))
        by.append(owner[at])
    for n, first, kind in ((4, True, 4), (4, False, 5), (5, False, 6)):
        has = np.flatnonzero(sizes >= n)
        out.append(grams(starts[has] if first else ends[has] - n, n, kind))
        by.append(has)
    place = np.arange(len(codes)) - starts[owner]
    out.append((np.add.reduceat(codes * power[place], starts) * _MIX) >> np.uint64(48))
    by.append(np.arange(len(words)))
    return np.concatenate(out).astype(np.int64), np.concatenate(by)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    lexicon: dict[str, np.ndarray]  # word -> indicator per language
    lexicon_weight: np.ndarray  # one per language
    transitions: np.ndarray  # from x to

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, languages) scores of words without their neighbours."""
        buckets, owner = features(words)
        sums = np.stack([np.bincount(owner, w[buckets], len(words)) for w in self.weights.T], axis=1)
        sums *= np.bincount(owner, minlength=len(words))[:, None] ** -0.5
        for i, w in enumerate(words):
            if w in self.lexicon:
                sums[i] += self.lexicon[w] * self.lexicon_weight
        return sums


def forward_backward(e: np.ndarray, t: np.ndarray, mask: np.ndarray, pairs: bool = False):
    """Word probabilities (chains, words, languages) under emissions ``e`` and transitions ``t``; also pair sums and log partition.

    ``mask`` marks real words, which come first in their chain. Sums are kept in proportion, so no length overflows.
    """
    n, length, k = e.shape
    top = e.max(axis=2, keepdims=True)
    x, a = np.exp(e - top), np.exp(t - t.max())
    alpha, beta, scale = np.empty_like(x), np.empty_like(x), np.ones((n, length))
    now = x[:, 0] / k
    for i in range(length):
        if i:
            now = np.where(mask[:, i, None], (alpha[:, i - 1] @ a) * x[:, i], alpha[:, i - 1])
        scale[:, i] = now.sum(axis=1)
        now = now / scale[:, i, None]
        alpha[:, i] = now
    now = np.ones((n, k))
    for i in range(length - 1, -1, -1):
        beta[:, i] = now
        now = np.where(mask[:, i, None], (x[:, i] * now) @ a.T, now)
        now = now / now.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    if not pairs:
        return p
    # expected transitions between neighbours that are both real
    q = alpha[:, :-1, :, None] * a * (x[:, 1:] * beta[:, 1:])[:, :, None, :]
    q /= q.sum(axis=(2, 3), keepdims=True)
    return p, (q * mask[:, 1:, None, None]).sum(axis=(0, 1))


def train(chains: list[list[str]], tags: list[list[int]], languages: list[str], lexicon: dict[str, np.ndarray], seed: int = 0) -> Field:
    """Weights by AdaGrad on the chains' log-likelihood, with a small ridge."""
    k, rng = len(languages), np.random.default_rng(seed)
    field = Field(languages, np.zeros((BUCKETS, k)), lexicon, np.ones(k), np.zeros((k, k)))
    squares = [np.full((BUCKETS, k), 1e-2), np.full(k, 1e-2), np.full((k, k), 1e-2)]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in chains for w in c))}
    flat, by = features(list(vocabulary))
    flat = flat[np.argsort(by, kind="stable")]
    sizes = np.bincount(by, minlength=len(vocabulary))
    starts = np.cumsum(sizes) - sizes
    known = np.array([lexicon.get(w, np.zeros(k)) for w in vocabulary])
    root = sizes ** -0.5
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for lo in range(0, len(order), GROUP):
            rows = order[lo:lo + GROUP]
            ids = np.zeros((len(rows), CHAIN), np.int64)
            gold, mask = np.zeros((len(rows), CHAIN), np.int64), np.zeros((len(rows), CHAIN), bool)
            for j, r in enumerate(rows):
                m = len(chains[r])
                ids[j, :m], gold[j, :m], mask[j, :m] = [vocabulary[w] for w in chains[r]], tags[r], True
            used, place = np.unique(ids[mask], return_inverse=True)
            at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[used], sizes[used])])
            buckets, owner = flat[at], np.repeat(np.arange(len(used)), sizes[used])
            cut = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
            scores = np.add.reduceat(field.weights[buckets], cut, axis=0) * root[used, None] + known[used] * field.lexicon_weight
            e = np.zeros((len(rows), CHAIN, k))
            e[mask] = scores[place]
            p, moves = forward_backward(e, field.transitions, mask, pairs=True)
            miss = (np.eye(k)[gold] - p)[mask] / len(rows)
            per_word = np.stack([np.bincount(place, miss[:, c], len(used)) for c in range(k)], axis=1)
            spread = (per_word * root[used, None])[owner]
            touched, to = np.unique(buckets, return_inverse=True)
            grad = np.stack([np.bincount(to, spread[:, c], len(touched)) for c in range(k)], axis=1) - 1e-5 * field.weights[touched]
            squares[0][touched] += grad ** 2
            field.weights[touched] += RATE * grad / np.sqrt(squares[0][touched])
            grad = (per_word * known[used]).sum(axis=0) - 1e-4 * field.lexicon_weight
            squares[1] += grad ** 2
            field.lexicon_weight += RATE * grad / np.sqrt(squares[1])
            both = mask[:, 1:]
            real = np.bincount(gold[:, :-1][both] * k + gold[:, 1:][both], minlength=k * k).reshape(k, k)
            grad = (real - moves) / len(rows) - 1e-3 * field.transitions
            squares[2] += grad ** 2
            field.transitions += RATE * grad / np.sqrt(squares[2])
    return field


def fit(docs: DataFrame, divisor: int = 3, left_out: int = 1, docs_each: int = FIT_DOCS, seed: int = 0) -> Field | None:
    """Learn from ``docs`` (doc_id, text, lang) outside the left-out fold; None without any labelled text.

    About ``docs_each`` documents of each language, by hash of the id, and ``FIT_CHAINS`` chains of each of them.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(remainder(F.col("doc_id"), divisor) != left_out)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None
    pairs = [x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, docs_each / n)))]
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("share", F.create_map(*pairs)[F.col("lang")]).where(part < F.col("share"))

    def cut(batches):
        for b in batches:
            out = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words = words_of(text)
                at = sorted({int(x) for x in np.linspace(0, max(len(words) - CHAIN, 0), FIT_CHAINS)})
                out += [(lang, words[i:i + CHAIN]) for i in at if words]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))], ["lang", "words"])

    got = sorted((r["lang"], tuple(r["words"])) for r in map_rows(drawn.select("lang", "text"), cut, "lang string, words array<string>").distinct().collect())
    if not got:
        return None
    languages = sorted({lang for lang, _ in got})
    place = {x: i for i, x in enumerate(languages)}
    counts = [Counter() for _ in languages]
    for lang, words in got:
        counts[place[lang]].update(words)
    lexicon: dict[str, np.ndarray] = {}
    for i, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, np.zeros(len(languages)))[i] = 1.0
    rng = np.random.default_rng(seed)
    chains, tags = [], []
    for j, (lang, words) in enumerate(got):
        words, tag = list(words), [place[lang]] * len(words)
        if rng.random() < SWITCHED and len(words) > 8:
            other, more = got[rng.integers(len(got))]
            cut_at = int(rng.integers(4, len(words)))
            more = list(more)[:CHAIN - cut_at]
            words, tag = words[:cut_at] + more, tag[:cut_at] + [place[other]] * len(more)
        chains.append(words)
        tags.append(tag)
    return train(chains, tags, languages, lexicon, seed)


class Labeller:
    """Word and text probabilities under a field; one per task."""

    def __init__(self, field: Field | None):
        self.field = field
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(field.languages) if field else 0))

    def _emissions(self, words: list[str]) -> np.ndarray:
        try:
            return self.table[[self.place[w] for w in words]]
        except KeyError:
            pass
        if len(self.place) > CACHE_WORDS:
            self.place, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        self.place.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.table = np.concatenate([self.table, self.field.emissions(new)])
        return self.table[[self.place[w] for w in words]]

    def word_probabilities(self, words: list[str]) -> np.ndarray:
        """(words, languages), chain by chain."""
        out = []
        for lo in range(0, len(words), RUN):
            part = words[lo:lo + RUN]
            n = -(-len(part) // CHAIN)
            e = np.zeros((n * CHAIN, len(self.field.languages)))
            e[:len(part)] = self._emissions(part)
            mask = (np.arange(n * CHAIN) < len(part)).reshape(n, CHAIN)
            out.append(forward_backward(e.reshape(n, CHAIN, -1), self.field.transitions, mask).reshape(n * CHAIN, -1)[:len(part)])
        return np.concatenate(out) if out else np.zeros((0, len(self.field.languages)))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float, list[float]]]:
        """(language, score, share of each language) per text; short texts go through together, each starting its own chain."""
        listed = [words_of(t) for t in texts]
        out: list = [(UNDECIDED, 0.0, [])] * len(texts)
        if not self.field:
            return out
        group: list[int] = []
        size = 0
        for i, words in enumerate(listed):
            if not has_letter(words):
                continue
            if group and size + len(words) > RUN:
                self._run(listed, group, out)
                group, size = [], 0
            group.append(i)
            size += len(words)
        if group:
            self._run(listed, group, out)
        return out

    def _run(self, listed, group, out) -> None:
        k = len(self.field.languages)
        if len(group) == 1:
            sums = [self.word_probabilities(listed[group[0]]).mean(axis=0)]
        else:
            rows = [-(-len(listed[i]) // CHAIN) for i in group]
            first = np.concatenate([[0], np.cumsum(rows)])
            e, mask = np.zeros((first[-1] * CHAIN, k)), np.zeros(first[-1] * CHAIN, bool)
            at = np.concatenate([np.arange(f * CHAIN, f * CHAIN + len(listed[i])) for f, i in zip(first, group)])
            e[at] = self._emissions([w for i in group for w in listed[i]])
            mask[at] = True
            p = forward_backward(e.reshape(-1, CHAIN, k), self.field.transitions, mask.reshape(-1, CHAIN)).reshape(-1, k)
            p[~mask] = 0.0
            sums = np.add.reduceat(p, first[:-1] * CHAIN, axis=0) / np.array([len(listed[i]) for i in group])[:, None]
        for i, share in zip(group, sums):
            best = int(np.argmax(share))
            out[i] = (self.field.languages[best], float(min(1.0, share[best])), share.tolist())


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, lang_pred, score, shares: map of language to share of words) of every row of ``docs`` (doc_id, text).

    A null text, or one without a letter, is ``und`` with score 0 and no shares; so is every text without a fitted field.
    Null and repeated doc_ids are kept; other columns are ignored. A long text is many chains of words; of languages with
    equal shares the first by name is predicted. An empty table gives no rows.
    """

    def run(batches):
        labeller = Labeller(field)
        for b in batches:
            got = labeller.texts(b.column("text").to_pylist())
            shares = [list(zip(field.languages, s)) if s else [] for _, _, s in got]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()),
                 pa.array(shares, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run,
                    "doc_id bigint, lang_pred string, score double, shares map<string,double>")


def keep_told(docs: DataFrame, field: Field | None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text has a language that holds more than ``least`` of its words, with all their columns.

    Without a fitted field, as nothing could be learned, rows with a letter in their text stay. Rows that repeat stay or go
    together, and an empty table stays empty.
    """
    at_text = docs.columns.index("text")

    def run(batches):
        labeller = Labeller(field)
        for b in batches:
            texts = b.column(at_text).to_pylist()
            if field:
                keep = [lang != UNDECIDED and score > least for lang, score, _ in labeller.texts(texts)]
            else:
                keep = [has_letter(words_of(t)) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, run, docs.schema)
