"""Toxic passages as maximum-scoring segments of token log-odds.

Words and their beginnings are the pieces. A piece has log-odds between toxic and other labelled documents under a Dirichlet
prior from the whole corpus, moved towards zero by their standard error; only pieces that keep some are in the model. A token's
score is that of its most telling piece, less a small cost. One linear scan finds all maximal segments of a text. Their
scores follow an extreme-value law, whose scale and place come from labelled clean documents. The
law's sum statistic joins a document's segments; a logistic fit turns it into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regspan.llm.common import fit_logistic, labelled_sample, map_rows, sigmoid
from regspan.session import durable

#: Counted words a task holds before it passes their pieces on.
HELD = 400_000
#: Most labelled rows that the fit reads.
FIT_ROWS = 20_000
#: Strength of the prior as a share of the labelled tokens; standard errors taken off; cost per token.
PRIOR_SHARE, ERRORS, TOKEN_COST = 0.01, 3.0, 0.03
#: A passage is significant when so many like it are expected by chance in a text of its length at most.
EXPECTED = 0.05
#: Bounds of the evidence that the logistic fit sees.
NO_EVIDENCE, MOST_EVIDENCE = 10.0, 30.0
#: Remembered tokens of a task.
CACHE_TOKENS = 400_000
_TOKEN = re.compile(r"\w+")


#: Letters at the beginning of a word that are pieces of it.
BEGINNINGS = (4, 5, 6, 7)


def pieces(word: str) -> list[str]:
    """A lower-case word and its beginnings; no word has the sign that marks a beginning."""
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


class Scores(dict):
    """Score of a word under a model's pieces."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> float:
        got = max((self.scores.get(x, 0.0) for x in pieces(word)), key=abs) - TOKEN_COST
        if len(self) < CACHE_TOKENS and len(word) <= 40:
            self[word] = got
        return got

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words_of(text)), np.float64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in order, in linear time.

    Only positive scores can begin or end one; each candidate keeps the running total before and after it, and merges
    with the nearest earlier one of smaller start total when that makes a larger score.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.cumsum(scores)
    after = total[up]
    before = after - scores[up]
    stack: list[list] = []  # [left total, right total, start, end, index of the nearest earlier one with a smaller left total]
    for i, left, right in zip(up.tolist(), before.tolist(), after.tolist()):
        now = [left, right, i, i + 1, -1]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= now[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= now[1]:
                now[4] = j
                stack.append(now)
                break
            now[0], now[2] = stack[j][0], stack[j][2]
            del stack[j:]
            j = len(stack) - 1
    return [(s[2], s[3], s[1] - s[0]) for s in stack]


def extreme_scale(share: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(share * exp(root * score)) = 1, for scores with a negative mean and a positive maximum."""
    live = share > 0
    p, s = share[live], scores[live]
    if not len(s) or s.max() <= 0 or p @ s >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while p @ np.exp(np.minimum(high * s, 700)) < 1:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(np.minimum(mid * s, 700)) < 1 else (low, mid)
    return high


@dataclass
class Model:
    scores: dict[str, float]  # of the pieces whose score is not zero
    scale: float
    place: float  # natural log of the extreme-value constant
    weights: np.ndarray  # of the features, then the intercept

    def evidence(self, scores: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
        """Features of a text's token scores, and its significant passages (first token, end, normalised score).

        The features are the surprise (minus log of the expected number by chance) of the best passage, and that of the
        best number of passages together.
        """
        found = [(a, b, self.scale * s) for a, b, s in segments(scores)]
        if not found:
            return [-NO_EVIDENCE, -NO_EVIDENCE], []
        bar = self.place + np.log(len(scores))
        hits = [(a, b, s) for a, b, s in found if s - bar >= -np.log(EXPECTED)]
        over = np.sort([s - bar for _, _, s in found])[::-1]
        total, r = np.cumsum(over), np.arange(1, len(over) + 1)
        joint = np.where(total > 0, total - (r - 1) * np.log(np.maximum(total, 1e-9)) + _log_factorials(r), over[0])
        return [float(np.clip(x, -NO_EVIDENCE, MOST_EVIDENCE)) for x in (over[0], joint.max())], hits

    def probability(self, features: list[float]) -> float:
        return float(sigmoid(np.dot(self.weights[:-1], features) + self.weights[-1]))


def _log_factorials(r: np.ndarray) -> np.ndarray:
    """log(r!) + log((r - 1)!) for 1, 2, ..."""
    logs = np.log(r)
    return 2 * np.cumsum(logs) - logs


def _counts(docs: DataFrame, known: dict) -> DataFrame:
    """(piece, n, n0, n1): document counts of pieces, of all documents and of the labelled ones by label. Summed in tasks, then by piece."""

    def run(batches):
        parts = [Counter(), Counter(), Counter()]  # documents that hold a word: unlabelled, label 0, label 1

        def out():
            sums: dict[str, list[int]] = {}
            for row, counted in enumerate(parts):
                for word, n in counted.items():
                    for x in pieces(word):
                        got = sums.setdefault(x, [0, 0, 0])
                        got[row] += n
                counted.clear()
            n, n0, n1 = np.array(list(sums.values()), np.int64).reshape(-1, 3).T
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *map(pa.array, (n + n0 + n1, n0, n1))], ["piece", "n", "n0", "n1"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                parts[1 + known[doc] if doc in known else 0].update(set(words_of(text)))
                if sum(map(len, parts)) > HELD:
                    yield out()
        yield out()

    parts = map_rows(docs, run, "piece string, n bigint, n0 bigint, n1 bigint")
    return parts.groupBy("piece").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")])


def log_odds(counts: DataFrame) -> dict[str, float]:
    """Shrunken log-odds of toxic against other labelled documents, of the pieces where they are not zero.

    ``counts`` has (piece, n, n0, n1). Pieces that keep a score need evidence or a large prior, and both are shares of the
    labelled sample, so their number is bounded by it and not by the corpus.
    """
    counts = durable(counts)
    corpus, clean, toxic = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n0", "n1")]).first()
    if not clean or not toxic:
        return {}
    prior = F.col("n") * (PRIOR_SHARE * (clean + toxic) / corpus)
    in_toxic, in_clean = F.col("n1") + prior, F.col("n0") + prior
    all_toxic, all_clean = toxic + PRIOR_SHARE * (clean + toxic), clean + PRIOR_SHARE * (clean + toxic)
    odds = F.log(in_toxic / (F.lit(all_toxic) - in_toxic)) - F.log(in_clean / (F.lit(all_clean) - in_clean))
    over = F.abs(odds) - ERRORS * F.sqrt(1 / in_toxic + 1 / in_clean)
    # a sample of one piece has no odds
    scored = counts.select("piece", (F.signum(odds) * over).alias("score"), over.alias("over")).where("over > 0 AND NOT isnan(over) AND over < double('infinity')")
    return {r["piece"]: r["score"] for r in scored.select("piece", "score").toLocalIterator()}


def one_of_each(docs: DataFrame, known: dict) -> dict:
    """``known`` without ids whose text another one has too: a much copied text must not count as many."""
    if not known:
        return known
    spark = docs.sparkSession
    ids = spark.createDataFrame([(int(k),) for k in known], "doc_id bigint")  # as many as the sample at most
    seen = docs.join(F.broadcast(ids), "doc_id").select("doc_id", F.xxhash64("text").alias("h")).groupBy("h").agg(F.min("doc_id").alias("id"))
    return {int(r["id"]): known[int(r["id"])] for r in seen.select("id").toLocalIterator()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 5, left_out: int = 0, rows: int = FIT_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, label) outside the left-out fold, ``rows`` of them at most; counts cover all of ``docs``.

    Without a label of either kind every text scores the share of ones (one half without any label).
    """
    docs = _pick(docs)
    known = one_of_each(docs, labelled_sample(labels, "doc_id", label, divisor, left_out, rows))
    scores = log_odds(_counts(docs, known))
    model = Model(scores, 1.0, 0.0, np.zeros(3))

    def labelled(batch, score):
        return [(known[d], score.of(t)) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if d in known]

    def best(batches):
        score = Scores(model.scores)
        for b in batches:
            rows = labelled(b, score)
            out = [(y, max((s for _, _, s in segments(x)), default=0.0), len(x)) for y, x in rows]
            # how often each score occurs in clean documents, to three places
            values, times = np.unique(np.round(np.concatenate([np.zeros(0), *[x for y, x in rows if y == 0]]), 3), return_counts=True)
            out += [(-1, v, n) for v, n in zip(values.tolist(), times.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int32(), pa.float64(), pa.int64()))],
                                             ["y", "top", "n"])

    seen = map_rows(docs, best, "y int, top double, n bigint")
    drawn = seen.where("y = -1").groupBy("top").agg(F.sum("n").alias("n")).toPandas()
    model.scale = extreme_scale(drawn["n"].to_numpy() / max(drawn["n"].sum(), 1), drawn["top"].to_numpy())
    clean = seen.where("y = 0").select("top", "n").toPandas()
    # of a Gumbel law, the mean is its place plus Euler's constant
    model.place = float((model.scale * clean["top"] - np.log(clean["n"].clip(lower=1))).mean() - np.euler_gamma) if len(clean) else 0.0

    def evidence(batches):
        score = Scores(model.scores)
        for b in batches:
            rows = [(y, model.evidence(x)[0]) for y, x in labelled(b, score)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([x[0] for _, x in rows], pa.float64()),
                                              pa.array([x[1] for _, x in rows], pa.float64())], ["y", "a", "b"])

    seen = map_rows(docs, evidence, "y int, a double, b double").toPandas()
    y = seen["y"].to_numpy(float)
    if 0 < y.sum() < len(y):
        x = seen[["a", "b"]].to_numpy()
        model.weights = fit_logistic(x, y)
        if model.weights[:2].min() < 0:  # more evidence must never lower a score
            only, place = fit_logistic(x[:, 1:], y)
            model.weights = np.array([0.0, max(only, 0.0), place])
    elif len(y):
        model.weights = np.array([0.0, 0.0, 30.0 if y[0] else -30.0])
    return model


def _pick(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _passages(text: str, hits: list[tuple[int, int, float]]) -> list[dict]:
    """Passages as code points of ``text``, from token numbers. Lower-casing may lengthen a text, so offsets follow it back."""
    if not hits:
        return []
    low = text.lower()
    at = [m.span() for m in _TOKEN.finditer(low)]
    back = None
    if len(low) != len(text):
        back = np.concatenate([np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]), [len(text)]])
    out = []
    for a, b, s in hits:
        start, end = at[a][0], at[b - 1][1]
        if back is not None:
            start, end = int(back[start]), int(back[end - 1]) + 1
        out.append({"start": start, "end": end, "surprise": s})
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages: array of start, end, surprise) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no passages and the score of no evidence. Null and repeated doc_ids are kept; other columns
    are ignored. A text is scored whole whatever its length, and equal texts alike. An empty table gives no rows.
    """
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64())])

    def run(batches):
        scores = Scores(model.scores)
        for b in batches:
            p, spans = [], []
            for text in b.column("text").to_pylist():
                features, hits = model.evidence(scores.of(text))
                p.append(model.probability(features))
                spans.append(_passages(text or "", hits))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array(spans, pa.list_(kind))], ["doc_id", "score", "passages"])

    return map_rows(_pick(docs), run, "doc_id bigint, score double, passages array<struct<start:bigint,end:bigint,surprise:double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    A null text counts as empty and stays where no evidence means clean. Rows that repeat stay or go together.
    """
    at_text = docs.columns.index("text")

    def run(batches):
        scores = Scores(model.scores)
        for b in batches:
            keep = [model.probability(model.evidence(scores.of(t))[0]) < threshold for t in b.column(at_text).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, run, docs.schema)
