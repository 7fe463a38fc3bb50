"""Pieces of words are counted by themselves, however many there are."""

import zlib

import numpy as np

from regspan.llm import toxicity
from tests.llm.test_llm import documents


def stranger(piece):
    """A word whose crc32 falls into the same one of 2^18 buckets."""
    want = zlib.crc32(piece.encode()) % (1 << 18)
    return next(w for i in range(10 ** 8) if zlib.crc32((w := f"q{i}").encode()) % (1 << 18) == want)


def fitted(spark, words_clean):
    texts = [f"filler number {i} old scum met here today" if i % 3 == 0 else f"filler number {i} {words_clean} met here today" for i in range(300)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    return docs, labels, toxicity.fit(docs, labels, left_out=-1)


def test_a_clean_word_does_not_share_the_bucket_of_a_toxic_one(spark):
    other = stranger("scum")
    _, _, model = fitted(spark, f"kind {other}")
    scores = toxicity.Scores(model.scores)
    assert scores["scum"] > 0.5 and scores[other] < -0.5 and scores["unheard"] == -toxicity.TOKEN_COST


def test_counts_and_odds_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 5)  # tasks pass on what they hold again and again
    docs, labels, model = fitted(spark, "kind people")
    known = toxicity.one_of_each(docs, {r["doc_id"]: r["toxic"] for r in labels.collect()})
    want = {}
    for r in docs.collect():
        for w in set(toxicity.words_of(r["text"])):
            for x in toxicity.pieces(w):
                n = want.setdefault(x, np.zeros(3))
                n[0] += 1
                if r["doc_id"] in known:
                    n[1 + known[r["doc_id"]]] += 1
    got = {r["piece"]: (r["n"], r["n0"], r["n1"]) for r in toxicity._counts(toxicity._pick(docs), known).collect()}
    assert got == {x: tuple(n) for x, n in want.items()}
    corpus, clean, toxic = np.array([*want.values()]).T
    prior = toxicity.PRIOR_SHARE * (clean.sum() + toxic.sum()) * corpus / corpus.sum()
    t, c = toxic + prior, clean + prior
    odds = np.log(t / (t.sum() - t)) - np.log(c / (c.sum() - c))
    score = np.sign(odds) * np.maximum(np.abs(odds) - toxicity.ERRORS * np.sqrt(1 / t + 1 / c), 0)
    plain = {x: s for x, s in zip(want, score) if s}
    assert model.scores.keys() == plain.keys() and all(abs(model.scores[x] - s) < 1e-9 for x, s in plain.items())
    assert toxicity.log_odds(spark.createDataFrame([], "piece string, n bigint, n0 bigint, n1 bigint")) == {}
