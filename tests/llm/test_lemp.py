"""Ranked search against plain scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspan.llm import lemp, queries, sql
from tests.compare import compare, connect
from tests.llm.test_llm import DOC, HARD, SF


def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k):
    """Rows (item_id, rank, doc_id, score); ``docs`` and ``items`` are (id, text)."""
    counts = [Counter(plain_terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    whole, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        asked = plain_terms(text)
        scores = []
        for (doc, _), c, x in zip(docs, counts, n):
            s = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * x * whole // length)))
                    for t in asked if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:k])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOC)


def found(got):
    return sorted(map(str, map(tuple, got.collect())))


def test_terms():
    for t in [*HARD, "A-b_C9é\x80\x7f{Z}`q@[x", "日本 x" * 3, "x" * 50]:
        assert lemp.term_counts(t) == Counter(w.encode() for w in plain_terms(t))


def test_long_texts_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(lemp, "_STRETCH", 7)
    text = "ab cde fghij é klmnopqrstuvwxyz ab " * 20
    assert lemp.term_counts(text) == Counter(w.encode() for w in plain_terms(text))


@pytest.mark.parametrize("k, bucket, query_bytes", [(3, 5, 1 << 20), (10, 4096, 400)])
def test_search_against_plain_scores(spark, k, bucket, query_bytes):
    rng = random.Random(k)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 30, 200])))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(12)] + [(3, docs[3][1])] * 2  # ties and repeated rows
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(9)] + [(0, docs[7][1]), (None, docs[9][1]), (40, "w1 w1 w1"), (41, "no_such_term")]
    extra = frame(spark, docs).repartition(4).withColumn("norm", F.lit(1)).withColumn("terms", F.lit("x")).withColumn("part", F.lit(3))
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("block", F.lit(9)).withColumn("score", F.lit(1))
    assert found(lemp.search(extra, asked, k, bucket, query_bytes)) == sorted(map(str, plain_search(docs, items, k)))


def test_search_hard_rows(spark):
    docs = [(None if i % 4 == 1 else i, t) for i, t in enumerate([*HARD, *HARD, "long words " * 50_000])]
    items = [(1, None), (2, ""), (3, "A b C d word long"), (3, "a"), (4, "日本語 é x ²")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(lemp.search(frame(spark, docs), asked, 10, 4)) == sorted(map(str, plain_search(docs, items, 10)))
    assert lemp.search(frame(spark, docs).limit(0), asked).count() == 0
    assert lemp.search(frame(spark, [(1, None), (2, "")]), asked).count() == 0
    assert lemp.search(frame(spark, docs), asked.limit(0)).count() == 0


def test_bounds_drop_no_winner_and_prune():
    rng = np.random.default_rng(4)
    rows, kept, seen = [], 0, 0
    for _ in range(200):
        terms = np.sort(rng.choice(60, rng.integers(1, 20), replace=False))
        rows.append((terms, rng.integers(0, 10 ** 9, len(terms))))
    starts = np.cumsum([0, *[len(t) for t, _ in rows]])
    impacts = np.concatenate([x for _, x in rows])
    norm = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, starts[:-1]))
    held = lemp.Bucket(lemp.Rows(np.arange(200), np.zeros(200, bool), starts, np.concatenate([t for t, _ in rows]), impacts, norm))
    for _ in range(100):
        terms, repeats = np.sort(rng.choice(70, 8, replace=False)), rng.integers(1, 4, 8)
        query = np.zeros(70, np.int64)
        query[terms] = repeats
        exact = np.array([(x * query[t]).sum() for t, x in rows])
        least = int(np.sort(exact)[-10])
        got = held.survivors(terms, repeats, max(1, least))
        assert set(np.flatnonzero((exact >= least) & (exact > 0))) <= set(got.tolist())
        assert (held.scores(got, query) == exact[got]).all()
        kept, seen = kept + len(got), seen + 200
    assert kept < 0.5 * seen


def test_op13_against_sql(spark):
    assert compare(spark, connect(SF), queries.op13_lemp, sql.LEMP, SF) == "ok 400"
