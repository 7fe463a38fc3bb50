"""The corpus pipeline against a plain version of the same decisions."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from regspan.llm import language, queries, secrets, simhash, toxicity
from regspan.llm.common import table
from tests.llm.test_llm import check_packing, plain_ids, union_find

SF = "/root/testdata/sf0.001"


def plain_groups(texts):
    marks = {i: simhash.marks(t) for i, t in texts.items()}

    def near(a, b):
        return any((x ^ y).bit_count() <= 4 for x, y in zip(a[0], b[0])) and (a[1] ^ b[1]).bit_count() <= 10

    return union_find(marks, [(i, j) for i in marks for j in marks if j < i and near(marks[i], marks[j])])


def shingles(text, k=5):
    words = text.split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def changed(rng, words, vocabulary, least, most):
    """The words with as many of them replaced, dropped or added as bring the shingle similarity between two bounds."""
    mine, whole = list(words), shingles(" ".join(words))
    while True:
        at = rng.randrange(len(mine))
        mine[at:at + 1] = rng.choice([[rng.choice(vocabulary)], [], [mine[at], rng.choice(vocabulary)]])
        now = jaccard(whole, shingles(" ".join(mine)))
        if now < least:
            mine = list(words)
        elif now <= most:
            return mine


@pytest.mark.parametrize("level", [0.8, 0.85, 0.9, 0.95])
def test_recall_of_near_copies_against_brute_force(spark, level):
    rng = random.Random(int(100 * level))
    vocabulary = [f"w{i}" for i in range(4000)] + ["the", "of", "and"] * 300
    rows, pairs = [], []
    for i in range(250):
        words = rng.choices(vocabulary, k=rng.randint(100, 400))
        other = changed(rng, words, vocabulary, level, level + 0.012)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append((2 * i, 2 * i + 1))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert {a for a, _ in pairs} <= kept  # unrelated texts stay
    assert sum(b not in kept for _, b in pairs) >= 0.9 * len(pairs)


def test_no_text_goes_without_a_near_copy(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF.replace("0.001", "0.01"), "documents").collect()}
    sets = {i: shingles(t.lower()) for i, t in texts.items()}
    kept = {r["doc_id"] for r in simhash.keep_one(table(spark, SF.replace("0.001", "0.01"), "documents")).collect()}
    gone = set(texts) - kept
    assert gone and all(max(jaccard(sets[i], sets[j]) for j in texts if j != i) >= 0.5 for i in gone)
    held = defaultdict(list)
    for i, x in sets.items():
        for y in x:
            held[y].append(i)
    near = {(a, b) for v in held.values() if len(v) < 60 for a in v for b in v if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    left = [(a, b) for a, b in near if a in kept and b in kept]
    assert len(near) > 50 and len(left) <= 0.1 * len(near)


def test_pipeline_against_plain_version(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labeller = language.Labeller(language.fit(docs))
    told = {i: t for i, t in texts.items() if (x := labeller.texts([t])[0])[0] != "und" and x[1] > 0.3}
    left = docs.where(F.col("doc_id").isin([*told]))
    model = toxicity.fit(left, table(spark, SF, "labels"))
    scores = toxicity.Scores(model.scores)
    clean = {i: t for i, t in told.items() if model.probability(model.evidence(scores.of(t))[0]) < 0.5}
    roots = plain_groups(clean)
    kept = {i: secrets.redacted(t, secrets.spans(t)) for i, t in clean.items() if roots[i] == i}
    got = defaultdict(list)
    rows = pipeline.run(spark, SF).collect()
    for r in rows:
        got[r["doc_id"]].append(r)
    assert set(got) == set(kept)
    for i, t in kept.items():
        assert sum(r["length"] for r in got[i]) == len(plain_ids(t))
    assert check_packing(rows, 2048) <= 1.05 * sum(r["length"] for r in rows) / 2048 + 1


def test_stages_keep_columns_and_take_hard_rows(spark, tmp_path):
    spark.createDataFrame([(i, 0, 1) for i in range(9)], "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:5]  # rows that the field may learn from
    texts = [None, "", "Wort " * 40, "the cat and the dog went home early today " * 5, "the cat and the dog went home early today " * 5, "12 34"]
    docs = spark.createDataFrame([(i, t, "de" if t and t[0] == "W" else "en", None, None) for i, t in zip([*ids, None], texts)], schema)
    for rows in (docs, docs.union(docs), docs.limit(0)):
        now = rows
        for name, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema], name
        packed = pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert {r["doc_id"] for r in packed} == (set() if rows.isEmpty() else set(ids[2:4]))


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n for n in names if n.startswith("op")} == set(queries.QUERIES)
    assert 4 <= len(pipeline.STAGES) <= 5
