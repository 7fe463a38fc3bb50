"""k-mer vectors against a count by hand, and fits that run once."""

from collections import Counter

from regspan.operators import training as L


def test_kmer_vectors_are_frequencies(spark):
    texts = ["ACGTNacgtACGTTTTGGG", "AC", "", "éACGTACGTüACGGT\nAAC", "😀ACGTACGA😀", "ACGTAC"]
    got = L.feat_kmer_vector(spark.createDataFrame(list(enumerate(texts)), "id int, sequence string")).collect()
    for r in got:
        s = "".join(c if c in "ACGT" else "A" for c in texts[r.id])
        n = Counter(sum("ACGT".index(c) * 4 ** (5 - j) for j, c in enumerate(s[i:i + 6])) for i in range(len(s) - 5))
        assert r.features.size == 4096
        assert {int(i): v for i, v in zip(r.features.indices, r.features.values)} == {i: v / sum(n.values()) for i, v in n.items()}


def test_a_fit_runs_once(spark, monkeypatch):
    limits, fit = [], L.LogisticRegression.fit
    monkeypatch.setattr(L.LogisticRegression, "fit", lambda self, rows: (limits.append(self.getMaxIter()), fit(self, rows))[1])
    texts = [("ACGTACGTAA" * (i % 3 + 1) + "ACGGT"[: i % 5] * 3, float(i % 2), "test" if i % 4 == 0 else "train", i) for i in range(40)]
    d = spark.createDataFrame(texts, "sequence string, y double, split string, id int")
    scores = L.train_logistic_kmer(d, ["y"], ["id"], max_iter=1, most_iter=1600, tasks=3)
    assert scores.count() == 10 and limits == [1024]
