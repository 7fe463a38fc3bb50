"""Baseline classifiers on TF bits, k-mers and peak statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F

from regspan.operators import evaluation as E
from regspan.operators.scale import checked_broadcast, dealt, numbered_names, salted_join
from regspan.operators.sequence import kmer_codes
from regspan.session import durable

TABULAR = ["max_motif_score", "max_fp_score", "mean_motif_score", "mean_fp_score", "n_tfs"]


def feat_tf_vector(peaks: DataFrame, tfs: str = "tfs", vocabulary: DataFrame | None = None) -> DataFrame:
    """TF set as a sparse binary vector over the sorted vocabulary.

    Words are numbered as a table (tf, idx), joined to the exploded sets and gathered again, so a vocabulary of any size
    serves. One that proves small is broadcast, so that the words of a row stay in its task; otherwise words go to their
    places in a shuffle. ``vocabulary`` gives the table; words outside it have no place.
    """
    rows = durable(peaks.withColumn("_row", F.monotonically_increasing_id()))  # written, so that the numbers stay
    words = rows.select("_row", F.explode(F.array_distinct(tfs)).alias("tf"))
    table = durable(numbered_names(words, "tf") if vocabulary is None else vocabulary)
    size = table.agg(F.max("idx")).first()[0]
    size = 0 if size is None else size + 1
    small = checked_broadcast(table)
    placed = salted_join(words, table, ["tf"], spread=["_row"]) if small is table else words.join(small, "tf")
    at = placed.groupBy("_row").agg(F.array_sort(F.collect_list(F.col("idx").cast("int"))).alias("_at"))
    vector = F.udf(lambda places: Vectors.sparse(size, places or [], [1.0] * len(places or [])), VectorUDT())
    return rows.join(at, "_row", "left").withColumn("features", vector("_at")).drop("_row", "_at")


def feat_kmer_vector(seqs: DataFrame, seq: str = "sequence", k: int = 6) -> DataFrame:
    """k-mer frequencies as a sparse vector of 4^k places, in alphabetical order of the k-mers.

    Letters other than A, C, G, T are read as A. k-mers are counted as integer codes, which rise as their names do.
    """
    cells = 4 ** k

    @F.arrow_udf(VectorUDT())
    def frequencies(texts: pa.Array) -> pa.Array:
        places, shares = [np.zeros(0, np.int32)], [np.zeros(0)]
        for text in texts:
            n = np.bincount(kmer_codes(text.as_py(), k), minlength=cells)
            found = np.flatnonzero(n)
            places.append(found.astype(np.int32))
            shares.append(n[found] / max(n.sum(), 1))
        ends = pa.array(np.cumsum([len(x) for x in places]), pa.int32())
        rows = len(texts)
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, cells, np.int32)),
             pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(shares)))],
            ["type", "size", "indices", "values"])

    ascii_only = F.when(F.octet_length(seq) == F.length(seq), F.col(seq)).otherwise(F.regexp_replace(seq, "[^\\x00-\\x7F]", "N"))
    return seqs.withColumn("features", frequencies(ascii_only.cast("binary")))


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """Row weight N / (2 n_class)."""
    n, pos = df.agg(F.count("*"), F.count_if(F.col(label) == 1)).first()
    weight = F.when(F.col(label) == 1, n / (2 * max(pos, 1))).otherwise(n / (2 * max(n - pos, 1)))
    return df.withColumn("weight", weight)


def _scores(model, test: DataFrame, label: str, key: list[str]) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(test).select(*key, F.lit(label).alias("head"), F.col(label).alias("y"), p.alias("p"))


def train_logistic(data: DataFrame, labels: list[str], key: list[str], train: str = "split = 'train'",
                   test: str = "split = 'test'", max_iter: int = 100, most_iter: int = 3200) -> DataFrame:
    """One weighted logistic regression per label; returns long test scores.

    ``max_iter`` is doubled as often as ``most_iter`` allows; not converging within that is an error.
    """
    out = None
    while max_iter * 2 <= most_iter:
        max_iter *= 2
    data = durable(data)  # the optimiser reads it many times
    for label in labels:
        rows = balanced_weight(data.where(train), label)
        lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1e-6)
        model = lr.setMaxIter(max_iter).fit(rows)
        if model.hasSummary and model.summary.totalIterations >= max_iter:
            raise RuntimeError(f"{label}: no convergence in {most_iter} iterations")
        part = _scores(model, data.where(test), label, key)
        out = part if out is None else out.unionByName(part)
    return out


def train_logistic_tf(peaks: DataFrame, labels: list[str], key: list[str], **kw) -> DataFrame:
    return train_logistic(feat_tf_vector(peaks), labels, key, **kw)


def train_logistic_kmer(seqs: DataFrame, labels: list[str], key: list[str], seq: str = "sequence", k: int = 6,
                        tasks: int | None = None, **kw) -> DataFrame:
    """Logistic regression on k-mer frequencies; ``tasks`` deals the sequences over that many tasks before k-mers are counted."""
    return train_logistic(feat_kmer_vector(dealt(seqs, tasks, *key), seq, k).drop(seq), labels, key, **kw)


def train_gbt(peaks: DataFrame, labels: list[str], key: list[str], trees: int = 20, depth: int = 5) -> DataFrame:
    """Boosted trees on TF bits and the five peak statistics; ``trees`` rounds of trees of ``depth``, no early stop."""
    bits = feat_tf_vector(peaks).withColumnRenamed("features", "tf_bits")
    data = durable(VectorAssembler(inputCols=["tf_bits", *TABULAR], outputCol="features").transform(bits))
    out = None
    for label in labels:
        gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, seed=1)
        part = _scores(gbt.fit(balanced_weight(data.where("split = 'train'"), label)), data.where("split = 'test'"), label, key)
        out = part if out is None else out.unionByName(part)
    return out


def score_metrics(scores: DataFrame) -> DataFrame:
    return E.head_metrics(scores, ["head"])
