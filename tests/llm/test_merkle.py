"""The Merkle manifest against a plain tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from regspan.llm import merkle, queries
from regspan.llm.common import remainder, table
from tests.llm.test_llm import DOC, HARD, SF


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_path(levels, at, fanout):
    """(siblings before, siblings after) level by level."""
    for level in levels[:-1]:
        lo = at - at % fanout
        yield level[lo:at], level[at + 1:lo + fanout]
        at //= fanout


def plain_manifest(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault((row["lang"] is not None, (row["lang"] or "").encode()), []).append(row)
    keys = sorted(groups)
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[k] = plain_tree([plain_leaf(r) for r in groups[k]], fanout)
    top = plain_tree([trees[k][-1][0] for k in keys], fanout)
    out = []
    for i, k in enumerate(keys):
        for j, row in enumerate(groups[k]):
            path = [*plain_path(trees[k], j, fanout), *plain_path(top, i, fanout)]
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            folded = plain_leaf(row, int(tampered))
            for before, after in path:
                folded = digest(*before, folded, *after)
            proof = digest(*[x for before, after in path for x in [*before, *after]])
            out.append((row["doc_id"], trees[k][0][j], trees[k][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("fanout, levels, n", [(2, 2, 70), (3, 1, 31), (2, 12, 40)])
def test_manifest_against_plain_tree(spark, fanout, levels, n):
    rows = [(i, f"text {i}", ["en", "fr", None, "é", "z"][i % 11 % 5], "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = merkle.verify(merkle.manifest(docs, remainder(F.col("doc_id"), 7) == 0, fanout, levels), fanout).collect()
    assert ordered(got) == ordered(plain_manifest([r.asDict() for r in docs.collect()], fanout))


def test_manifest_hard_rows(spark):
    rows = [(i if i % 5 else None, t, "en" if i % 3 else None, None if i % 4 else "s", 2 ** 63 - 1 if i % 2 else None) for i, t in enumerate(HARD)]
    rows += rows[:6] + [(7, "one", "en", "s", 1), (7, "two", "en", "s", 1), (8, "long " * 200_000, "", "s", 1)]
    docs = spark.createDataFrame(rows, DOC)
    extra = docs
    for name in ("k", "leaf", "place", "n", "block", "proof", "node", "told", "_tie", "_part", "root"):
        extra = extra.withColumn(name, F.lit(1))
    got = merkle.verify(merkle.manifest(extra, remainder(F.col("doc_id"), 7) == 0, levels=2)).collect()
    assert ordered(got) == ordered(plain_manifest([r.asDict() for r in docs.collect()], 2))
    assert merkle.verify(merkle.manifest(docs.limit(0))).count() == 0


def test_untampered_rows_verify_and_others_do_not(spark):
    docs = table(spark, SF, "documents")
    got = queries.op11_merkle(spark, SF)
    assert got.count() == docs.count()
    assert got.where((remainder(F.col("doc_id"), 7) == 0) == F.col("verified")).count() == 0
