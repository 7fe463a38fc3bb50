"""Token planes against the tokenizers library and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspan.llm import planes, queries
from regspan.llm.common import table
from tests.llm.test_llm import DOC, HARD, SF

PATH = queries.tokenizer_path(queries.BYTE_BPE_JSON)


def plain_ids(text):
    tok = planes.encoder(PATH).tok
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_encoder_against_the_library():
    rng, encode = random.Random(3), planes.Encoder(PATH)
    signs = ["a", "É", " ", "  ", "\n", "'s", "'", "0", "²", "ß", "漢", "🙂", "́", "!", "\x1c", " ", "　", "\t", "<|endoftext|>", "\x85", "Word", " b", "."]
    for t in [*HARD, *("".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000))]:
        assert encode(t) + b"\0\0\0\0" == plain_ids(t), repr(t)


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 65, 1000])
def test_container_round_trip(bits, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, [2, 50_000, 1 << 32][n % 3], n, dtype=np.uint64).astype("<u4")
    docs, counts = [None, -5, 7, 7], [0, n // 3, n // 3, n - 2 * (n // 3)]
    box = planes.Container(planes.pack_container(docs, counts, ids.tobytes(), 11, block=64, bits=bits))
    assert (box.docs, box.counts.tolist(), box.start, box.n_ids) == (docs, counts, 11, n)
    assert all(box.ids(a, b) == ids[a:b].tobytes() for a in range(0, n, 61) for b in range(a, n + 1, 37))
    with pytest.raises(ValueError):
        planes.Container(b"x" * 200)


def test_write_and_read_hard_rows(spark, tmp_path):
    texts = [*HARD, *HARD[:5], "word, " * 40_000]
    rows = [(None if i % 6 == 5 else i - 3 if i % 4 else 2, t, None, "s", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC).withColumn("part", F.lit(1)).withColumn("start", F.lit("x")).withColumn("data", F.lit(2)).repartition(3)
    planes.write(docs, f"{tmp_path}/a", PATH, block=128, bits=1, container=1000)
    got = sorted(planes.read(spark, f"{tmp_path}/a").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == sorted((str(r[0]), plain_ids(r[1])) for r in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *[len(r["ids"]) // 4 for r in got]])[:-1].tolist()
    some = {(r["doc_id"], bytes(r["ids"])) for r in planes.lookup(spark, f"{tmp_path}/a", 2, 6).collect()}
    assert some == {(r[0], plain_ids(r[1])) for r in rows if r[0] is not None and 2 <= r[0] <= 6}
    planes.write(docs.limit(0), f"{tmp_path}/b", PATH)
    assert planes.read(spark, f"{tmp_path}/b").count() == 0


def test_op12_against_the_library(spark):
    start, want = 0, []
    for r in table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = plain_ids(r["text"])
        want.append((r["doc_id"], start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, queries.op12_planes(spark, SF).collect())) == want
