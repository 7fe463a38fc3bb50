"""The registered query of each operator: production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from regspan.llm import byte_bpe, language, lemp, media, merkle, packing, planes, quality, secrets, simhash, sql, toxicity, urls, vectors
from regspan.llm.common import held_out, remainder, table
from regspan.session import scratch_path

#: Vocabulary files are found by the installed package of public tokenizers.
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
BYTE_BPE_JSON = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), words=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", divisor=5, left_out=0)
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"))


def _joined(spans, *parts):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[p] for p in parts])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    part = ("kind", "start", "end")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(_joined(base, *part).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans"), *part).alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), size=2048)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.features(media.with_media(table(spark, sf_dir, "documents")))
    return got.select(
        "doc_id", "n_bytes", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("pairs"), F.lower(F.hex(F.xxhash64("pairs")))).alias("feature"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs, divisor=3, left_out=1)).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    where = (tokenizer_path(BYTE_BPE), public_tokenizers.PATTERN)
    got = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), *where), *where)
    return got.select("doc_id", F.expr("length(ids) div 4").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("raw", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", divisor=5, left_out=0)
    return quality.score(docs, net).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    proved = merkle.manifest(table(spark, sf_dir, "documents"), tampered=remainder(F.col("doc_id"), 7) == 0)
    return merkle.verify(proved)


def op12_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "planes")
    planes.write(table(spark, sf_dir, "documents"), folder, tokenizer_path(BYTE_BPE_JSON))
    return planes.digests(spark, folder)


def op13_lemp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lemp.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_secrets, op4_packing, op5_media, op6_language, op7_vectors, op8_urls,
                                   op9_byte_bpe, op10_quality, op11_merkle, op12_planes,
                                   op13_lemp)}
#: The others have none: their methods or their digests are not expressible there; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op11_merkle": sql.MERKLE, "op13_lemp": sql.LEMP}
