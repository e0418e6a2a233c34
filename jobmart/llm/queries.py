"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmart.llm import (
    bm25, byte_bpe, collocations, licenses, line_dedup, mixing, near_dedup, oracles, packing, pu_classifier, quality_rules,
    suffix_dedup, token_store, whitening,
)
from jobmart.llm.common import materialize, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_bm25_search", oracles.BM25)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    shards = max(1, -(-docs.count() // bm25.SHARD_DOCS))
    index = materialize(bm25.build_index(docs.coalesce(shards)), "bm25-index")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25.top_k(index, asked, k=10)


@query("op2_pu_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return pu_classifier.scored(documents(spark, folder), labels, threshold=0.3)


@query("op3_host_rules", oracles.HOST_RULES)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(documents(spark, folder), host="source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query("op4_license_scan", oracles.LICENSES)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(documents(spark, folder))


@query("op5_minhash_near_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, folder), size=2, threshold=80)


@query("op6_line_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.cleaned(documents(spark, folder).select("doc_id", "text"), passages=True)
    spans = F.transform("spans", lambda s: F.concat_ws("-", s["at"], s["until"]))
    return cleaned.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_removed"),
        F.array_join(spans, ",").alias("spans"),
        F.length("kept_text").cast("long").alias("n_kept_chars"),
        F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"),
    )


#: Domains are the families of sources with the same first digit; the query's target weights.
DOMAIN = r"^\D*\d"
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {
    mixing.node("src0"): 2.0,
    mixing.node("src1"): 4.0,
    mixing.node("src1", "en"): 3.0,
    mixing.node("src2"): 0.5,
}


def with_domain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", F.regexp_extract("source", DOMAIN, 0))


@query("op9_source_mix")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_domain(documents(spark, folder))
    leaves = mixing.plan(docs, LEVELS, share=0.5, weights=WEIGHTS, epochs=2)
    return mixing.selected(docs, leaves, LEVELS).select(
        "doc_id", "domain", "lang", "source", "epoch", mixing.text_tokens().alias("n_tokens")
    )


@query("op7_best_fit_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), vocabulary(), capacity=2048, end_id=0)


@query("op8_token_store")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(documents(spark, folder), path, vocabulary(), end_id=1)
    return token_store.scan_store(spark, path)


@query("op10_suffix_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicated(documents(spark, folder), least=100).drop("kept")


@query("op11_byte_bpe")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    docs = documents(spark, folder).select("doc_id", "text")
    ids = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return ids.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_phrase_collocations", oracles.COLLOCATIONS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"), components=4)
