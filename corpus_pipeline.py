"""The corpus pipeline: stages over documents, each on what the one before kept.

1. quality rules: documents that fail a rule, or whose host is rejected, go;
2. near duplicates (five-word shingles, 0.8): of each group the smallest doc_id stays;
3. suffix dedup: strings of 100 bytes that stand earlier are cut out of the texts;
4. source mix: sources are brought to their target weights;
5. packing: what is left becomes token sequences.

Stages 1 to 4 return the columns of documents, ``n_chars`` counted anew where a text changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmart.llm import mixing, near_dedup, packing, quality_rules, suffix_dedup
from jobmart.llm.common import materialize
from jobmart.llm.queries import LEVELS, WEIGHTS, vocabulary, with_domain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that reach the mix which the mix may keep.
MIX_SHARE = 0.9


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row is kept by its own measures and its host's verdict. Rows that repeat are judged
    alike, so rejected documents are known by doc_id and text."""
    judged = quality_rules.judged(
        docs.withColumn("_text_id", F.xxhash64("text")), host="source", keep=("_text_id",)
    )
    gone = judged.where("NOT kept").select(
        F.col("doc_id").alias("_id"), F.col("_text_id").alias("_gone")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_gone"))
    return docs.join(gone.distinct(), same, "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a group other than its smallest go; a text without words stays."""
    found = near_dedup.near_duplicates(docs, size=5, threshold=80)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated bytes. A cut inside a character takes the whole character;
    a document of which nothing is left goes, and a null text becomes an empty one."""
    cut = suffix_dedup.deduplicated(
        docs, least=100, keep=("lang", "source", "n_chars"), texts_too=True
    )
    touched = F.col("n_removed") > 0
    text = F.when(touched, suffix_dedup.whole_characters(F.col("kept"))).otherwise(F.col("kept").cast("string"))
    n_chars = F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return (
        cut.where(~touched | (F.col("n_removed") < F.col("n_bytes")))
        .withColumn("text", text)
        .withColumn("n_chars", n_chars)
        .select(*COLUMNS)
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = with_domain(docs)
    leaves = mixing.plan(docs, LEVELS, share=MIX_SHARE, weights=WEIGHTS, epochs=1)
    return mixing.selected(docs, leaves, LEVELS).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(), capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", rules),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", suffixes),
    ("source_mix", mix),
    ("best_fit_packing", pack),
]

#: Packing and its tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
