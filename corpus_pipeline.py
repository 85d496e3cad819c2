"""A corpus-cleaning pipeline over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, quality, simhash, spans
from tessera.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.apply_rules(docs.select(*COLUMNS), model).filter("kept").select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the least id, of each group of near duplicates."""
    return simhash.representatives(docs.select(*COLUMNS))


def spans_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated sentence spans; a document that loses all its text goes."""
    left = spans.remove_repeats(docs.select(*COLUMNS)).filter("n_removed = 0 or text <> ''")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    found = decontam.contaminated_keys(docs, table(spark, sf_dir, "benchmark"))
    keys = found.select(F.col("doc_id").alias("_d"), F.col("_tkey").alias("_k"))
    rows = docs.select(*COLUMNS)
    return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_k")), "left_anti")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text")))
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), whole.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("substring_dedup", spans_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_level_bpe", tokens_stage),
]

#: No SQL for the trained rules, fingerprints or merges; tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
