"""A training-data pipeline of five operators over documents, each stage over all that the one before kept.

Very long texts are treated whole, columns with other names pass through, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorehive.llm import decontaminate, langid, mixing, secret_scan, simhash
from lorehive.llm.common import new_path, table
from lorehive.stage import discarded, remove


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), or without a language that half of
    their text is in. Ties: the lesser name. Repeated rows and null ids: each by its own text."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of linked SimHash fingerprints; of rows that
    repeat it, one. Null ids come last."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap an item of the benchmark; null and empty texts, and repeated rows, stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces credentials by a mark, but for widely copied examples; all rows stay, null texts too."""
    return secret_scan.redact_live(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each row that the mix takes; rows that it doesn't take have none. Null text: size 0;
    null source: one of its own."""
    return mixing.pareto_mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("source_mix", mix_sources),
]

#: SQL can express neither the language model nor the connected components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document that is kept, for the mix. Each stage's input is removed once its output is written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with discarded(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if read:
            remove(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
