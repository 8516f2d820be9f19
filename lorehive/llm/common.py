"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorehive.stage import new_path, shared_dir, staged

__all__ = ["WORD", "hash_unit", "id_remainder", "n_words", "new_path", "shared_dir", "staged", "table"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words in text; null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def id_remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def hash_unit(*cols: Column) -> Column:
    """A number strictly between 0 and 1 from the md5 of cols as text: the same in every run."""
    text = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
