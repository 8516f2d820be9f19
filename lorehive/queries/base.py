"""The driver's tables in the shapes of the knowledge base, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EPOCH = 1704067200


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the same query in SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: longs(f(spark, d))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    """All integers as long, and arrays of strings joined by commas."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def read_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # as a pattern, since the source takes a single file by pattern only
    return spark.readStream.schema(read(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def with_sql(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select


# uploads: one per document row, in order of its id
UP = f"up AS (SELECT doc_id AS upload_id, {EPOCH} + doc_id AS made, source || '_' || doc_id || '.txt' AS filename, text, sha256(text) AS file_hash, [lang, source] AS tags FROM documents)"


def uploads(spark: SparkSession, d: str) -> DataFrame:
    return as_uploads(read(spark, d, "documents"))


def as_uploads(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("upload_id"), F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id")).alias("uploaded_at"), F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("content_type"), F.col("text").cast("binary").alias("content"), F.array("lang", "source").alias("tags"), F.sha2("text", 256).alias("file_hash"),
    )


# documents: one per row, most of them ready
DOCS = f"""docs AS (SELECT doc_id::VARCHAR AS document_id, source || '_' || doc_id || '.txt' AS filename, lang || ' ' || source || ' ' || doc_id AS title,
CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'ready' END AS status, {EPOCH} + doc_id AS made, text, lang, source, doc_id,
sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash FROM documents)"""
LINKS = "links AS (SELECT doc_id::VARCHAR AS document_id, unnest([lang, source]) AS tag FROM documents)"


def documents(spark: SparkSession, d: str) -> DataFrame:
    from lorehive.functions.text import content_fingerprint

    state = F.when(F.col("doc_id") % 10 == 0, "failed").when(F.col("doc_id") % 10 == 1, "pending").otherwise("ready")
    return read(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")).alias("filename"), F.concat_ws(" ", "lang", "source", "doc_id").alias("title"),
        state.alias("status"), F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id")).alias("created_at"), "text", "doc_id", content_fingerprint(F.col("text")).alias("content_hash"),
    )


def links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.explode(F.array("lang", "source")).alias("tag"))


# chunks for retrieval: a document is one chunk under its language
CHUNKS = "chunks AS (SELECT doc_id::VARCHAR AS chunk_id, doc_id::VARCHAR AS document_id, 0 AS chunk_index, lang AS heading_path, text FROM documents)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    return read(spark, d, "documents").select(i.alias("chunk_id"), i.alias("document_id"), F.lit(0).alias("chunk_index"), F.col("lang").alias("heading_path"), F.lit(None).cast("int").alias("page"), "text")


# chunks for structure: a line is a chunk; three lines share a path
LINE_CHUNKS = """lc AS (SELECT doc_id::VARCHAR AS document_id, (i - 1)::BIGINT AS chunk_index, doc_id || ':' || (i - 1) AS chunk_id, CASE WHEN (i - 1) // 3 % 3 < 2 THEN 'part ' || ((i - 1) // 3 % 3) END AS heading_path,
((i - 1) // 4)::BIGINT AS page, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    row = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))
    third = F.floor(F.col("chunk_index") / 3) % 3
    return row.select("document_id", "chunk_index", F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), F.when(third < 2, F.concat(F.lit("part "), third)).alias("heading_path"), F.floor(F.col("chunk_index") / 4).alias("page"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("embedding").alias("vector"))


# ranked lists: what each user clicked or viewed, in order, with repeats
RANKED = """ranked AS (SELECT user_id::VARCHAR AS query_id, CASE event_type WHEN 'click' THEN 'dense' ELSE 'keyword' END AS retriever,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rank, 'c' || (props->>'$.k') AS chunk_id FROM events WHERE event_type IN ('click', 'view'))"""


def ranked(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, d, "events").filter("event_type in ('click', 'view')")
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return rows.select(F.col("user_id").cast("string").alias("query_id"), F.when(F.col("event_type") == "click", "dense").otherwise("keyword").alias("retriever"), nth.alias("rank"), F.concat(F.lit("c"), F.get_json_object("props", "$.k")).alias("chunk_id"))
