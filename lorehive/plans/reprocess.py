"""Documents of a stored corpus once more through the slow half of ingest, from their stored originals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorehive.operators import catalog as K
from lorehive.operators import chunk as C
from lorehive.operators import parse as P
from lorehive.operators import retrieval as R
from lorehive.plans.ingest import DOCUMENT, KNOWN, Stored, as_documents, process, with_vectors
from lorehive.sources import files as S
from lorehive.stage import discarded, new_path, staged

# Fixed value: what is told where there is no original.
MISSING = "IngestionError: Stored file is missing or empty; re-upload required."


def originals(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """file_hash, content of the stored originals of wanted(file_hash). The blob table is in folders by the first
    two digits of the hash (256 at most); no others are read than those that wanted falls in."""
    prefixes = [r[0] for r in wanted.select(F.substring("file_hash", 1, 2)).distinct().collect()]
    blobs = spark.read.schema("file_hash string, storage_path string, content binary, prefix string").parquet(path)
    found = blobs.filter(F.col("prefix").isin(prefixes)).join(wanted.select("file_hash").distinct(), "file_hash", "left_semi")
    return found.select("file_hash", "content")


def _as_before(then: DataFrame, now: DataFrame) -> DataFrame:
    """Document rows after processing: what is ready is new; a duplicate keeps its title and counts, a
    failed document all but status, error and number of chunks."""
    columns = [c for c in DOCUMENT if c != "document_id"]
    both = then.select("document_id", F.struct(*columns).alias("then")).join(now.select("document_id", F.struct(*columns).alias("now")), "document_id")
    status = F.col("now.status")
    kept = ["filename", "content_type", "byte_size", "file_hash", "storage_path", "version", "created_at"]
    by = {"failed": ["status", "error", "chunk_count", "updated_at"], "duplicate": ["content_hash", "status", "error", "duplicate_of_id", "chunk_count", "summary", "updated_at"]}
    pick = lambda c: F.col(f"then.{c}") if c in kept else F.when(status.isin("ready", *[s for s, new in by.items() if c in new]), F.col(f"now.{c}")).otherwise(F.col(f"then.{c}"))
    return both.select("document_id", *[pick(c).alias(c) for c in columns])


def _put(spark: SparkSession, path: str, new: DataFrame, touched: DataFrame) -> None:
    """new in place of all stored rows of the touched documents; buckets that none of them falls in are left. Where
    these have no stored rows yet, as after a failure, nothing is rewritten."""
    if S.bucket_number(spark, path) is None:
        S.write_bucketed(new, path)
        return
    if S.add_unseen(spark, path, new, touched):
        return

    def merge(old: DataFrame, changed: DataFrame) -> DataFrame:
        return S.replace_chunks(old, new.select(old.columns), changed)

    S.rewrite_touched(spark, path, touched, merge)


def reprocess(
    spark: SparkSession, store: str, blobs: str, ids: DataFrame, *, parsers: dict[str, P.Parser] | None = None, embedder: R.Embedder | None = None, stemmed: bool = True,
    target: int = C.TARGET, overlap: int = C.OVERLAP, least: int = C.LEAST, done: Callable[[str], None] = lambda name: None,
) -> DataFrame:
    """document_id, was, status, error of the documents in ids(document_id), processed again: after a failure,
    with other parsers, or with another chunker.

    store has the tables that sources.files.write_catalogue writes (documents, chunks, postings,
    document_tags, name_grams if names are looked up, and vectors where there is an embedder), blobs the originals of write_blobs. Only
    originals of the asked documents are read, and only buckets that they fall in are written. A
    document that is ready again has its chunks, postings and vectors replaced; one that turns out to be
    a copy of another ready document has none left and its tags go there; one that fails keeps what it
    had and stays searchable. Ids of chunks follow from their content, so the same job gives the same
    rows.

    Vectors are written first, then chunks and postings, then tags and names, and documents last. A run that is cut
    off between two tables leaves the documents as they were, and the next one writes the same rows
    again. done is told the name of each table after it is written.

    Ids that no document has: no row. Repeated and null ids: once, never. A document whose original is
    missing or empty fails. Empty ids: nothing is read or written.
    """
    table = lambda name: f"{store}/{name}"
    with discarded(spark):
        asked = staged(ids.select("document_id").filter("document_id is not null").distinct(), "asked")
        rows = spark.read.parquet(table("documents")).drop("of", "bucket")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        then = staged(S.lookup(spark, table("documents"), asked, schema), "then")
        found = then.select("document_id", "filename", "content_type", "byte_size", "file_hash", "storage_path", "created_at").join(originals(spark, blobs, then), "file_hash", "left")
        found = found.withColumn("kind", S.parser_kind(F.col("filename"), F.col("content_type")))
        there = F.octet_length("content") > 0
        lost = F.coalesce(~there, F.lit(True))
        found = staged(found, "originals")
        docs = staged(as_documents(found.filter(~lost).withColumn("kind", F.coalesce("kind", F.lit("unknown")))), "documents")
        others = rows.select(KNOWN).join(asked, "document_id", "left_anti")
        now, chunks, _ = process(docs, Stored.of(others), parsers=parsers, target=target, overlap=overlap, least=least)
        gone = found.filter(lost).select("document_id", F.lit("failed").alias("status"), F.lit(MISSING).alias("error"), F.lit(0).alias("chunk_count"))
        now = now.withColumn("updated_at", F.current_timestamp()).unionByName(gone.withColumn("updated_at", F.current_timestamp()), allowMissingColumns=True)
        new = staged(_as_before(then, now), "now")
        touched = staged(new.filter("status <> 'failed'").select("document_id"), "touched")

        if embedder is not None:
            _put(spark, table("vectors"), staged(with_vectors(chunks, embedder), "vectors"), touched)
            done("vectors")
        _put(spark, table("chunks"), chunks, touched)
        done("chunks")
        _put(spark, table("postings"), staged(R.postings(chunks, stemmed), "postings"), touched)
        done("postings")
        _move_tags(spark, table("document_tags"), new)
        done("document_tags")
        _rename(spark, table("name_grams"), then, new)
        done("name_grams")
        S.rewrite_touched(spark, table("documents"), new, lambda old, changed: S.replace_chunks(old, new.select(old.columns), changed))
        done("documents")
        path = new_path(spark, "reprocessed")
        before = then.select("document_id", F.col("status").alias("was"))
        new.select("document_id", "status", "error").join(before, "document_id").select("document_id", "was", "status", "error").write.parquet(f"{path}.result")
    return spark.read.parquet(f"{path}.result")


def _rename(spark: SparkSession, path: str, then: DataFrame, new: DataFrame) -> None:
    """The grams of the documents' names as they are now in place of those that they were."""
    if S.bucket_number(spark, path) is None:
        return
    pairs = [staged(K.name_grams(df), "grams") for df in (then, new)]
    gone, come = pairs[0].join(pairs[1], ["gram", "document_id"], "left_anti"), pairs[1].join(pairs[0], ["gram", "document_id"], "left_anti")
    S.rewrite_touched(spark, path, gone.unionByName(come), lambda old, _: old.join(gone, ["gram", "document_id"], "left_anti").unionByName(come).distinct(), key="gram")


def _move_tags(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Tags of documents that are duplicates now go to what stands for them, and stay where they are too."""
    twins = staged(new.filter("status = 'duplicate'").select("document_id", "duplicate_of_id"), "twins")
    n = S.bucket_number(spark, path)
    if n is None or twins.isEmpty():
        return
    own = S.lookup(spark, path, twins, "document_id string, tag string").join(twins, "document_id")
    moved = staged(own.select(F.col("duplicate_of_id").alias("document_id"), "tag").distinct(), "moved")
    S.rewrite_touched(spark, path, moved, lambda old, changed: old.unionByName(changed.select(old.columns)).distinct())
