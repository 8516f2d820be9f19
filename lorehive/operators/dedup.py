"""Fingerprint dedup of uploads and documents, and the life of documents and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_uploads(uploads: DataFrame, order: tuple[str, ...] = ("uploaded_at", "upload_id")) -> DataFrame:
    """file_hash, keeper (upload id of the first upload), n_uploads. Combines before the shuffle."""
    return uploads.groupBy("file_hash").agg(F.min(F.struct(*order)).alias("x"), F.count("*").alias("n_uploads")).select("file_hash", F.col(f"x.{order[-1]}").alias("keeper"), "n_uploads")


def tags_added(uploads: DataFrame) -> DataFrame:
    """upload_id, tags_added: an upload's tags that no earlier upload of the same file had.

    Each tag of a file is added by the first upload that has it, so no upload needs to see the list
    of all earlier tags.
    """
    tagged = uploads.select("file_hash", "uploaded_at", "upload_id", F.explode("tags").alias("tag"))
    first = tagged.groupBy("file_hash", "tag").agg(F.min(F.struct("uploaded_at", "upload_id"))["upload_id"].alias("upload_id"))
    added = first.groupBy("upload_id").agg(F.array_sort(F.collect_list("tag")).alias("tags_added"))
    return uploads.select("upload_id").join(added, "upload_id", "left").select("upload_id", F.coalesce("tags_added", F.array().cast("array<string>")).alias("tags_added"))


def document_tags(uploads: DataFrame) -> DataFrame:
    """file_hash, tag: the union of all its uploads' tags."""
    return uploads.select("file_hash", F.explode("tags").alias("tag")).distinct()


# What an uploader is told.
ACCEPTED = "Document accepted and queued for processing."
SAME_FILE = "This file is already in the knowledge base"
SAME_CONTENT = "A document with identical content is already in the knowledge base"


def upload_verdicts(uploads: DataFrame, twins: DataFrame | None = None) -> DataFrame:
    """upload_id, keeper, duplicate, tags_added, message for each upload of a batch.

    twins(file_hash, twin_hash) names, for files whose document is a duplicate by content, the file of
    the document that stands for it: such an upload is a duplicate too, of that file's first upload, and
    its tags are added there.
    """
    rows = uploads.withColumn("own", F.col("file_hash"))
    if twins is not None:
        rows = rows.join(twins.select("file_hash", "twin_hash"), "file_hash", "left").withColumn("file_hash", F.coalesce("twin_hash", "own"))
    own = rows.groupBy("own").agg(F.min(F.struct("uploaded_at", "upload_id"))["upload_id"].alias("first_of_file"))
    out = rows.select("upload_id", "file_hash", "own").join(first_uploads(rows), "file_hash").join(own, "own").join(tags_added(rows), "upload_id")
    again = F.col("upload_id") != F.col("keeper")
    base = F.when((F.col("own") == F.col("file_hash")) | (F.col("upload_id") != F.col("first_of_file")), SAME_FILE).otherwise(SAME_CONTENT)
    added = F.when(F.size("tags_added") > 0, F.concat(base, F.lit("; added new tag(s): "), F.concat_ws(", ", "tags_added"), F.lit("."))).otherwise(F.concat(base, F.lit("; no changes made.")))
    return out.select("upload_id", "keeper", again.alias("duplicate"), "tags_added", F.when(again, added).otherwise(ACCEPTED).alias("message"))


def verdicts_against(uploads: DataFrame, targets: DataFrame, links: DataFrame) -> DataFrame:
    """upload_id, document_id, duplicate, tags_added, message for each upload of a batch, where documents of
    earlier batches are stored.

    targets(file_hash, own_id, document_id, file_stored, document_stored) names each file's own document,
    the one that stands for it, and which of them are stored already; links(document_id, tag) has the
    stored tags of these documents. A tag is added by the first upload, over stored and new ones, that
    has it: stored tags are taken off by an anti-join, and of the rest each goes to its first upload,
    so no upload sees a list of tags of others.
    """
    order = F.struct("uploaded_at", "upload_id")
    rows = uploads.select("upload_id", "uploaded_at", "file_hash", "tags").join(targets, "file_hash")
    of_file = rows.groupBy("file_hash").agg(F.min(order)["upload_id"].alias("first_of_file"))
    of_document = rows.groupBy("document_id").agg(F.min(order)["upload_id"].alias("first_of_document"))
    new = rows.select("document_id", "uploaded_at", "upload_id", F.explode("tags").alias("tag")).join(links.select("document_id", "tag").distinct(), ["document_id", "tag"], "left_anti")
    first = new.groupBy("document_id", "tag").agg(F.min(order)["upload_id"].alias("upload_id"))
    added = first.groupBy("upload_id").agg(F.array_sort(F.collect_list("tag")).alias("tags_added"))
    out = rows.join(of_file, "file_hash").join(of_document, "document_id").join(added, "upload_id", "left").withColumn("tags_added", F.coalesce("tags_added", F.array().cast("array<string>")))
    again = F.col("document_stored") | (F.col("upload_id") != F.col("first_of_document"))
    same_file = F.col("file_stored") | (F.col("upload_id") != F.col("first_of_file")) | (F.col("own_id") == F.col("document_id"))
    base = F.when(same_file, SAME_FILE).otherwise(SAME_CONTENT)
    said = F.when(F.size("tags_added") > 0, F.concat(base, F.lit("; added new tag(s): "), F.concat_ws(", ", "tags_added"), F.lit("."))).otherwise(F.concat(base, F.lit("; no changes made.")))
    return out.select("upload_id", "document_id", again.alias("duplicate"), "tags_added", F.when(again, said).otherwise(ACCEPTED).alias("message"))


def unseen(batch: DataFrame, stored: DataFrame, key: str = "file_hash") -> DataFrame:
    return batch.join(stored.select(key).distinct(), key, "left_anti")


def fold_content(documents: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """documents(document_id, content_hash, created_at, status, ...) with duplicate_of_id and status:
    those that the oldest ready document of the same content stands for are duplicates.

    If the oldest is not ready, nothing is folded into it. A ready document of the same content in
    stored comes before all in documents.
    """
    oldest = documents.filter("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct("created_at", "document_id", "status")).alias("o"))
    if stored is not None:
        keepers = stored.filter("content_hash is not null and status = 'ready'").groupBy("content_hash").agg(F.min(F.struct("created_at", "document_id", "status")).alias("k"))
        oldest = oldest.join(keepers, "content_hash", "left").select("content_hash", F.coalesce("k", "o").alias("o"))
    out = documents.join(oldest, "content_hash", "left")
    folds = F.coalesce((F.col("o.document_id") != F.col("document_id")) & (F.col("o.status") == "ready") & (F.col("status") == "ready"), F.lit(False))
    return out.withColumn("duplicate_of_id", F.when(folds, F.col("o.document_id"))).withColumn("status", F.when(folds, "duplicate").otherwise(F.col("status"))).drop("o")


def twin_tags(folded: DataFrame, links: DataFrame) -> DataFrame:
    """document_id, tag: tags of duplicates go to the document that stands for them."""
    to = folded.select("document_id", F.coalesce("duplicate_of_id", "document_id").alias("twin"))
    return links.join(to, "document_id").select(F.col("twin").alias("document_id"), "tag").distinct()


def set_tags(links: DataFrame, changes: DataFrame) -> DataFrame:
    """document_tags with the tags of the changed documents (document_id, tags) set outright."""
    return links.join(changes.select("document_id").distinct(), "document_id", "left_anti").unionByName(changes.select("document_id", F.explode(F.array_distinct("tags")).alias("tag")))


def payload_tags(vectors: DataFrame, links: DataFrame, changed: DataFrame) -> DataFrame:
    """vectors with a tags column, where tags are kept beside them: those of the changed documents
    (document_id) as links has them now, all others as they are."""
    ids = changed.select("document_id").distinct()
    now = links.join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.array_sort(F.collect_set("tag")).alias("now"))
    now = ids.join(now, "document_id", "left").select("document_id", F.coalesce("now", F.array().cast("array<string>")).alias("now"))
    return vectors.join(now, "document_id", "left").withColumn("tags", F.coalesce("now", "tags")).select(vectors.columns)


def orphan_tags(tags: DataFrame, links: DataFrame) -> DataFrame:
    return tags.join(links.select("tag").distinct(), "tag", "left_anti")


def delete_documents(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, links: DataFrame, gone: DataFrame, tags: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables without the documents in gone; documents that were copies of one point nowhere.
    tags, if given, without those that no document has any more."""
    ids = gone.select("document_id").distinct()
    left = documents.join(ids, "document_id", "left_anti")
    lost = ids.select(F.col("document_id").alias("duplicate_of_id"), F.lit(True).alias("lost"))
    left = left.join(lost, "duplicate_of_id", "left").withColumn("duplicate_of_id", F.when(F.col("lost").isNull(), F.col("duplicate_of_id"))).drop("lost")
    rest = {name: df.join(ids, "document_id", "left_anti") for name, df in (("chunks", chunks), ("vectors", vectors), ("document_tags", links))}
    if tags is not None:
        rest["tags"] = tags.join(orphan_tags(tags, rest["document_tags"]), "tag", "left_anti")
    return {"documents": left.select(documents.columns), **rest}


def mark_failed(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """Documents in errors(document_id, kind, message) fail, with the error cut to 2000 characters."""
    found = errors.select("document_id", F.substring(F.concat_ws(": ", "kind", "message"), 1, 2000).alias("failure"))
    out = documents.join(found, "document_id", "left")
    bad = F.col("failure").isNotNull()
    out = out.withColumn("status", F.when(bad, "failed").otherwise(F.col("status"))).withColumn("error", F.when(bad, F.col("failure")).otherwise(F.col("error")))
    return out.withColumn("chunk_count", F.when(bad, 0).otherwise(F.col("chunk_count"))).select(documents.columns)


def vector_counts(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """document_id, chunk_count, vector_count where the two differ."""
    n = vectors.groupBy("document_id").agg(F.count("*").alias("vector_count"))
    both = documents.select("document_id", F.col("chunk_count").cast("long")).join(n, "document_id", "full_outer")
    return both.select("document_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("vector_count", F.lit(0)).alias("vector_count")).filter("chunk_count <> vector_count")


def stale_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def corpus_counts(**tables: DataFrame) -> DataFrame:
    """name, rows: a row per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def latest_status(changes: DataFrame) -> DataFrame:
    """changes(document_id, seq, status) to the last status of each document."""
    return changes.groupBy("document_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


