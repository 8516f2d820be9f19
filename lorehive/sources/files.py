"""Reading corpora, admitting uploads, and writing tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from lorehive.functions import text as X
from lorehive.stage import discarded, exists, names_in, remove, rename, staged

#: Rows of a table in one bucket, about: the number of buckets follows the table.
BUCKET_ROWS = 1_000_000
#: Tasks that share a bucket of grams: some are in almost all names.
GRAM_SPREAD = 16
MAX_BYTES = 25 * 1024 * 1024
#: Files of a folder that write_files() makes: folders are listed side by side.
FOLDER_FILES = 1000
#: Bytes of files that a task hands on at once, about.
READ_BYTES = 8 * 1024 * 1024
# Parser by extension, and by content type.
BY_EXTENSION = {"pdf": "pdf", "txt": "text", "md": "text", "markdown": "text"}
BY_TYPE = {"application/pdf": "pdf", "text/plain": "text", "text/markdown": "text", "text/x-markdown": "text"}


def read_corpus(spark: SparkSession, path: str, tags: DataFrame | None = None) -> DataFrame:
    """uploads from a folder's .md, .txt and .pdf files; tags(filename, tags) are joined by name,
    uncategorised otherwise. All are uploaded now, in the order of their paths, which are their ids:
    of equal files the first by name is kept."""
    files = _files_below(spark, path)
    files = files.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    if tags is not None:
        files = files.join(tags, "filename", "left")
    else:
        files = files.withColumn("tags", F.lit(None).cast("array<string>"))
    return files.select(
        F.col("path").alias("upload_id"), F.current_timestamp().alias("uploaded_at"), "filename", F.lit(None).cast("string").alias("content_type"),
        "content", F.coalesce("tags", F.array(F.lit("uncategorised"))).alias("tags"),
    )


def _files_below(spark: SparkSession, path: str) -> DataFrame:
    """path, content of a folder's .md, .txt and .pdf files, hidden and empty ones left out as Spark's reader does.

    In a folder that all machines mount (file: or no scheme) tasks list and read the folders themselves: Spark's reader
    keeps an entry for each file on the driver and takes some 30 small files a task. Other stores, patterns and
    single files go by that reader.
    """
    at = urlparse(path)
    top = unquote(at.path) if at.scheme else path
    if at.scheme not in ("", "file") or re.search(r"[*?\[\]{}\\]", path) or not os.path.isdir(top):
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,txt,pdf}").option("recursiveFileLookup", "true").load(path).select("path", "content")
    wanted = lambda names: sorted(n for n in names if n.endswith((".md", ".txt", ".pdf")) and not _hidden(n))
    found: list[tuple[str, list[str] | None]] = []
    for folder, folders, names in os.walk(os.path.abspath(top), onerror=_raised, followlinks=True):
        folders[:] = sorted(f for f in folders if not _hidden(f))
        names = wanted(names)
        if len(names) > FOLDER_FILES:  # too many for one task
            found += [(folder, names[k : k + FOLDER_FILES]) for k in range(0, len(names), FOLDER_FILES)]
        elif names:
            found.append((folder, None))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                paths, contents, size = [], [], 0
                for name in names if names is not None else wanted(e.name for e in os.scandir(folder) if e.is_file()):
                    with open(f"{folder}/{name}", "rb") as f:
                        content = f.read()
                    if not content:
                        continue
                    contents.append(content)
                    paths.append(f"file:{folder}/{name}")
                    size += len(contents[-1])
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_pydict({"path": paths, "content": contents}, schema)
                        paths, contents, size = [], [], 0
                yield pa.RecordBatch.from_pydict({"path": paths, "content": contents}, schema)

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    context = spark.sparkContext
    tasks = max(1, min(len(found), max(4 * context.defaultParallelism, len(found) // 8)))
    return spark.createDataFrame(context.parallelize(found, tasks), "folder string, names array<string>").mapInArrow(get, "path string, content binary")


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _raised(error: OSError) -> None:
    raise error


def write_files(texts: DataFrame, path: str) -> None:
    """A file for each row of a column text, which ends in a line end, in folders of FOLDER_FILES files.

    In a folder that all machines mount (file: or no scheme) tasks write the files themselves, under names that
    a task that is run again gives again: Spark's writer starts two processes for each file there, to set its
    permissions, and its driver moves each file once more. In other stores that writer is used.
    """
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        texts.select("text").write.option("maxRecordsPerFile", 1).text(path)
        return
    top = unquote(at.path) if at.scheme else path

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        for batch in batches:
            for content in batch.column(0):
                folder = f"{top}/{task.partitionId():05}-{n // FOLDER_FILES:05}"
                if n % FOLDER_FILES == 0:
                    os.makedirs(folder, exist_ok=True)
                aside = f"{folder}/_{n:08}.{task.taskAttemptId()}"
                with open(aside, "wb") as f:
                    f.write((content.as_py() or b"") + b"\n")
                os.replace(aside, f"{folder}/{n:08}.txt")
                n += 1
        yield pa.RecordBatch.from_pydict({"files": [n]}, pa.schema([("files", pa.int64())]))

    os.makedirs(top)
    texts.select(F.col("text").cast("binary")).mapInArrow(put, "files long").write.format("noop").mode("overwrite").save()


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def parser_kind(filename: Column, content_type: Column) -> Column:
    """pdf or text: by extension, else by content type without its parameters; else null."""
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]*)\z", 1))
    plain = F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"^([^;]*)", 1)))
    return F.coalesce(_lookup(extension, BY_EXTENSION), _lookup(plain, BY_TYPE))


def admit(uploads: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """uploads with kind and reason: empty, too_large, unsupported, or null for accepted ones."""
    size = F.octet_length("content")
    out = uploads.withColumn("kind", parser_kind(F.col("filename"), F.col("content_type")))
    return out.withColumn("reason", F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > max_bytes, "too_large").when(F.col("kind").isNull(), "unsupported"))


def storage_path(file_hash: Column, filename: Column) -> Column:
    """Where an original is stored: its hash, and the ending of its name."""
    return F.concat(file_hash, F.lower(F.regexp_extract(filename, r"(\.[^.]*)\z", 1)))


def new_blobs(uploads: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One original per file hash (of its first upload), without those that are stored already."""
    # dealt out once, by the prefix that they are written by: each folder's originals are in one task
    dealt = uploads.withColumn("prefix", F.substring("file_hash", 1, 2)).repartition("prefix")
    first = dealt.groupBy("prefix", "file_hash").agg(F.min_by(F.struct("filename", "content"), F.struct("uploaded_at", "upload_id")).alias("x"))
    blobs = first.select("file_hash", storage_path(F.col("file_hash"), F.col("x.filename")).alias("storage_path"), F.col("x.content").alias("content"))
    return blobs if stored is None else blobs.join(stored.select("file_hash"), "file_hash", "left_anti")


def write_blobs(blobs: DataFrame, path: str) -> None:
    """In folders by the first two digits of the hash: as many files as folders, as new_blobs() deals them out."""
    blobs.withColumn("prefix", F.substring("file_hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors by chunk id: new ones replace old ones. Of repeats in new, the highest index stays."""
    once = new.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "chunk_id"]), "chunk_index").alias("x")).select("chunk_id", "x.*")
    return old.join(once.select("chunk_id"), "chunk_id", "left_anti").unionByName(once.select(old.columns))


def replace_chunks(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Chunks with all those of the touched documents replaced by new ones (which may be none)."""
    return old.join(touched.select("document_id").distinct(), "document_id", "left_anti").unionByName(new.select(old.columns))


def bucket_count(rows: int, bucket_rows: int | None = None) -> int:
    """The power of two of buckets of bucket_rows rows at most, about."""
    return 1 << (max(1, -(-rows // (bucket_rows or BUCKET_ROWS))) - 1).bit_length()


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, buckets: int | None = None, key: str = "document_id", spread: int = 1) -> None:
    """Writes df in folders by hash of its key (their number, if not given, follows df's rows), in
    place of those that occur in it. Tables are read back with spark.read.parquet(path); the columns of
    and bucket say how many buckets there are, and which one a row is in. Where a key may have many rows,
    spread is how many tasks, and files, share a bucket."""
    if buckets is None:  # worked out once, for its rows are counted first
        with discarded(df.sparkSession):
            df = staged(df, "rows")
            return write_bucketed(df, path, bucket_count(df.count()), key, spread)
    _in_buckets(df, buckets, key, spread).option("partitionOverwriteMode", "dynamic").parquet(path)


def _in_buckets(df: DataFrame, n: int, key: str, spread: int = 1) -> DataFrameWriter:
    out = df.withColumn("of", F.lit(n)).withColumn("bucket", _bucket(key, n))
    deal = ["bucket"] if spread == 1 else ["bucket", F.pmod(F.xxhash64(*df.columns), F.lit(spread))]
    return out.repartition(*deal).write.mode("overwrite").partitionBy("of", "bucket")


def bucket_number(spark: SparkSession, path: str) -> int | None:
    """How many buckets a stored table has; None if there is no table."""
    found = [name for name in names_in(spark, path) if name.startswith("of=")]
    return max((int(name[3:]) for name in found), default=None)


def buckets_of(keys: DataFrame, n: int, key: str) -> list[int]:
    """Of n buckets, those that keys fall in: that many numbers at most come to the driver."""
    return sorted(r[0] for r in keys.filter(F.col(key).isNotNull()).select(_bucket(key, n)).distinct().collect())


def lookup(spark: SparkSession, path: str, keys: DataFrame, schema: str, key: str = "document_id") -> DataFrame:
    """Stored rows whose key is one of keys: no other buckets are read than those that keys fall in. No
    table: no rows."""
    n = bucket_number(spark, path)
    if n is None:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, of int, bucket int").parquet(path).filter((F.col("of") == n) & F.col("bucket").isin(buckets_of(keys, n, key)))
    return stored.drop("of", "bucket").join(keys.select(key).distinct(), key, "left_semi")


def stored_grams(spark: SparkSession, path: str):
    """The lookup of a stored index of names, for catalog.resolve()."""
    return lambda grams: lookup(spark, path, grams, "gram string, document_id string", "gram")


def _settle(spark: SparkSession, path: str, key: str) -> None:
    """Puts the buckets of path.next, if they are complete, in place of the stored ones: folder by folder, so
    that they are written once. While path.hit is there, path.next has all of its buckets yet."""
    if exists(spark, f"{path}.next/_SUCCESS"):
        at = [f"{of}/{bucket}" for of in names_in(spark, f"{path}.next") if of.startswith("of=") for bucket in names_in(spark, f"{path}.next/{of}")]
        if exists(spark, f"{path}.hit/_SUCCESS"):
            for r in spark.read.parquet(f"{path}.hit").collect():  # buckets at most
                if f"of={r['of']}/bucket={r['bucket']}" not in at:  # nothing is left in it
                    remove(spark, f"{path}/of={r['of']}/bucket={r['bucket']}")
            remove(spark, f"{path}.hit")
        for folder in at:
            remove(spark, f"{path}/{folder}")
            rename(spark, f"{path}.next/{folder}", f"{path}/{folder}")
    for part in (".next", ".hit"):
        remove(spark, path + part)


def rewrite_touched(spark: SparkSession, path: str, changed: DataFrame, merge, buckets: int | None = None, key: str = "document_id", bucket_rows: int | None = None) -> None:
    """Applies merge(old, changed) to the stored buckets that changed's keys fall in, and to no other.

    The new buckets are written aside first, and then put in place. Where a run is cut off between the
    two, the next one puts them in place before anything else; merges by key may be repeated. A table
    whose touched buckets have grown to four times bucket_rows (BUCKET_ROWS) is dealt out anew.
    """
    _settle(spark, path, key)
    n = buckets or bucket_number(spark, path)
    at = changed.select(_bucket(key, n).alias("bucket")).distinct().withColumn("of", F.lit(n))
    at.coalesce(1).write.mode("overwrite").parquet(f"{path}.hit")
    hit = [r["bucket"] for r in spark.read.parquet(f"{path}.hit").collect()]
    if not hit:
        return
    stored = spark.read.parquet(path).filter(F.col("of") == n)
    # not by write_bucketed(): a dynamic overwrite leaves no _SUCCESS
    _in_buckets(merge(stored.filter(F.col("bucket").isin(hit)).drop("of", "bucket"), changed), n, key).option("partitionOverwriteMode", "static").parquet(f"{path}.next")
    some = bucket_number(spark, f"{path}.next") is not None
    rows = spark.read.parquet(f"{path}.next").count() * n // len(hit) if some else 0  # of the table, about
    _settle(spark, path, key)
    if buckets is None:
        _deal_anew(spark, path, rows, n, key, bucket_rows)


def _deal_anew(spark: SparkSession, path: str, rows: int, n: int, key: str, bucket_rows: int | None) -> None:
    if rows > 4 * (bucket_rows or BUCKET_ROWS) * n:
        write_bucketed(spark.read.parquet(path).drop("of", "bucket"), path, bucket_count(rows, bucket_rows), key)
        remove(spark, f"{path}/of={n}")


def add_unseen(spark: SparkSession, path: str, new: DataFrame, changed: DataFrame, key: str = "document_id", bucket_rows: int | None = None) -> bool:
    """Adds new, the rows of changed's keys, to the stored buckets as files of their own, and so rewrites none of what
    is there; False, and nothing is added, if any of these keys has stored rows. What a run that is cut off has added is
    seen by the next, which then has to replace it."""
    _settle(spark, path, key)
    n, keys = bucket_number(spark, path), changed.select(key).distinct()
    hit = buckets_of(keys, n, key)
    if not hit:
        return True
    stored = spark.read.parquet(path).filter(F.col("of") == n)
    # distinct first: a key's rows are side by side, and few of them are left to be shuffled
    if not stored.filter(F.col("bucket").isin(hit)).select(key).distinct().join(keys, key, "left_semi").isEmpty():
        return False
    _in_buckets(new.select(stored.drop("of", "bucket").columns), n, key).mode("append").parquet(path)
    _deal_anew(spark, path, spark.read.parquet(path).filter(F.col("of") == n).count(), n, key, bucket_rows)
    return True


def write_catalogue(tables: dict[str, DataFrame], path: str) -> None:
    """documents, tags, document_tags and the like: those with a document id in buckets of it, the index of
    names in buckets of its grams."""
    for name, df in tables.items():
        if name == "name_grams":
            write_bucketed(df, f"{path}/{name}", key="gram", spread=GRAM_SPREAD)
        elif "document_id" in df.columns:
            write_bucketed(df, f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
