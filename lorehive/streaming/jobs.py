"""Continuous work: ingest, dedup over the stream's life, status life cycle, turn assembly."""

from __future__ import annotations

from collections.abc import Iterator

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lorehive.functions import text as X
from lorehive.operators import dedup as D
from lorehive.plans.ingest import WIDE, Stored, ingest
from lorehive.sources import files as S
from lorehive.stage import discarded, exists, names_in, remove, rename, staged

#: What later batches look up, in buckets by the key that comes first. Rows have the batch they came in: one
#: that is run again sees what was there before it, and puts the same rows in place of its own.
SEEN = {
    "documents": "document_id string, file_hash string, content_hash string, created_at timestamp, status string, duplicate_of_id string, filename string, batch long",
    "contents": "content_hash string, document_id string, file_hash string, created_at timestamp, status string, duplicate_of_id string, filename string, batch long",
    "document_tags": "document_id string, tag string, batch long",
    "tags": "tag string, batch long",
    "uploads": "file_hash string, batch long",
}
#: Rows of a bucket of these tables, about: what a batch reads is so many for each of its keys, at most.
SEEN_ROWS = 50_000
#: As many folders of batches are merged into one, and as many of these into the next larger one.
MERGED = 16


class Seen:
    """Keys of all batches before one, of which a batch reads the buckets that its own keys fall in."""

    def __init__(self, spark: SparkSession, out: str, epoch: int, rows: int = SEEN_ROWS):
        self.spark, self.out, self.epoch, self.rows = spark, out, epoch, rows

    def of(self, name: str, keys: DataFrame) -> DataFrame:
        key = SEEN[name].split()[0]
        return S.lookup(self.spark, f"{self.out}/seen/{name}", keys, SEEN[name], key).filter(F.col("batch") < self.epoch).drop("batch")

    def add(self, name: str, rows: DataFrame) -> None:
        """Adds rows, which are read more than once, from a stored table."""
        path, columns = f"{self.out}/seen/{name}", [c.split()[0] for c in SEEN[name].split(", ")]
        key, epoch = columns[0], self.epoch
        new = rows.filter(F.col(key).isNotNull()).withColumn("batch", F.lit(epoch).cast("long")).select(columns)
        if S.bucket_number(self.spark, path) is None:
            S.write_bucketed(new, path, S.bucket_count(new.count(), self.rows), key)
        else:
            S.rewrite_touched(self.spark, path, new, lambda old, more: old.filter(F.col("batch") < epoch).select(columns).unionByName(more), key=key, bucket_rows=self.rows)

    def stored(self) -> Stored:
        by_id = lambda files: self.of("documents", files.select(X.uuid5(F.col("file_hash")).alias("document_id")))
        return Stored(by_id, lambda contents: self.of("contents", contents), lambda ids: self.of("document_tags", ids))


def merge_folders(spark: SparkSession, path: str, epoch: int, n: int = MERGED) -> None:
    """Merges n folders of batches before epoch into that of the last of them, and so on by powers of n, so that
    the number of folders grows with the logarithm of the batches. Batches before epoch are complete and
    are not run again. A merge that was cut off is ended by the next call."""
    for name in names_in(spark, path):
        if name.startswith("_merged-"):
            if exists(spark, f"{path}/{name}/_SUCCESS"):
                _put_merged(spark, path, *(int(x) for x in name.split("-")[1:]))
            else:
                remove(spark, f"{path}/{name}")
    size = n
    while epoch and epoch % size == 0:
        first, last = epoch - size, epoch - 1
        there = [b for b in _batches(spark, path) if first <= b <= last]
        if len(there) > 1:
            some = [f"{path}/batch={b}" for b in there]
            rows = spark.read.parquet(*some)
            parts = max(1, rows.rdd.getNumPartitions() // n)
            rows.coalesce(parts).write.option("compression", WIDE).mode("overwrite").parquet(f"{path}/_merged-{first}-{last}")
            _put_merged(spark, path, first, last)
        size *= n


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(x[6:]) for x in names_in(spark, path) if x.startswith("batch="))


def _put_merged(spark: SparkSession, path: str, first: int, last: int) -> None:
    for b in _batches(spark, path):
        if first <= b <= last:
            remove(spark, f"{path}/batch={b}")
    rename(spark, f"{path}/_merged-{first}-{last}", f"{path}/batch={last}")


def _put(df: DataFrame, path: str, epoch: int) -> DataFrame:
    """A batch in a folder of its own: a batch that is run again writes the same place."""
    df.write.option("compression", WIDE).mode("overwrite").parquet(f"{path}/batch={epoch}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch={epoch}")


def stream_uploads(uploads: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Dedup of a stream of uploads by file hash, for good: the state is a stored table of hashes, so it
    needs no watermark, and a batch reads only the buckets its own hashes fall in. Writes the first
    uploads to out/uploads and tags to out/upload_tags."""

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        for name in ("uploads", "upload_tags"):
            merge_folders(spark, f"{out}/{name}", epoch)
        with discarded(spark):
            hashed = staged(batch.withColumn("file_hash", F.sha2("content", 256)), "batch")
            first = hashed.join(D.first_uploads(hashed).select(F.col("keeper").alias("upload_id")), "upload_id", "left_semi")
            seen = Seen(spark, out, epoch)
            new = _put(D.unseen(first, seen.of("uploads", first.select("file_hash"))), f"{out}/uploads", epoch)
            _put(D.document_tags(hashed), f"{out}/upload_tags", epoch)
            seen.add("uploads", new)

    return uploads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(uploads: DataFrame, out: str, checkpoint: str, *, seen_rows: int = SEEN_ROWS, **options: object) -> StreamingQuery:
    """The batch ingest job (with its options) on each batch of uploads, against the documents of all
    batches before; ids follow from content, so a batch that is run again gives the same rows.

    A batch looks its files, contents and tags up by key: it reads the buckets of out/seen that its own
    keys fall in, so much for each key, however many documents are stored. Folders of batches are
    merged as they become many. document_tags and tags have what a batch adds, also to stored documents;
    verdicts has each upload's. A ready document that is stored stays the keeper of its content, even
    if an older upload comes later.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = Seen(spark, out, epoch, seen_rows)
        placed = {}

        def place(df: DataFrame, name: str) -> DataFrame:
            """Each table is written once, where it stays."""
            merge_folders(spark, f"{out}/{name}", epoch)
            placed[name] = _put(df, f"{out}/{name}", epoch)
            return placed[name]

        with discarded(spark):
            tables = ingest(staged(batch, "batch", WIDE), stored=seen.stored(), place=place, **options)
            links = tables["document_tags"]
            tables["document_tags"] = links.join(seen.of("document_tags", links), ["document_id", "tag"], "left_anti")
            tables["tags"] = tables["tags"].join(seen.of("tags", tables["tags"]), "tag", "left_anti")
            for name, df in tables.items():
                tables[name] = placed[name] if name in placed else place(df, name)
            for name, of in (("documents", "documents"), ("contents", "documents"), ("document_tags", "document_tags"), ("tags", "tags")):
                seen.add(name, tables[of])

    return uploads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_status(changes: DataFrame) -> DataFrame:
    """The latest status per document of a stream of changes, to be written in update mode."""
    return D.latest_status(changes)


# Fixed value: the error of a turn whose end never came.
EXPIRED = "expired"


class TurnAssembler(StatefulProcessor):
    """Holds a turn's events until done or error comes, then emits the turn.

    With a column of milliseconds each turn has a timer, so long after its latest event. Until then a turn that
    has ended is remembered, and what comes after its end is left out; when it runs out, a turn without
    an end is emitted as it is, and nothing is left of either.
    """

    def __init__(self, time_col: str | None = None, expire_ms: int = 0):
        self.time_col, self.expire_ms = time_col, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "seq int, type string, payload string")
        self.ended = handle.getValueState("ended", "ended boolean")
        self.until = handle.getValueState("until", "at long")

    def _set_timer(self, latest: int) -> None:
        old = self.until.get()[0] if self.until.exists() else None
        at = max(latest + self.expire_ms, old or 0)
        if at != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.until.update((at,))

    @staticmethod
    def _turn(key, events: list[tuple], error: str | None = None) -> pd.DataFrame:
        text = "".join(json.loads(p).get("text") or "" for _, t, p in events if t == "text")
        errors = [json.loads(p).get("message") for _, t, p in events if t == "error"]
        return pd.DataFrame({"conv_id": [key[0]], "turn": [key[1]], "text": [text], "error": [errors[-1] if errors else error]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, latest = [], 0
        for batch in rows:
            new += batch[["seq", "type", "payload"]].itertuples(index=False, name=None)
            if self.time_col:
                times = batch[self.time_col].dropna()
                latest = max(latest, int(times.max()) if len(times) else timerValues.getCurrentWatermarkInMs())
        if self.time_col:
            self._set_timer(latest)
            if self.ended.exists():
                return
        events = sorted({(int(s), t, p) for s, t, p in [*self.events.get(), *new]})
        if not any(t in ("done", "error") for _, t, _ in events):
            self.events.put(events)
            return
        self.events.clear()
        if self.time_col:
            self.ended.update((True,))
        yield self._turn(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = sorted({(int(s), t, p) for s, t, p in self.events.get()})
        for state in (self.events, self.ended, self.until):
            state.clear()
        if events:
            yield self._turn(key, events, EXPIRED)

    def close(self) -> None:
        pass


def stream_turns(events: DataFrame, *, time_col: str | None = None, lateness: str = "10 minutes", expire_seconds: int = 3600) -> DataFrame:
    """conv_id, turn, text, error of each turn of a stream of events, once it has ended.

    With a time column the state is bounded: events that are later than lateness behind the latest one
    are left out, and a turn is closed expire_seconds after its own latest event: one whose end was
    lost is emitted with the error expired, one that has ended is forgotten. A stray event after that
    is a turn of its own, which expires likewise. Without a time column turns are held until they end,
    however long that takes.
    """
    out = "conv_id long, turn int, text string, error string"
    if time_col is None:
        return events.groupBy("conv_id", "turn").transformWithStateInPandas(TurnAssembler(), out, "append", "none")
    timed = events.withColumn("at_millis", F.unix_millis(time_col)).withWatermark(time_col, lateness)
    return timed.groupBy("conv_id", "turn").transformWithStateInPandas(TurnAssembler("at_millis", expire_seconds * 1000), out, "append", "EventTime")
