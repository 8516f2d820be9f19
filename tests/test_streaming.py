import datetime as dt
import json


from lorehive.plans import ingest as ingest_plan
from lorehive.plans.ingest import ingest
from lorehive.queries.base import uploads
from lorehive.queries.stream_queries import str1_stream_ingest
from lorehive.streaming import jobs

UPLOADS = "upload_id long, uploaded_at timestamp, filename string, content_type string, content binary, tags array<string>"


def feed(spark, tmp_path, batches, schema=UPLOADS):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def up(k, text, *tags):
    return (k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), f"f{k}.txt", "text/plain", text.encode(), list(tags))


def test_upload_dedup_over_batches(spark, tmp_path):
    stream = feed(spark, tmp_path, [[up(0, "x", "a"), up(1, "y", "b")], [up(2, "x", "c"), up(3, "z")]])
    jobs.stream_uploads(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/uploads")).count() == 3
    assert {r["tag"] for r in spark.read.parquet(str(tmp_path / "out/upload_tags")).collect()} == {"a", "b", "c"}


def test_stream_ingest_equals_batch(spark, tmp_path):
    rows = [up(k, f"Text number {k} says something about topic {k}. " * 10, "t") for k in range(4)]
    stream = feed(spark, tmp_path, [rows[:2], rows[2:], rows[:1]])
    jobs.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = ingest(spark.createDataFrame(rows, UPLOADS))["chunks"].select("chunk_id", "text")
    got = spark.read.parquet(str(tmp_path / "out/chunks")).select("chunk_id", "text")
    assert got.exceptAll(batch).count() == 0 == batch.exceptAll(got).count()


def test_stream_ingest_sees_stored_documents(spark, tmp_path):
    """Re-uploads with new tags and content twins, also of stored duplicates, over batches."""
    text = [f"Text number {k} says something about topic {k}. " * 10 for k in range(4)]
    again, twin = text[0], text[1].upper() + "  \n"
    batches = [[up(0, text[0], "a"), up(1, text[1], "b")], [up(2, again, "c"), up(3, twin, "d"), up(4, text[2], "e"), up(5, again, "a")], [up(6, twin, "f"), up(7, text[1] + "\n", "g"), up(8, text[3], "h"), up(9, text[3] + " ", "i")]]
    stream = feed(spark, tmp_path, batches)
    jobs.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = ingest(spark.createDataFrame([r for b in batches for r in b], UPLOADS))
    for name, columns in {"documents": ["document_id", "status", "duplicate_of_id", "content_hash", "chunk_count"], "chunks": ["chunk_id", "text"], "document_tags": ["document_id", "tag"], "postings": batch["postings"].columns}.items():
        want, got = batch[name].select(columns), spark.read.parquet(str(tmp_path / "out" / name)).select(columns)
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count(), name
    assert batch["documents"].filter("status = 'duplicate'").count() == 3


def test_status_life_cycle(spark, tmp_path):
    schema = "document_id string, seq int, status string"
    stream = feed(spark, tmp_path, [[("a", 1, "pending"), ("b", 1, "pending")], [("a", 2, "processing"), ("a", 3, "ready")]], schema)
    q = jobs.stream_status(stream).writeStream.format("memory").queryName("status").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["document_id"]: r["status"] for r in spark.sql("select * from status").collect()} == {"a": "ready", "b": "pending"}


def test_turns_are_emitted_when_done(spark, tmp_path):
    event = lambda seq, kind, **x: (1, 1, seq, kind, json.dumps(x))
    schema = "conv_id long, turn int, seq int, type string, payload string"
    stream = feed(spark, tmp_path, [[event(0, "text", text="he"), (2, 1, 0, "text", "{}")], [event(2, "done"), event(1, "text", text="y")]], schema)
    q = jobs.stream_turns(stream).writeStream.format("memory").queryName("turns").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from turns").collect()] == [(1, 1, "hey", None)]


def test_turns_without_an_end_expire(spark, tmp_path):
    """Late and lost ends: everything is emitted once, and no state is left."""
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k)
    event = lambda conv, seq, kind, k, **x: (conv, 1, seq, kind, json.dumps(x), at(k))
    schema = "conv_id long, turn int, seq int, type string, payload string, at timestamp"
    batches = [
        [event(1, 0, "text", 0, text="lost end"), event(2, 0, "text", 0, text="late"), event(3, 0, "text", 1, text="ended"), event(3, 1, "done", 1)],
        # 2 is kept open by what it says; what 3 says after its end is left out
        [event(2, 1, "text", 50, text=" end"), event(3, 2, "text", 50, text=" again"), event(4, 0, "text", 60, text="x")],
        [event(2, 2, "done", 95), event(5, 0, "done", 100)],
        # too late for 1, whose turn has expired; then all are far behind
        [event(1, 1, "done", 2), event(6, 0, "error", 100_000, message="boom")],
        [event(7, 0, "done", 200_000)],
        [event(8, 0, "done", 300_000)],
    ]
    stream = feed(spark, tmp_path, batches, schema)
    q = jobs.stream_turns(stream, time_col="at", lateness="10 seconds", expire_seconds=60).writeStream.format("memory").queryName("expiring").outputMode("append").start()
    q.processAllAvailable()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    got = sorted(map(tuple, spark.sql("select * from expiring").collect()))
    assert got == [(1, 1, "lost end", "expired"), (2, 1, "late end", None), (3, 1, "ended", None), (4, 1, "x", "expired"), (5, 1, "", None), (6, 1, "", "boom"), (7, 1, "", None), (8, 1, "", None)]
    # what is left is the last turn, whose time has not come: its end, its time and its timer
    assert max(rows) > rows[-1] and rows[-1] <= 4, rows


def test_stream_ingest_writes_texts_once(spark, tmp_path, monkeypatch):
    """Documents and chunks are written where they stay, and uploads' bytes are staged by the batch alone."""
    names = []
    for module in (jobs, ingest_plan):
        monkeypatch.setattr(module, "staged", lambda df, name, *a, f=module.staged: names.append(name) or f(df, name, *a))
    rows = [up(0, "Some text. " * 30, "a"), up(1, "Other text. " * 30), up(2, "Some text. " * 30, "b")]
    jobs.stream_ingest(feed(spark, tmp_path, [rows[:1], rows[1:]]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert names.count("batch") == names.count("blocks") == 2 and not {"documents", "chunks", "processed"} & set(names), names
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 2
    assert {(r["document_id"], r["tag"]) for r in spark.read.parquet(str(tmp_path / "out/document_tags")).collect()} == {(r["document_id"], t) for r in spark.read.parquet(str(tmp_path / "out/documents")).filter("filename = 'f0.txt'").collect() for t in "ab"}


def test_stream_queries_read_what_is_there(spark, tmp_path):
    """A table that is written anew at its path gives its own rows, not those of an earlier run."""
    for text in ("first", "second"):
        said = [(k, f"A {text} text of number {k}. " * 20, "en", "s") for k in range(4)]
        spark.createDataFrame(said, "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        want = ingest(uploads(spark, str(tmp_path)).drop("file_hash"))["chunks"].select("chunk_id")
        assert {r[0] for r in str1_stream_ingest(spark, str(tmp_path)).select("chunk_id").collect()} == {r[0] for r in want.collect()}
