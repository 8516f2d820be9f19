"""Stored corpora: lookups by bucket, reprocessing, verdicts against what is stored, merged folders."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from lorehive.operators import catalog
from lorehive.operators.retrieval import Embedder
from lorehive.plans import search
from lorehive.plans.ingest import Stored, ingest
from lorehive.plans.reprocess import MISSING, originals, reprocess
from lorehive.sources import files as S
from lorehive.streaming import jobs

UPLOADS = "upload_id long, uploaded_at timestamp, filename string, content_type string, content binary, tags array<string>"


def of_length():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


MODEL = Embedder(of_length(), 2)


def up(k, text, *tags, kind="txt"):
    return (k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), f"f{k}.{kind}", None, text.encode(), list(tags))


def said(k):
    return f"Text number {k} says something about topic {k}. " * 10


def stored_corpus(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, UPLOADS)
    store, blobs = str(tmp_path / "store"), str(tmp_path / "blobs")
    S.write_blobs(S.new_blobs(df.withColumn("file_hash", F.sha2("content", 256))), blobs)
    tables = ingest(df, embedder=MODEL)
    S.write_catalogue({name: tables[name] for name in ("documents", "chunks", "postings", "document_tags", "vectors", "name_grams")}, store)
    return store, blobs


def table(spark, store, name):
    df = spark.read.parquet(f"{store}/{name}").drop("of", "bucket")
    return df.select(sorted(df.columns))


def content(spark, store):
    out = {name: sorted(map(str, table(spark, store, name).collect())) for name in ("chunks", "postings", "document_tags", "vectors", "name_grams")}
    return out | {"documents": sorted(map(str, table(spark, store, "documents").drop("updated_at").collect()))}


def page_parser():
    def pages(data, filename):
        if data.startswith(b"bad"):
            raise ValueError("unreadable")
        return [(p, 0, k + 1) for k, p in enumerate(data.decode().split("\n\n"))]

    return pages


def rows_of(spark, store, **where):
    return {r["filename"]: r for r in table(spark, store, "documents").collect()}


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = [up(0, said(0), "a"), up(1, said(1), "b", kind="pdf"), up(2, said(0).upper(), "c", kind="pdf"), up(3, "bad", kind="pdf"), up(4, said(4), "d")]
    return stored_corpus(spark, tmp_path_factory.mktemp("written"), rows)


@pytest.fixture
def corpus(written, tmp_path):
    return tuple(shutil.copytree(w, tmp_path / name) and str(tmp_path / name) for w, name in zip(written, ("store", "blobs")))


def test_failed_documents_become_ready(spark, corpus):
    store, blobs = corpus
    failed = table(spark, store, "documents").filter("status = 'failed'")
    assert failed.count() == 3
    result = {r["document_id"]: (r["was"], r["status"]) for r in reprocess(spark, store, blobs, failed.select("document_id"), parsers={"pdf": page_parser()}, embedder=MODEL).collect()}
    docs = rows_of(spark, store)
    assert {docs[f]["document_id"]: v for f, v in {"f1.pdf": ("failed", "ready"), "f2.pdf": ("failed", "duplicate"), "f3.pdf": ("failed", "failed")}.items()} == result
    assert docs["f2.pdf"]["duplicate_of_id"] == docs["f0.txt"]["document_id"] and docs["f2.pdf"]["chunk_count"] == 0
    assert docs["f3.pdf"]["error"] == "ValueError: unreadable" and docs["f1.pdf"]["error"] is None and docs["f1.pdf"]["page_count"] == 1
    assert docs["f1.pdf"]["created_at"] == dt.datetime(2024, 1, 2)
    chunks = {r["document_id"] for r in table(spark, store, "chunks").collect()}
    assert chunks == {docs[f]["document_id"] for f in ("f0.txt", "f1.pdf", "f4.txt")} == {r["document_id"] for r in table(spark, store, "vectors").collect()}
    tags = {r["tag"] for r in table(spark, store, "document_tags").filter(F.col("document_id") == docs["f0.txt"]["document_id"]).collect()}
    assert tags == {"a", "c"}


def test_the_same_job_gives_the_same_rows(spark, corpus):
    store, blobs = corpus
    before = content(spark, store)
    ids = table(spark, store, "documents").filter("status = 'ready'").select("document_id")
    reprocess(spark, store, blobs, ids.unionByName(ids).unionByName(spark.createDataFrame([("nobody",), (None,)], "document_id string")), embedder=MODEL)
    assert content(spark, store) == before


@pytest.mark.parametrize("after", ["chunks"])
def test_a_run_that_is_cut_off_is_repeated(spark, tmp_path, written, corpus, after):
    """Between any two tables: the documents are as they were, and the next run gives what one run would."""
    store, blobs = corpus
    ids = table(spark, store, "documents").select("document_id").collect()
    ids = spark.createDataFrame(ids, "document_id string")
    before = content(spark, store)["documents"]

    def stop(name):
        if name == after:
            raise InterruptedError(name)

    options = {"parsers": {"pdf": page_parser()}, "embedder": MODEL, "target": 40, "overlap": 5, "least": 10}
    with pytest.raises(InterruptedError):
        reprocess(spark, store, blobs, ids, done=stop, **options)
    assert content(spark, store)["documents"] == before
    whole = str(shutil.copytree(written[0], tmp_path / "whole"))
    for s in (store, whole):
        reprocess(spark, s, blobs, ids, **options)
    assert content(spark, store) == content(spark, whole)
    assert table(spark, store, "chunks").filter("token_count > 60").count() == 0


def test_what_fails_again_keeps_its_chunks(spark, corpus):
    store, _ = corpus
    docs = rows_of(spark, store)
    before = content(spark, store)["chunks"]
    nothing = spark.createDataFrame([], "file_hash string, storage_path string, content binary, prefix string")
    empty = store + "-no-blobs"
    nothing.write.parquet(empty)
    ids = spark.createDataFrame([(docs["f0.txt"]["document_id"],)], "document_id string")
    assert [tuple(r)[1:] for r in reprocess(spark, store, empty, ids, embedder=MODEL).collect()] == [("ready", "failed", MISSING)]
    now = rows_of(spark, store)["f0.txt"]
    assert (now["status"], now["error"], now["chunk_count"], now["title"]) == ("failed", MISSING, 0, docs["f0.txt"]["title"])
    assert content(spark, store)["chunks"] == before


def test_no_ids_nothing_to_do(spark, corpus):
    store, blobs = corpus
    before = content(spark, store)
    assert reprocess(spark, store, blobs, spark.createDataFrame([], "document_id string"), embedder=MODEL).count() == 0
    assert content(spark, store) == before


def test_originals_are_read_by_prefix(spark, corpus):
    store, blobs = corpus
    one = table(spark, store, "documents").limit(1).select("file_hash")
    found = originals(spark, blobs, one)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan or "prefix#" in plan.split("PartitionFilters")[1][:80]


def test_verdicts_against_stored_documents(spark):
    first = ingest(spark.createDataFrame([up(0, said(0), "a", "b"), up(1, said(1))], UPLOADS))
    again = [up(2, said(0), "B ", "new one"), up(3, said(0), "New  One", "x"), up(4, said(1).upper(), "y"), up(5, said(1).upper(), "y", "z"), up(6, said(6), "q"), up(7, said(6)), up(8, "", "t"), up(9, said(6) + " ", "q", "r")]
    out = ingest(spark.createDataFrame(again, UPLOADS), stored=Stored.of(first["documents"], first["document_tags"]))
    file, same = "This file is already in the knowledge base; ", "A document with identical content is already in the knowledge base; "
    assert {r["upload_id"]: (r["duplicate"], r["message"]) for r in out["verdicts"].collect()} == {
        2: (True, file + "added new tag(s): new-one."), 3: (True, file + "added new tag(s): x."), 4: (True, same + "added new tag(s): y."), 5: (True, file + "added new tag(s): z."),
        6: (False, "Document accepted and queued for processing."), 7: (True, file + "no changes made."), 9: (True, same + "added new tag(s): r."),
    }
    ids = {r["document_id"] for r in first["documents"].collect()}
    assert {r["document_id"] for r in out["verdicts"].filter("upload_id < 6").collect()} == ids


def test_lookups_stay_as_large_as_the_batch(spark, tmp_path):
    """Bytes of the buckets that a batch reads, while 50 batches are stored."""
    sizes = []
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    for epoch in range(50):
        seen = jobs.Seen(spark, str(tmp_path), epoch, rows=20)
        new = spark.range(epoch * 10, epoch * 10 + 10).select(F.concat(F.lit("tag"), "id").alias("tag")).coalesce(1)
        asked = new.unionByName(spark.createDataFrame([("tag3",)], "tag string"))
        if epoch in (1, 2, 20, 30, 40, 49):
            known = seen.of("tags", asked)
            assert [r["tag"] for r in known.collect()] == ["tag3"]
            n = S.bucket_number(spark, f"{tmp_path}/seen/tags")
            hit = S.buckets_of(spark.createDataFrame([("tag3",)], "tag string"), n, "tag")
            sizes.append(sum(f.stat().st_size for b in hit for f in (tmp_path / f"seen/tags/of={n}/bucket={b}").glob("*.parquet")))
        seen.add("tags", new)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert max(sizes) < 4 * min(sizes), sizes
    # a batch that is run again sees what was there before it
    assert jobs.Seen(spark, str(tmp_path), 3).of("tags", spark.createDataFrame([("tag29",), ("tag30",)], "tag string")).count() == 1


def test_folders_of_batches_are_merged(spark, tmp_path):
    path = str(tmp_path / "t")
    for epoch in range(20):
        jobs.merge_folders(spark, path, epoch, n=3)
        spark.range(epoch, epoch + 1).write.parquet(f"{path}/batch={epoch}")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(20))
    assert len(jobs._batches(spark, path)) <= 2 + 2 + 2 + 1
    # cut off after the merged folder was written, and before
    b = jobs._batches(spark, path)[-1]
    spark.read.parquet(f"{path}/batch={b}").write.parquet(f"{path}/_merged-{b}-{b}")
    (tmp_path / "t/_merged-0-1").mkdir()
    jobs.merge_folders(spark, path, 20, n=3)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(20))
    assert not list((tmp_path / "t").glob("_merged*"))


def test_unknown_tags_without_a_vocabulary(spark):
    asked = spark.createDataFrame([("q", "A b"), ("q", None), ("r", "--")], "query_id string, tag string")
    none = spark.createDataFrame([], "tag string")
    assert sorted(map(tuple, catalog.tag_report(asked, none).collect())) == [("q", 0, ["a-b"]), ("r", 0, [])]
    assert catalog.tag_report(asked.filter("false"), none).count() == 0


def test_tags_asked_in_vain_come_before_other_verdicts(spark):
    tables = ingest(spark.createDataFrame([up(0, said(0), "a"), up(1, said(1), "b")], UPLOADS))
    corpus = search.Corpus(tables["documents"], tables["chunks"], tables["postings"], tables["document_tags"])
    queries = spark.createDataFrame([(k, "topic something") for k in "uvwxy"], "query_id string, query string")
    asked = spark.createDataFrame([("u", "nope"), ("v", "A"), ("v", "nope"), ("w", " "), ("x", "a"), ("x", "b")], "query_id string, tag string")
    got = search.search_by_tag_responses(corpus, queries, asked, tables["tags"], match_all=True)
    assert {r["query_id"]: (r["guidance_code"], r["unknown_tags"]) for r in got.collect()} == {
        "u": ("unknown_tags", ["nope"]), "v": ("grounded", ["nope"]), "w": ("unknown_tags", []), "x": ("no_document_in_scope", []), "y": ("unknown_tags", []),
    }


def test_names_are_found_by_their_stored_index(spark, corpus):
    """After a reprocessing that gives a title; only buckets of the asked runs are read."""
    store, blobs = corpus
    failed = table(spark, store, "documents").filter("filename = 'f1.pdf'").select("document_id")

    def titled():
        return lambda data, filename: [("Quarterly report", 1, 1), (data.decode(), 0, 1)]

    reprocess(spark, store, blobs, failed, parsers={"pdf": titled()}, embedder=MODEL)
    docs = table(spark, store, "documents")
    assert sorted(map(str, table(spark, store, "name_grams").collect())) == sorted(map(str, (g := catalog.name_grams(docs)).select(sorted(g.columns)).collect()))
    refs = spark.createDataFrame([("a", "terly rep"), ("b", "f_.t"), ("c", "4"), ("d", "nothing here")], "ref_id string, reference string")
    order = lambda df: sorted(map(str, df.select("ref_id", "document_id", "matched_on", "candidates").collect()))
    assert order(catalog.resolve(refs, docs, grams=S.stored_grams(spark, f"{store}/name_grams"))) == order(catalog.resolve(refs, docs))


def test_scratch_of_one_thread_is_not_removed_with_anothers(spark):
    from concurrent.futures import ThreadPoolExecutor

    from lorehive.stage import discarded, exists, staged

    files = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
    with ThreadPoolExecutor(1) as pool:
        with discarded(spark):
            mine = files(staged(spark.range(3), "mine"))
            other = files(pool.submit(staged, spark.range(3), "other").result())
    assert not exists(spark, mine) and exists(spark, other)
