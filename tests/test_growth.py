"""What must not grow with the table: shuffles, tasks' memory and batches of Python; and odd inputs of the same steps."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorehive.functions.stem import counted_stems, stem
from lorehive.operators import chunk as C
from lorehive.operators import parse as P
from lorehive.operators import retrieval as R
from lorehive.queries import ingest_queries as Q
from lorehive.sources import files as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_font_headings_need_a_large_line(spark, tmp_path):
    """A document of one line has no line over its own median: what looks like a heading is none by size."""
    d = documents(spark, tmp_path, [(1, "20.118.157.107 Betz das mit", "de", "s"), (2, " ".join(f"w{k}" for k in range(30)), "en", "s")])
    assert [(r["document_id"], r["text"], r["level"]) for r in Q.par9_font_headings(spark, d).collect()] == [("2", " ".join(f"w{k}" for k in range(10)), 1)]


@pytest.mark.parametrize("stemmed", [False, True])
def test_postings_need_no_shuffle(spark, stemmed):
    texts = ["b a b relational relations", None, "", "the of", "x " * 3000 + "Running runs ran"]
    chunks = spark.createDataFrame([(f"c{k}", "d", t, "Cats" if k == 4 else None) for k, t in enumerate(texts)], "chunk_id string, document_id string, text string, heading_path string")
    index = R.postings(chunks, stemmed)
    assert "Exchange" not in plan(index)
    want = Counter()
    for k, t in enumerate(texts):
        for w in re.findall(r"\w+", f"{'Cats' if k == 4 else ''} {t or ''}".lower()):
            if w not in R.STOP_WORDS:
                want[stem(w) if stemmed else w, f"c{k}"] += 1
    assert sorted((r["term"], r["chunk_id"], r["tf"]) for r in index.collect()) == sorted((*k, n) for k, n in want.items())


def test_stems_are_counted_in_one_step(spark, monkeypatch):
    """No function of single words is left in the plan; lists are taken a few at once, empty and null ones among them."""
    monkeypatch.setattr("lorehive.functions.stem.HELD", 2)
    chunks = spark.createDataFrame([("c0", "d", "The cats, cat's CATS"), ("c1", "d", "the of"), ("c2", "d", None), ("c3", "d", "zebra"), ("c4", "d", "\U0001d7d8 été cat")], "chunk_id string, document_id string, text string").withColumn("heading_path", F.lit(None).cast("string"))
    index = R.postings(chunks.coalesce(1), True)
    assert "lambda" not in plan(index)
    assert sorted((r["chunk_id"], r["term"], r["tf"]) for r in index.collect()) == [("c0", "cat", 3), ("c3", "zebra", 1), ("c4", "cat", 1), ("c4", "été", 1), ("c4", "\U0001d7d8", 1)]
    lists = spark.createDataFrame([(["a", "cats", "cat"],), (None,), ([],)], "words array<string>").coalesce(1).select(counted_stems(F.col("words")).alias("x"))
    assert [[tuple(x) for x in r["x"]] for r in lists.collect()] == [[("a", 1), ("cat", 2)], [], []]


def test_tokens_are_counted_once(spark):
    """Of what fits; sentences and cuts of what doesn't have their own."""
    texts = ["one two. Three four", " ", "a b c d e f g. H i", "aa bb cc dd ee ff"]
    found = spark.createDataFrame([("d", 0, "p", None, texts), ("e", 0, None, 1, None)], "document_id string, section long, heading_path string, page int, paragraphs array<string>")
    got = [(r["text"], r["tokens"]) for r in C.units(found, 5).orderBy("unit").collect()]
    assert got == [("one two. Three four", 5), ("a b c d e", 5), ("f g.", 3), ("H i", 2), ("aa bb cc dd ee", 5), ("ff", 1)]


def test_ids_of_packed_chunks_need_no_shuffle(spark):
    """Only the units are gathered by document; ids and repeats are seen to in the row, as with_ids() does."""
    rows = [("d1", 1, "A", k + 1, t, 2) for k, t in enumerate(["a b", "c d", "a b", "e f", "a b"])] + [("d2", 1, None, 1, "a b", 2)]
    units = spark.createDataFrame([(d, s, p, None, u, t, n) for d, s, p, u, t, n in rows], "document_id string, section long, heading_path string, page int, unit int, text string, tokens int")
    got = C.with_own_ids(C.packed(units, 2, 0, 1))
    assert plan(got).count("Exchange hashpartitioning") == 1
    want = C.with_ids(C.chunks(units, 2, 0, 1))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() == 4


def test_python_takes_few_documents_at_once(spark, monkeypatch):
    assert C.HELD <= 64
    units = spark.range(300).selectExpr("concat('d', id) as document_id", "0L as section", "'p' as heading_path", "cast(null as int) as page", "1 as unit", "concat('w', id) as text", "1 as tokens").coalesce(1)
    assert C.packed(units).mapInArrow(lambda it: it, "document_id string, chunks array<struct<chunk_index: int, text: string, heading_path: string, page: int, token_count: int>>").count() == 300
    assert {(r["document_id"], r["text"]) for r in C.chunks(units).collect()} == {(f"d{k}", f"w{k}") for k in range(300)}


def test_blocks_need_no_shuffle(spark):
    text = "\n\n  \nTITLE\nbody one\nmore\n----\n\n# not\nx\n\n\n1. ITEM\n==\nend  "
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", "\n \n"), ("e", "A\n===\n"), ("f", "one\n-----\ntwo")], "document_id string, text string")
    lists = P.block_lists(docs)
    assert "Exchange" not in plan(P.blocks(docs)) and "Exchange" not in plan(P.facts(lists))
    got = {r["document_id"]: [(b["pos"], b["text"], b["level"]) for b in r["blocks"] or []] for r in lists.collect()}
    assert got["a"] == [(3, "TITLE\nbody one\nmore", 0), (8, "not", 1), (9, "x", 0), (12, "1. ITEM\n==\nend", 0)]
    assert got["b"] == got["c"] == got["d"] == [] and got["e"] == [(0, "A", 1)] and got["f"] == [(0, "one", 2), (2, "two", 0)]
    facts = {r["document_id"]: (r["heading"], r["reason"], r["char_count"]) for r in P.facts(lists).collect()}
    assert facts["b"] == (None, "no_text", None) and facts["e"] == ("A", "headings_only", 1) and facts["f"] == ("one", None, 8)


def test_originals_have_a_file_for_each_folder(spark, tmp_path):
    up = spark.range(4000).selectExpr("id as upload_id", "timestamp_seconds(id) as uploaded_at", "concat('f', id, '.txt') as filename", "cast(concat('t', id % 2000) as binary) as content").withColumn("file_hash", F.sha2("content", 256)).repartition(8)
    S.write_blobs(S.new_blobs(up), str(tmp_path / "blobs"))
    assert len(list((tmp_path / "blobs").glob("prefix=*/*.parquet"))) == len(list((tmp_path / "blobs").glob("prefix=*")))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2000


def test_changed_buckets_are_written_once(spark, tmp_path, monkeypatch):
    """The buckets written aside are put in place as they are; a run cut off while doing so is ended by the next."""
    path = str(tmp_path / "t")
    S.write_bucketed(spark.range(100).selectExpr("cast(id as string) as document_id", "1 as v"), path, 4)
    moved = []
    rename = S.rename

    def once(s, a, b):
        if len(moved) == 2:
            raise InterruptedError
        moved.append(b)
        rename(s, a, b)

    monkeypatch.setattr(S, "rename", once)
    change = spark.range(100).selectExpr("cast(id as string) as document_id", "2 as v")
    with pytest.raises(InterruptedError):
        S.rewrite_touched(spark, path, change, lambda old, new: new)
    monkeypatch.setattr(S, "rename", rename)
    S.rewrite_touched(spark, path, change.limit(0), lambda old, new: old)
    assert [tuple(r) for r in spark.read.parquet(path).groupBy("v").count().collect()] == [(2, 100)]


def test_files_are_written_by_their_tasks(spark, tmp_path, monkeypatch):
    """One file a text in folders that are listed side by side, without the checksum file that Spark's writer makes."""
    monkeypatch.setattr(S, "FOLDER_FILES", 10)
    texts = [f"t{k}\nü" for k in range(95)] + ["", None, "t1\nü"]
    path = str(tmp_path / "a folder")
    S.write_files(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), path)
    files = [f for f in (tmp_path / "a folder").rglob("*") if f.is_file()]
    assert len(files) == len(texts) and {f.suffix for f in files} == {".txt"} and max(Counter(f.parent for f in files).values()) <= 10
    assert Counter(bytes(r["content"]).decode() for r in S.read_corpus(spark, path).collect()) == Counter((t or "") + "\n" for t in texts)
    S.write_files(spark.createDataFrame([], "text string"), f"file:{tmp_path}/none")
    assert S.read_corpus(spark, f"{tmp_path}/none").count() == 0


def test_layout_needs_no_shuffle(spark):
    """Lines and blocks are worked out in the document's row; words that come a row each are shuffled once. Rows without
    a place, a size or a word are as odd as they come."""
    words = [("a", 1, 0.0, 0.0, "1.", 10.0), ("a", 1, 0.4, 5.0, "Title", 30.0), ("a", 1, 12.0, 0.0, "body", 10.0), ("a", 0, 90.0, 0.0, "first", 0.0), ("a", 2, 1.5, 0.0, "half", 10.0), ("a", 2, 4.5, 0.0, "other", None),
             ("b", None, None, None, "PLAIN", None), ("b", None, None, 1.0, None, -1.0), ("b", 3, 0.0, 0.0, " ", 10.0), ("c", 1, 0.0, 0.0, "", 1.0)]
    rows = spark.createDataFrame(words, "document_id string, page int, top double, x0 double, text string, size double")
    docs = spark.createDataFrame([(d, [w[1:] for w in words if w[0] == d]) for d in "abcd"] + [("e", None)], "document_id string, words array<struct<page: int, top: double, x0: double, text: string, size: double>>")
    lists = P.line_lists(docs)
    assert "Exchange" not in plan(P.unpacked(lists, column="lines")) and "Exchange" not in plan(P.unpacked(P.layout_block_lists(lists)))
    assert plan(P.layout_blocks(P.layout_lines(rows))).count("Exchange hashpartitioning") == 1
    lines = sorted(map(tuple, P.unpacked(lists, column="lines").collect()), key=str)
    assert lines == sorted(map(tuple, P.layout_lines(rows).collect()), key=str)
    assert lines == sorted([("a", 0, 30, "first", 1.0), ("a", 1, 0, "1. Title", 20.0), ("a", 1, 4, "body", 10.0), ("a", 2, 0, "half", 10.0), ("a", 2, 2, "other", 1.0), ("b", None, None, "PLAIN", 1.0)], key=str)
    blocks = sorted(map(tuple, P.unpacked(P.layout_block_lists(lists)).collect()), key=str)
    assert blocks == sorted(map(tuple, P.layout_blocks(P.layout_lines(rows)).collect()), key=str)
    assert blocks == sorted([("a", 1, "first", 0, 0), ("a", 2, "1. Title", 1, 1), ("a", 3, "body half other", 0, 1), ("b", 1, "PLAIN", 2, None)], key=str)


@pytest.mark.parametrize("scoped", [False, True])
def test_tasks_that_score_follow_the_index(spark, scoped):
    """However many shuffle partitions there are: a task scores its own chunks, and what goes to it isn't multiplied by queries."""
    index = spark.range(0, 600, 1, 6).selectExpr("concat('t', id % 7) as term", "concat('c', id % 50) as chunk_id", "concat('d', id % 5) as document_id", "id % 3 + 1 as tf")
    terms = spark.range(40).selectExpr("concat('q', id % 10) as query_id", "concat('t', id % 8) as term").distinct()
    scope = spark.range(20).selectExpr("concat('q', id % 10) as query_id", "concat('d', id % 3) as document_id") if scoped else None
    got = R.keyword_search(index, terms, scope, pool=3)
    assert f", {R.SCORE_SPREAD * 6}), REPARTITION_BY_NUM" in plan(got)
    score, asked = Counter(), [tuple(r) for r in terms.collect()]
    allowed = scope and {tuple(r) for r in scope.collect()}
    for r in index.collect():
        for q, t in asked:
            if t == r["term"] and (allowed is None or (q, r["document_id"]) in allowed):
                score[q, r["chunk_id"], r["document_id"]] += r["tf"]
    want = []
    for q in {k[0] for k in score}:
        best = sorted((-n, k[1], k[2]) for k, n in score.items() if k[0] == q)[:3]
        want += [(q, c, d, -n, rank + 1) for rank, (n, c, d) in enumerate(best)]
    assert sorted((r["query_id"], r["chunk_id"], r["document_id"], round(r["score"] * 10), r["rank"]) for r in got.collect()) == sorted(want)


def test_headings_by_size_are_worked_out_once(spark, sf_dir, tmp_path):
    """No filter or lambda has the steps put in once more, so that a document's time is not by the square of its lines."""
    said = plan(Q.par9_font_headings(spark, sf_dir)).split("\n\n")[0]
    assert said.count("regexp_extract_all(") == 1
    d = documents(spark, tmp_path, [(1, " ".join(f"w{k}" for k in range(80)), "en", "s"), (2, "1. Alone", "en", "s"), (3, "", "en", "s"), (4, None, "en", "s")])
    assert sorted((r["document_id"], r["text"].split()[0], r["level"]) for r in Q.par9_font_headings(spark, d).collect()) == [("1", "w0", 1), ("1", "w50", 2), ("1", "w70", 1)]


def test_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """As Spark's reader reads them: names, hidden and empty files, folders in folders and many files in one, but in a few tasks."""
    monkeypatch.setattr(S, "READ_BYTES", 20)
    top = tmp_path / "a folder"
    for folder in ("", "x=1/deep", "_aside", ".git", "_y=2", "none"):
        (top / folder).mkdir(parents=True, exist_ok=True)
        for name in ("a.txt", "B.md", "c.pdf", "d.TXT", "e.sh", "_f.txt", ".g.txt", "h.txt._COPYING_", "\u00fc i%20.txt", "_k=1.txt", "txt"):
            if folder != "none":
                (top / folder / name).write_bytes(f"{folder} {name}\0".encode())
    (top / "many").mkdir()
    for k in range(S.FOLDER_FILES * 2 + 5):
        (top / f"many/{k}.txt").write_bytes(b"" if k % 2 else b"\xff\x00%d" % k)
    want = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,txt,pdf}").option("recursiveFileLookup", "true").load(str(top)).select("path", "content")
    want = sorted((r["path"], bytes(r["content"])) for r in want.collect())
    for path in (str(top), top.as_uri(), f"{top}/"):
        got = S.read_corpus(spark, path)
        assert sorted((r["upload_id"], bytes(r["content"])) for r in got.collect()) == want and len(want) == S.FOLDER_FILES + 3 + 3 * 5, path
        assert got.rdd.getNumPartitions() <= 16
    assert S.read_corpus(spark, f"{top}/*=1").count() == 5 and S.read_corpus(spark, f"{top}/a.txt").count() == 1


def test_rows_of_new_keys_rewrite_no_bucket(spark, tmp_path):
    """They are files of their own; keys that have rows, as after a run that was cut off, are left to be replaced; and a table that grows is dealt out anew."""
    path = str(tmp_path / "t")
    rows = lambda a, b: spark.range(a, b).selectExpr("concat('d', id div 2) as document_id", "id as v")
    files = lambda: {p for p in (tmp_path / "t").rglob("*.parquet")}
    S.write_bucketed(rows(0, 100), path, 4)
    before = files()
    assert S.add_unseen(spark, path, rows(100, 160), rows(100, 160)) and before < files()
    assert S.add_unseen(spark, path, rows(0, 0), rows(0, 0))
    there = files()
    assert not S.add_unseen(spark, path, rows(158, 200), rows(158, 200)) and files() == there
    got = spark.read.parquet(path)
    assert sorted(tuple(r) for r in got.select("document_id", "v").collect()) == sorted(tuple(r) for r in rows(0, 160).collect())
    assert got.selectExpr("of = 4 and bucket = pmod(xxhash64(document_id), 4) as ok").distinct().collect() == [(True,)]
    assert S.add_unseen(spark, path, rows(160, 400), rows(160, 400), bucket_rows=20)
    got = spark.read.parquet(path)
    assert sorted(r["v"] for r in got.collect()) == list(range(400)) and {r["of"] for r in got.select("of").distinct().collect()} == {32}
