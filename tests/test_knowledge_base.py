import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorehive.operators import catalog as K
from lorehive.operators import chatlog as L
from lorehive.operators import dedup as D
from lorehive.operators import retrieval as R
from lorehive.plans import search as J
from lorehive.plans.ingest import ingest
from lorehive.sources import files as S

DAY = dt.datetime(2024, 1, 1)
UPLOADS = "upload_id long, uploaded_at timestamp, filename string, content_type string, content binary, tags array<string>"


def uploads(spark, *rows):
    return spark.createDataFrame([(k, DAY + dt.timedelta(days=k), name, "text/plain", text.encode(), tags) for k, (name, text, tags) in enumerate(rows)], UPLOADS)


def test_parser_choice(spark):
    names = [("a.PDF", None), ("a.md", "application/octet-stream"), ("a.sh", "application/octet-stream"), ("a.zip", None), ("a.png", "image/png"), ("a", None), ("a", "text/plain; charset=utf-8")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(names)], "i int, f string, c string")
    assert [r[1] for r in df.select("i", S.parser_kind(F.col("f"), F.col("c"))).orderBy("i").collect()] == ["pdf", "text", None, None, None, None, "text"]


def test_ingest_folds_copies_and_merges_tags(spark):
    body = "Remote work is allowed for two days a week, as agreed with the team. " * 5
    up = uploads(spark, ("a.txt", body, ["HR"]), ("b.txt", body, ["New Tag"]), ("c.txt", body + "\n\n", ["c"]), ("d.txt", "# Only a heading", ["x"]))
    out = ingest(up)
    docs = {r["filename"]: r for r in out["documents"].collect()}
    assert set(docs) == {"a.txt", "c.txt", "d.txt"}
    assert docs["c.txt"]["status"] == "duplicate" and docs["c.txt"]["duplicate_of_id"] == docs["a.txt"]["document_id"] and docs["c.txt"]["chunk_count"] == 0
    assert docs["d.txt"]["status"] == "failed" and docs["d.txt"]["content_hash"] is None
    assert {r["tag"] for r in out["document_tags"].collect() if r["document_id"] == docs["a.txt"]["document_id"]} == {"hr", "new-tag", "c"}
    again = ingest(up)["chunks"]
    assert again.exceptAll(out["chunks"]).count() == 0 == out["chunks"].exceptAll(again).count()
    verdicts = {r["upload_id"]: r for r in D.upload_verdicts(up.withColumn("file_hash", F.sha2("content", 256))).collect()}
    assert verdicts[1]["duplicate"] and verdicts[1]["message"].endswith("added new tag(s): New Tag.")


def test_fold_needs_a_ready_oldest(spark):
    rows = [("a", "h", 1, "failed"), ("b", "h", 2, "ready"), ("c", "g", 1, "ready"), ("d", "g", 2, "ready"), ("e", None, 3, "ready")]
    got = {r["document_id"]: (r["status"], r["duplicate_of_id"]) for r in D.fold_content(spark.createDataFrame(rows, "document_id string, content_hash string, created_at long, status string")).collect()}
    assert got == {"a": ("failed", None), "b": ("ready", None), "c": ("ready", None), "d": ("duplicate", "c"), "e": ("ready", None)}


def test_delete_clears_references(spark):
    docs = spark.createDataFrame([("a", None), ("b", "a"), ("c", None)], "document_id string, duplicate_of_id string")
    rest = spark.createDataFrame([("a", "x"), ("c", "x")], "document_id string, tag string")
    out = D.delete_documents(docs, rest, rest, rest, docs.filter("document_id = 'a'"))
    assert sorted(map(tuple, out["documents"].collect())) == [("b", None), ("c", None)]
    assert [r["document_id"] for r in out["vectors"].collect()] == ["c"]


def ranked(spark, **lists):
    return spark.createDataFrame([("q", name, k + 1, c) for name, ids in lists.items() for k, c in enumerate(ids)], "query_id string, retriever string, rank int, chunk_id string")


def test_fusion(spark):
    order = lambda df: [r["chunk_id"] for r in R.fuse(df).orderBy("fused_rank").collect()]
    assert order(ranked(spark, dense="ABC", keyword="CBD"))[:3] == ["C", "B", "A"]
    assert order(ranked(spark, dense="AAB")) == ["A", "B"]
    assert {r["chunk_id"]: r["dense_rank"] for r in R.fuse(ranked(spark, dense="AAB")).collect()} == {"A": 1, "B": 3}
    assert order(ranked(spark, dense="AB", keyword="BA")) == ["A", "B"]
    assert order(ranked(spark)) == []
    scores = [r["relevance"] for r in R.relevance(R.fuse(ranked(spark, dense="ABC", keyword="ACB"))).orderBy("fused_rank").collect()]
    assert scores[0] == 1.0 and scores == sorted(scores, reverse=True)


def test_dense_search_is_exact_and_scoped(spark):
    rows = [(f"c{i}", f"d{i % 3}", 0, [float(i), 1.0]) for i in range(30)] + [("zero", "d0", 0, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, vector array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, vector array<float>")
    got = R.dense_search(vectors, queries, pool=3).filter("query_id = 'q'").orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c29", "c28", "c27"]
    scope = spark.createDataFrame([("q", "d1")], "query_id string, document_id string")
    assert [r["chunk_id"] for r in R.dense_search(vectors, queries, scope, pool=2).orderBy("rank").collect()] == ["c28", "c25"]
    assert R.dense_search(vectors, queries, scope.filter("false")).count() == 0


def test_quality(spark):
    rows = [("a", 0.2, ["semantic", "keyword"]), ("b", 0.82, ["semantic"]), ("c", 0.82, ["semantic", "keyword"]), ("d", None, ["keyword"])]
    got = {r["query_id"]: r["verdict"] for r in R.quality(spark.createDataFrame(rows, "query_id string, similarity double, matched_by array<string>")).collect()}
    assert got == {"a": "weak", "b": "moderate", "c": "grounded", "d": "moderate"}
    words = {r["query_id"]: r["verdict"] for r in R.quality(spark.createDataFrame(rows[3:], "query_id string, similarity double, matched_by array<string>"), semantic=False).collect()}
    assert words == {"d": "grounded"}  # a keyword-only search has no second list


def test_resolve(spark):
    docs = spark.createDataFrame([("1", "a.txt", "Alpha", 1), ("2", "A.TXT", "Beta", 2), ("3", "policy_x.md", "Travel", 3), ("4", "other.md", "Travel notes", 4)], "document_id string, filename string, title string, created_at long")
    refs = spark.createDataFrame([(k, k) for k in ("3", "a.txt", "OTHER.md", "travel", "policy", "nothing", " ")], "ref_id string, reference string")
    got = {r["ref_id"]: (r["matched_on"], r["document_id"], r["candidates"]) for r in K.resolve(refs, docs).collect()}
    assert got == {"3": ("id", "3", []), "a.txt": ("ambiguous", None, ["1", "2"]), "OTHER.md": ("filename", "4", []), "travel": ("title", "3", []), "policy": ("partial-name", "3", []), "nothing": ("none", None, []), " ": ("empty", None, [])}


def test_outline_treats_null_as_a_path(spark):
    chunks = spark.createDataFrame([("d", 0, None, 1), ("d", 1, None, 1), ("d", 2, "x", 2), ("d", 3, None, 3)], "document_id string, chunk_index int, heading_path string, page int")
    got = sorted((r["first_chunk_index"], r["last_chunk_index"], r["heading_path"]) for r in K.outline(chunks).collect())
    assert got == [(0, 1, None), (2, 2, "x"), (3, 3, None)]


def test_chat_log(spark):
    frames = ['data: {"type":"tool_call","name":"s"}', 'data: {"type":"tool_call","name":"s"}', "data: nonsense", 'data: {"type":"tool_result","name":"s","structured":{"results":[{"chunk_id":"c"},{"chunk_id":"c"},{"chunk_id":""}]}}', 'data: {"type":"text","text":"he"}', 'data: {"type":"tool_result","name":"s","structured":{"results":[{"chunk_id":"c"}]}}', 'data: {"type":"text","text":"y"}', 'data: {"type":"error","message":"no"}']
    events = L.frames(spark.createDataFrame([(1, 1, "\n\n".join(frames))], "conv_id long, turn int, body string"))
    assert events.count() == 7
    assert tuple(L.turn_texts(events).first())[2:] == ("hey", "no")
    assert [r["seq"] for r in L.turn_citations(L.citations(events)).collect()] == [3, 3]
    assert sorted((r["seq"], r["result_seq"]) for r in L.pair_calls(events).collect()) == [(0, 5), (1, 3)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "document_id string, n int")
    S.write_bucketed(old, path, 4)
    new = spark.createDataFrame([("b", 2), ("d", 2)], "document_id string, n int")
    S.rewrite_touched(spark, path, new, lambda o, n: S.replace_chunks(o, n, n), 4)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("document_id", "n").collect()) == [("a", 1), ("b", 2), ("c", 1), ("d", 2)]
    up = uploads(spark, ("a.txt", "x", []), ("b.txt", "x", [])).withColumn("file_hash", F.sha2("content", 256))
    blobs = S.new_blobs(up)
    assert blobs.count() == 1 and S.new_blobs(up, blobs).count() == 0


def test_read_corpus(spark, tmp_path):
    for name in ("a.md", "b.txt", "c.bin"):
        (tmp_path / name).write_text(name)
    tags = spark.createDataFrame([("a.md", ["x"])], "filename string, tags array<string>")
    assert {r["filename"]: r["tags"] for r in S.read_corpus(spark, str(tmp_path), tags).collect()} == {"a.md": ["x"], "b.txt": ["uncategorised"]}
    same = {r["upload_id"].rsplit("/", 1)[-1] for r in S.read_corpus(spark, str(tmp_path)).collect()}
    assert same == {"a.md", "b.txt"}
    for name in ("z.txt", "k.txt"):
        (tmp_path / name).write_text("The same words stand in two files, and the first by name is kept here. " * 3)
    kept = ingest(S.read_corpus(spark, str(tmp_path)))["documents"]
    assert {r["filename"] for r in kept.collect()} == {"a.md", "b.txt", "k.txt"}


BODY = "Remote work is allowed for two days a week, as agreed with the team. " * 5


def test_ingest_keeps_account_of_everything(spark):
    """Rejected uploads, files without a parser or that it fails on, twins, vectors, and all columns."""
    rows = [("a.txt", BODY, ["HR"]), ("b.txt", BODY.upper(), []), ("c.sh", "x", []), ("d.txt", "", []), ("e.pdf", "Paged text of some length. " * 9, ["p"]), ("f.pdf", "broken", [])]
    up = uploads(spark, *rows).withColumn("content_type", F.when(F.col("filename") == "a.txt", "text/plain"))

    def pages(data, filename):
        if data == b"broken":
            raise ValueError("no pages\0")
        return [("Head\0ing", 1, 1), (data.decode(), 0, 3)]

    model = R.Embedder(lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    out = ingest(up, parsers={"pdf": pages}, embedder=model)
    docs = {r["filename"]: r for r in out["documents"].collect()}
    assert {r["filename"]: r["reason"] for r in out["rejected"].collect()} == {"c.sh": "unsupported", "d.txt": "empty"}
    assert {k: (d["status"], d["error"]) for k, d in docs.items()} == {"a.txt": ("ready", None), "b.txt": ("duplicate", None), "e.pdf": ("ready", None), "f.pdf": ("failed", "ValueError: no pages\0")}
    assert docs["b.txt"]["summary"] == "Identical content to a.txt; not indexed separately." and docs["b.txt"]["title"] is None
    assert (docs["e.pdf"]["title"], docs["e.pdf"]["page_count"], docs["e.pdf"]["content_type"], docs["a.txt"]["content_type"]) == ("Heading", 1, "application/octet-stream", "text/plain")
    assert docs["a.txt"]["storage_path"] == docs["a.txt"]["file_hash"] + ".txt" and docs["a.txt"]["version"] == 1
    assert {r["chunk_id"] for r in out["vectors"].collect()} == {r["chunk_id"] for r in out["chunks"].collect()} and R.missing_vectors(out["chunks"], out["vectors"], 2).count() == 0
    assert {r["tag"] for r in out["tags"].collect()} == {"hr", "p"}
    bare = {r["filename"]: r["error"] for r in ingest(up)["documents"].filter("status = 'failed'").collect()}
    assert bare == {"e.pdf": "no_parser: pdf", "f.pdf": "no_parser: pdf"}


def test_a_model_must_answer_every_text(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    for bad in (R.Embedder(lambda texts: [[1.0, 2.0]] * (len(texts) + 1), 2), R.Embedder(lambda texts: [[1.0]] * len(texts), 2)):
        with pytest.raises(Exception, match="the model gave"):
            R.embed(df, bad).collect()


def test_search_finds_other_forms_of_a_word(spark):
    """A whole question against stems, as ingest makes them; and an embedder for both lists."""
    up = uploads(spark, ("a.txt", "The team that works remotely is allowed two days. " * 4, []), ("b.txt", "Holidays are planned by each person early. " * 4, []))
    out = ingest(up, embedder=R.Embedder(lambda texts: [[float(t.count("remote")), float(t.lower().count("holiday")), 0.1] for t in texts], 3))
    q = spark.createDataFrame([("q", "is a working holiday allowing it?"), ("r", "zzz qqq")], "query_id string, query string")
    plain = J.Corpus(out["documents"], out["chunks"], out["postings"], out["document_tags"])
    assert {r["filename"] for r in J.search(plain, q).collect()} == {"a.txt", "b.txt"}
    both = J.Corpus(**vars(plain) | {"vectors": out["vectors"], "embedder": R.Embedder(lambda texts: [[float(t.count("remote")), float(t.lower().count("holiday")), 0.1] for t in texts], 3)})
    assert both.semantic(q) and not plain.semantic(q)
    got = {(r["query_id"], r["filename"]): r for r in J.search(both, q).collect()}
    assert got["q", "b.txt"]["matched_by"] == ["semantic", "keyword"] and got["q", "b.txt"]["similarity"] > got["q", "a.txt"]["similarity"]
    both.embedder = R.Embedder(both.embedder.embed, 3, is_semantic=False)
    assert all(r["similarity"] is None for r in J.search(both, q).collect())


def test_dense_search_in_blocks_of_questions(spark, monkeypatch):
    rows = [(f"c{i}", f"d{i % 7}", [float(i % 13), float(i % 5), 1.0]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "chunk_id string, document_id string, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", [1.0, float(i % 4), float(i % 3)]) for i in range(40)], "query_id string, vector array<float>")
    scope = spark.createDataFrame([(f"q{i}", f"d{i % 7}") for i in range(0, 40, 2)], "query_id string, document_id string")
    whole = [sorted(map(tuple, R.dense_search(vectors, queries, s, pool=5).collect())) for s in (None, scope)]
    monkeypatch.setattr(R, "QUERY_BYTES", 200)
    monkeypatch.setattr(R, "SIMILARITY_BYTES", 400)
    assert [sorted(map(tuple, R.dense_search(vectors, queries, s, pool=5).collect())) for s in (None, scope)] == whole
    assert len(whole[0]) == 200 and {r[0] for r in whole[1]} == {f"q{i}" for i in range(0, 40, 2)}


def test_references_by_rare_runs_of_characters(spark):
    """Against LIKE on all documents: fragments, wildcards, short ones, any case."""
    names = [f"{'Policy' if k % 3 else 'guide'}_{k}.{'txt' if k % 2 else 'md'}" for k in range(60)]
    docs = spark.createDataFrame([(str(k), n, None if k % 7 == 0 else f"Title {n[:4]} {k}", k) for k, n in enumerate(names)], "document_id string, filename string, title string, created_at long")
    needles = ["policy_1", "GUIDE", "_1", "%", "le pol%4", "po%cy", "zzzz", "12", "title", "e_3.", "y_5%t"]
    refs = spark.createDataFrame([(n, n) for n in needles], "ref_id string, needle string")
    want = {(r["ref_id"], r["document_id"]) for r in refs.crossJoin(docs).filter(K.name_contains(F.col("needle"))).collect()}
    got = [(r["ref_id"], r["document_id"]) for r in K.name_matches(refs, docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({r for r, _ in want}) == 10


def test_many_files_of_one_name(spark):
    docs = spark.createDataFrame([(f"{k:03}", "Same.txt", None, k) for k in range(100)], "document_id string, filename string, title string, created_at long")
    refs = spark.createDataFrame([("r", "same.TXT")], "ref_id string, reference string")
    got = K.resolve(refs, docs).first()
    assert got["matched_on"] == "ambiguous" and got["candidates"] == [f"{k:03}" for k in range(8)]
    assert K.same_name(refs.withColumnRenamed("reference", "needle"), docs).count() == 100


def test_buckets_follow_the_table(spark, tmp_path, monkeypatch):
    """Emptied buckets, a run that was cut off before its buckets were in place, and growth."""
    assert [S.bucket_count(n, 10) for n in (0, 10, 11, 25, 80)] == [1, 1, 2, 4, 8]
    path = str(tmp_path / "t")
    rows = lambda a, b, v: spark.createDataFrame([(f"d{k}", v) for k in range(a, b)], "document_id string, v int")
    read = lambda: {r["document_id"]: r["v"] for r in spark.read.parquet(path).collect()}
    monkeypatch.setattr(S, "BUCKET_ROWS", 10)
    S.write_bucketed(rows(0, 40, 1), path, S.bucket_count(40, 10))
    replace = lambda old, new: S.replace_chunks(old, new.filter("v > 0"), new)
    S.rewrite_touched(spark, path, rows(0, 38, 0), replace)
    assert read() == {"d38": 1, "d39": 1}
    settle = S._settle
    calls = []
    monkeypatch.setattr(S, "_settle", lambda *a: calls.append(a) or (settle(*a) if len(calls) == 1 else None))
    S.rewrite_touched(spark, path, rows(38, 39, 5), replace)  # cut off: written aside only
    assert read()["d38"] == 1
    monkeypatch.setattr(S, "_settle", settle)
    S.rewrite_touched(spark, path, rows(50, 250, 7), replace)
    assert read() == {"d38": 5, "d39": 1} | {f"d{k}": 7 for k in range(50, 250)}
    assert {r[0] for r in spark.read.parquet(path).select("of").distinct().collect()} == {32}


def test_verdicts_by_content(spark):
    up = uploads(spark, ("a.txt", "x y", ["t"]), ("b.txt", "X  Y", ["t", "u"]), ("c.txt", "X  Y", ["w"]), ("d.txt", "x y", [])).withColumn("file_hash", F.sha2("content", 256))
    one = up.groupBy().agg(F.min_by("file_hash", "upload_id").alias("twin_hash"))
    got = [r["message"] for r in D.upload_verdicts(up, up.filter("upload_id = 1").select("file_hash").crossJoin(one)).orderBy("upload_id").collect()]
    assert got == [D.ACCEPTED, f"{D.SAME_CONTENT}; added new tag(s): u.", f"{D.SAME_FILE}; added new tag(s): w.", f"{D.SAME_FILE}; no changes made."]


def test_questions_of_stop_words_have_no_term(spark):
    asked = spark.createDataFrame([("a", "How do all of these?"), ("b", "What is relational about any of it")], "query_id string, query string")
    assert sorted(map(tuple, R.query_terms(asked, stemmed=True).collect())) == [("b", "relat")]
    assert R.query_terms(asked).count() == 1
