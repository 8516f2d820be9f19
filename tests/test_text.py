import hashlib
import math
import uuid

from pyspark.sql import functions as F

from lorehive.functions import text as X
from lorehive.functions.stem import stem, stem_of


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string" if isinstance(value, str) or value is None else "v binary").select(f(F.col("v"))).first()[0]


def test_tags(spark):
    assert one(spark, "  Human  Resources ", X.normalize_tag) == "human-resources"
    assert one(spark, "--a b--", X.normalize_tag) == "a-b"
    assert one(spark, "x" * 80, X.normalize_tag) == "x" * 64
    assert one(spark, "a, b ,, c", X.tag_list) == ["a", " b ", " c"]
    assert one(spark, '["a", "b c"]', X.tag_list) == ["a", "b c"]
    assert one(spark, "[broken", X.tag_list) == ["[broken"]
    assert one(spark, "  ", X.tag_list) == []


def test_content_fingerprint_ignores_case_and_space(spark):
    prints = {one(spark, t, X.content_fingerprint) for t in ("Leave  policy\ntext", "  leave policy text ", "LEAVE POLICY TEXT\n\n")}
    assert prints == {hashlib.sha256(b"leave policy text").hexdigest()}


def test_decode(spark):
    assert one(spark, "ä\r\nb\rc".encode(), X.decode) == "ä\nb\nc"
    assert one(spark, "ä".encode("latin-1"), X.decode) == "ä"
    assert one(spark, "﻿a".encode(), X.decode) == "﻿a"


def test_uuid5_is_the_standard_one(spark):
    for name in ("a:b", "", "ümlaut"):
        assert one(spark, name, X.uuid5) == str(uuid.uuid5(uuid.UUID(X.NAMESPACE), name))


def test_sentences_and_passages(spark):
    assert one(spark, "One. Two! (three) four; Five", X.sentences) == ["One.", "Two!", "(three) four;", "Five"]
    assert one(spark, "alpha beta gamma", lambda c: X.cut_passage(c, 12)) == "alpha beta ..."
    assert one(spark, "alphabeta", lambda c: X.cut_passage(c, 4)) == "alph ..."
    assert one(spark, "short", lambda c: X.cut_passage(c, 10)) == "short"


def test_hash_vector_is_a_unit_vector(spark):
    v = one(spark, "hello", lambda c: X.hash_vector(c, 64))
    digest = hashlib.sha256(b"hello").digest()
    raw = [((digest[i % 32] + i) % 251) / 251 for i in range(64)]
    norm = math.sqrt(sum(x * x for x in raw))
    assert all(abs(a - b / norm) < 1e-12 for a, b in zip(v, raw))


def test_failure_kinds(spark):
    cases = {"Connect timeout": "connection", "mcp connect": "other", "401": "authentication", "429 quota": "quota", "HTTP 429": "rate_limit"}
    assert {k: one(spark, k, X.failure_kind) for k in cases} == cases


def test_stems():
    # pairs of the algorithm's published sample
    sample = {
        "consign": "consign consigned consigning consignment", "consist": "consist consisted consistency consistent consistently consisting consists", "consol": "consolation consolations console consoled consoles consoling consolingly consols",
        "consolatori": "consolatory", "consolid": "consolidate consolidated consolidating", "conspicu": "conspicuous", "conspiraci": "conspiracy", "constabl": "constable", "knack": "knack knacks", "knackeri": "knackeries", "knave": "knave knaves",
        "knead": "kneaded", "kneel": "kneel kneeling", "knight": "knight knightly knights", "knit": "knit knits knitted knitting", "knive": "knives", "knock": "knock knocked knocking knocks", "knocker": "knocker knockers",
    }
    assert {w: stem(w) for words in sample.values() for w in words.split()} == {w: s for s, words in sample.items() for w in words.split()}
    assert [stem(w) for w in ("policies", "running", "agreed", "glass", "ties", "created", "leave", "skies", "proceed", "used", "hopping", "analogies", "say", "cry", "2nd", "at")] == [
        "polici", "run", "agre", "glass", "tie", "creat", "leav", "sky", "proceed", "use", "hop", "analog", "say", "cri", "2nd", "at"
    ]
    assert stem("relational") == stem("relate")


def test_stems_against_their_statement_in_sql(spark, sf_dir):
    """Over all words of the texts, and all endings of the steps on made-up beginnings."""
    import duckdb

    from lorehive.functions import stem as T
    from lorehive.queries.search_queries import STEMS

    rows = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(X.terms(F.col("text")))).distinct().collect()]
    ends = ["", "s", "ss", "sses", "ies", "ied", "us", "ing", "ed", "eed", "eedly", "ingly", "edly", "y", "ings", "ying", "e", "le", "lle", "ll", *T.STEP2, *T.STEP3, *T.STEP4]
    rows += [a + b for a in ("", "b", "ab", "hop", "hopp", "fall", "glass", "try", "cre", "creat", "tabl", "siz", "ß", "naïv", "4", "agre", "sing", "gener", "arsen", "yay", "syy", "commun", "controll", "adopts", "cheol", "rat") for b in ends]
    rows = sorted({*rows, *T.WHOLE, *T.KEPT} - {""})
    con = duckdb.connect()
    con.execute("create table w as select unnest(?) as term", [rows])
    want = dict(con.execute("with " + STEMS.replace("{0}", "w") + " select term, stem from st").fetchall())
    got = dict(spark.createDataFrame([(w,) for w in rows], "w string").select("w", stem_of(F.col("w"))).collect())
    assert len(rows) > 6000 and {w: s for w, s in got.items() if want[w] != s} == {} and all(stem(w) == s for w, s in want.items())


def test_strip_takes_all_white_space(spark):
    """By a list of characters, without a pattern that goes over the whole text: the same ones that a pattern finds."""
    every = spark.range(0x3100).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c")).select(F.concat("c", F.lit(" a"), "c", F.lit("b"), "c", "c").alias("t"))
    stripped = X.strip(F.col("t"))
    assert "regexp" not in every.select(stripped)._jdf.queryExecution().executedPlan().toString()
    assert every.filter(~stripped.eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+\z", ""))).count() == 0
    assert every.filter(F.length(stripped) == 3).count() == 25 and every.select(X.strip(F.lit(None).cast("string"))).first()[0] is None
