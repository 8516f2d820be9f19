"""Spelling variants, filter orders and repeated passages, against plain versions of what they state."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from lorehive.llm import exchange, filter_audit, queries, spelling, substrings
from tests_llm_common import DOCS, random_text

NEW = ["op11_permuterm_variants", "op12_lehmer_filter_audit", "op13_block_anchors"]


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    got = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda r: [str(v) for v in r]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=order) == sorted(got.fetchall(), key=order)


# spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words):
    out = []
    forms = {}
    for w, n in words.items():
        mine = [v for v in words if near(w, v)]
        best = min(mine, key=lambda v: (-words[v], v.encode()), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out.append((w, n, len(mine)))
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return sorted((w, forms[w], root(w), n, k, words.get(forms[w])) for w, n, k in out)


def variants(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    return sorted(tuple(r) for r in spelling.group_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(40)]
    words = {}
    for s in stems * 6:
        k = rng.randrange(len(s))
        w = rng.choice([s, s[:k] + rng.choice("abcÿ") + s[k + 1 :], s[:k] + s[k + 1 :], s[:k] + rng.choice("abß") + s[k:]])
        if len(w) >= 5:
            words[w] = rng.choice([3, 3, 4, 6, 12, 25, 60, 200])
    assert variants(spark, words) == grouped(words)


def test_variants_of_equal_letters_and_ties(spark):
    words = {"aaaaa": 50, "aaaaaa": 100, "aaaaaaa": 25, "baaaa": 50, "aaaab": 3, "caaaa": 50, "zzzzz": 7, "árbol": 4, "arbol": 9}
    assert variants(spark, words) == grouped(words)


def test_chains_of_forms_lead_to_the_last(spark):
    words = {"a" * k + "bcdef": 3 * 3**k for k in range(7)}
    got = variants(spark, words)
    assert got == grouped(words) and {r[2] for r in got} == {"aaaaaabcdef"}


def test_vocabulary_counts_runs(spark, odd, odd_rows):
    want = Counter()
    rows = [*odd_rows, *[(100 + k, "Straße naïve NAÏVE Hello×World hello", "en", "a", 0) for k in range(150)]]
    extra = spark.createDataFrame(rows, DOCS)
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                want[run] += 1
    assert dict(spelling.vocabulary(extra).collect()) == {w: n for w, n in want.items() if n >= 3}
    # columns of other names don't matter
    assert spelling.vocabulary(odd, least=1).count() >= 0


def test_no_words_no_variants(spark, nothing):
    assert spelling.group_variants(spelling.vocabulary(nothing)).count() == 0


# orders of filters


def test_intervals_cover_each_order_once():
    for mask in range(32):
        steps = {}
        for step, start, end in filter_audit.removal_intervals(mask):
            for rank in range(start, end):
                assert rank not in steps
                steps[rank] = step
        for rank, order in enumerate(filter_audit.ORDERS):
            fails = [k + 1 for k, c in enumerate(order) if mask >> filter_audit.FILTERS.index(c) & 1]
            assert steps.get(rank) == (fails[0] if fails else None)
    assert filter_audit.ORDERS == sorted("".join(p) for p in permutations("ABCDE"))


def audited(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = t.encode().split()
        fails = set()
        fails |= {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and first[t] < i else set()
        docs.append((s or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in filter_audit.ORDERS:
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                all_ = sum(f in d[1] for d in mine)
                out[part, order, step] = [len(left), len(gone), all_ - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for f in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == f:
                    v.append(total)
    return sorted((*k, *v) for k, v in out.items())


def test_audit_of_odd_rows(spark, odd, odd_rows):
    labels = [(1, 1, 0), (1, None, 1), (2, 0, 1), (6, 1, None), (7, 1, 1), (None, 1, 1), (8, None, None), (25, 1, 0), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    more = [(50, "A LOT of Capitals HERE " * 20, None, "a"), (51, "50 % of # " * 15, None, "a"), (52, "", None, "")]
    both = odd.unionByName(spark.createDataFrame([(*r, len(r[1])) for r in more], DOCS), allowMissingColumns=True)
    got = sorted(tuple(r) for r in filter_audit.audit_filters(both, table).collect())
    assert got == audited([(i, t, s) for i, t, _, s, *_ in [*odd_rows, *more]], labels)


def test_audit_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(nothing, labels).count() == 0


# repeated passages


def cleaned(rows, window):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def repeats(df, **kw):
    rows = substrings.remove_repeats(df, **kw).collect()
    for r in rows:
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:])) and all(s["start"] < s["end"] for s in r["removed"])
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["text"]) for r in rows), key=str)


def passages(seed=1):
    """Documents that share passages of about a window's length at all offsets, in chains, twice in one text."""
    rng = random.Random(seed)
    shared = [random_text(rng, n).split() for n in (49, 50, 51, 60, 74, 99, 130)]
    rows = []
    for k in range(60):
        words = random_text(rng, rng.randrange(0, 90)).split()
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(0, 12)
            words += p[a if rng.random() < 0.4 else 0 :] + random_text(rng, rng.randrange(0, 30)).split()
        rows.append((rng.randrange(40) * 3, " ".join(words)))
    rows += [(-5, " ".join(shared[3] + shared[3])), (500, " \n".join(shared[3])), (None, " ".join(shared[5])), (501, None), (502, "  \x1c words"), (2**60, "a " * 300), (2**60 + 1, "a " * 200)]
    return rows


@pytest.mark.parametrize("kw", [{}, {"block_words": 700}, {"block_words": 700, "stage": True}])
def test_repeats_against_all_windows(spark, kw):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert repeats(df.coalesce(2), **kw) == cleaned(rows, 50)


def test_repeats_in_teams_of_blocks(spark, monkeypatch):
    """What asks more buckets than a block's rows go to."""
    monkeypatch.setattr(exchange, "WIRE_BUCKETS", 16)
    monkeypatch.setattr(exchange, "TEAM_BLOCKS", 2)
    rows = passages(2)
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), block_words=700) == cleaned(rows, 50)


def test_repeats_of_other_windows(spark):
    rows = passages(3)
    for window in (7, 20):
        assert repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), window=window) == cleaned(rows, window)


def test_repeats_of_odd_rows(spark, odd, odd_rows, nothing):
    assert repeats(odd) == cleaned([(r[0], r[1]) for r in odd_rows], 50)
    assert repeats(nothing) == []


def test_repeats_in_a_very_long_text(spark):
    """A text of some MB that holds another document's passage at both ends."""
    rng = random.Random(9)
    p = random_text(rng, 80)
    rows = [(1, p), (2, f"{p} {random_text(rng, 600_000, 10**6)} {p}")]
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r[1:3] for r in got] == [(80, 0), (600_160, 160)]
