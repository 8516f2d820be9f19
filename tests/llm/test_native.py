"""Secret scans, decontamination, mixing and chat formatting against brute force."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lorehive.llm import chat, decontaminate, mixing, secret_scan
from tests_llm_common import DOCS, random_text

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def text_of(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


LIVE = "Ab3dEf6hIj9kLm2nOp5qRs8tUv"
COPIED = "Zy9xWv6uTs3rQp0oNm7lKj4iHg"


def secret_rows():
    hexes = "0123456789abcdef" * 2
    texts = [
        'PassWord : "hunter2hunter2" x', "token=secret: abcdefghij", "api_key=short token==abcdefgh.ijk", f"ü\U0001f600 {hexes} AKIA{'A1' * 8} AKIAAKIA1234", "AKIA" + "B" * 11, hexes[:31], f"see {LIVE} here {LIVE}",
        f"sample {COPIED}", f"secret = {hexes} {hexes}f", None, "", "x " * 3000 + f"passwd='{LIVE}'",
    ]
    rows = [(k, t, "en", "o1", 0) for k, t in enumerate(texts)]
    return rows + [(100 + k, f"example {COPIED}", "en", f"o{k}", 0) for k in range(4)] + [(0, texts[0], "en", "o1", 0), (None, texts[0], None, None, None)]


def test_secret_spans(spark):
    rng = random.Random(5)
    pieces = ["token", "SECRET", "=", ":", " ", '"', "abc", "0123456789abcdef", "AKIA", "ABCD1234EFGH", "é", "-", "api_key", "deadbeef" * 4]
    rows = secret_rows() + [(1000 + k, "".join(rng.choice(pieces) for _ in range(30)), "en", "r", 0) for k in range(200)]
    got = secret_scan.secret_digest(secret_scan.scan_secrets(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], hashlib.sha256(text_of(base_spans(r[1])).encode()).hexdigest()) for r in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[0][c] for c in ("n_assign", "n_access", "n_hex")] == [1, 0, 0]
    start = len("see ")
    assert by_id[6]["spans"] == f"live:{start}:{start + len(LIVE)},live:{start + len(LIVE) + 6}:{start + 2 * len(LIVE) + 6}"
    assert by_id[7]["spans"] == "" and by_id[7]["n_copied"] == 1 and by_id[100]["n_live"] == 0


def test_redaction(spark, odd, nothing):
    df = spark.createDataFrame(secret_rows(), DOCS)
    got = {r["doc_id"]: r for r in secret_scan.redact_live(df).collect()}
    assert got[6]["text"] == "see [SECRET] here [SECRET]" and got[6]["n_chars"] == len(got[6]["text"])
    assert got[7]["text"] == f"sample {COPIED}" and got[9]["text"] is None
    same = secret_scan.redact_live(odd)
    assert same.columns == odd.columns and same.exceptAll(odd).count() == 0 and same.count() == odd.count()
    assert secret_scan.redact_live(nothing).count() == 0 and secret_scan.scan_secrets(nothing).count() == 0
    assert secret_scan.scan_secrets(odd).count() == odd.count()


def test_owners_and_repositories_both_decide(spark):
    """A credential in two sources is no example; one in every language part of one source is."""
    two, wide, many = "Qw4eRt5yUi6oPa7sDf8gHj9kLz", "Mn1bVc2xZa3sDf4gHj5kLp6oIu", "Tg7hYj8kUl9zIx0cOv1bPn2mAs"
    texts = [(0, two, "en", "a"), (1, two, "en", "b"), *[(10 + k, wide, lang, "a") for k, lang in enumerate(("en", "de", "fr", "es"))], *[(20 + k, many, "en", "a") for k in range(9)]]
    df = spark.createDataFrame([(k, f"see {v} here", lang, source, 0) for k, v, lang, source in texts], DOCS)
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact_live(df).collect()}
    want = {k: f"see {v} here" if v == wide else "see [SECRET] here" for k, v, _, _ in texts}
    assert got == want
    counts = {r["doc_id"]: [tuple(c[x] for x in ("owners", "repos", "n")) for c in r["counts"]] for r in secret_scan.scan_secrets(df).collect()}
    assert (counts[0], counts[10], counts[20]) == ([(2, 2, 2)], [(1, 4, 4)], [(1, 1, 9)])
    digest = {r["doc_id"]: (r["spans"], r["n_live"], r["n_copied"]) for r in secret_scan.secret_digest(secret_scan.scan_secrets(df)).collect()}
    assert digest == {k: ("", 0, 1) if v == wide else (f"live:4:{4 + len(v)}", 1, 0) for k, v, _, _ in texts}


def test_ownership_of_planted_runs(spark):
    """Runs without a keyword in a random number of sources and languages: spans are those of few."""
    rng = random.Random(9)
    rows, where = [], defaultdict(set)
    values = ["".join(rng.choice("abcdefghABCDEFGH0123456789") for _ in range(30)) + "aB1" for _ in range(40)]
    for k, v in enumerate(values):
        for _ in range(rng.randrange(1, 9)):
            place = (rng.choice(["o1", "o2", None] if k % 2 else ["o1"]), rng.choice(["en", "de", "fr", None, "es"]))
            where[v].add(place)
            rows.append((len(rows), f"see {v} here", place[1], place[0], 0))
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_digest(secret_scan.scan_secrets(spark.createDataFrame(rows, DOCS))).collect()}
    few = {v: len({o for o, _ in p}) < 3 and len(p) < 4 for v, p in where.items()}
    assert len(set(few.values())) == 2
    assert got == {i: "live:4:37" if few[t.split()[1]] else "" for i, t, *_ in rows}


def brute_overlaps(docs, items):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for d, text in docs:
        a = tok(text)
        for i, item in items:
            b = tok(item)
            n = min(13, len(b))
            if len(b) < 8:
                continue
            for diag in range(-len(b), len(a)):
                hit = [0 <= diag + k < len(a) and a[diag + k] == b[k] for k in range(len(b))]
                if any(10 * sum(hit[s : s + n]) >= 8 * n for s in range(len(b) - n + 1)):
                    found.add((d, i))
                    break
    return found


def test_decontamination_against_brute_force(spark, odd, nothing):
    rng = random.Random(7)
    items = [(k, random_text(rng, n)) for k, n in enumerate([8, 12, 25, 25, 40, 7, 60])] + [(50, None), (51, "")]
    docs = []
    for k in range(60):
        words = random_text(rng, 80).split()
        part = (items[k % 7][1]).split()
        if k % 3 == 0:
            for _ in range(len(part) * (k % 5) // 20):
                part[rng.randrange(len(part))] = "other"
        if k % 3 < 2:
            words[10:10] = [w.upper() + "," for w in part[: len(part) if k % 2 else 22]]
        docs.append((k, " ".join(words), "en", "a", 0))
    docs.append((0, docs[0][1], "en", "a", 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    want = brute_overlaps([(d[0], d[1]) for d in docs], items)
    for most in (500_000, 30):  # also in blocks of items
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(df, bench, max_seeds=most).collect()}
        assert got == want and len(want) > 20
    exact = {(k, k % 7) for k in range(60) if k % 3 == 1 and k % 7 != 5 and k % 2}
    assert exact <= got
    kept = decontaminate.decontaminate(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == {d[0] for d in docs} - {d for d, _ in got} and kept.columns == df.columns
    assert decontaminate.decontaminate(odd, bench).count() == odd.count()
    assert decontaminate.decontaminate(nothing, bench).count() == 0 and decontaminate.find_overlaps(odd, bench.filter("false")).count() == 0


def test_short_items_where_they_are_asked_for(spark):
    items = [(1, "alpha beta gamma delta epsilon"), (2, "one two three four five six seven"), (3, "too short here now")]
    docs = [(1, "x alpha beta gamma delta epsilon y"), (2, "x alpha beta other delta epsilon y"), (3, "so One, two; three four five six seven!"), (4, "too short here now"), (5, "alpha beta gamma")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_overlaps(df, bench).count() == 0
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(df, bench, least_tokens=5).collect()}
    assert got == {(1, 1), (2, 1), (3, 2)}


def test_common_passage_in_many_documents(spark):
    item = " ".join(f"term{k}" for k in range(30))
    df = spark.range(500).selectExpr("id doc_id", f"concat('start ', id, ' ', '{item}') text")
    got = decontaminate.find_overlaps(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert len(got) == 500 and all(r["n_seeds"] == 3 and r["similarity"] == 1.0 for r in got)


def water(sizes, weights=(3, 1, 2), budget=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_, left, target = set(names), budget * sum(sizes.values()), {}
    while open_:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] > cap * sizes[s]}
        if not full:
            return target | {s: share * w[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check_mix(rows, got):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r[0], n(r[1]), r[3]) for r in rows) == Counter((g["doc_id"], g["size"], g["source"]) for g in got)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += n(r[1])
    target, taken, largest = water(sizes), Counter(), Counter()
    for g in got:
        assert 0 <= g["taken"] <= 2 * g["size"] and g["source_size"] == sizes[g["source"]] and abs(g["target"] - target[g["source"]]) < 1e-6
        taken[g["source"]] += g["taken"]
        largest[g["source"]] = max(largest[g["source"]], g["size"])
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1e-6 for s, t in target.items())


def test_mix(spark, odd, odd_rows, nothing):
    got = mixing.pareto_mix(odd).collect()
    check_mix(odd_rows, got)
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(mixing.pareto_mix(odd.repartition(7)).collect()) == key(got)
    assert mixing.pareto_mix(nothing).count() == 0
    rng = random.Random(11)
    rows = [(k, "w " * rng.choice([0, 1, 3, 50, 400]), "en", rng.choice(["a", "a", "a", "b", "B", None, "é"]), 0) for k in range(700)]
    check_mix(rows, mixing.pareto_mix(spark.createDataFrame(rows, DOCS)).collect())
    blank = [(k, None, "en", "a", 0) for k in range(3)]
    assert {(g["taken"], g["target"]) for g in mixing.pareto_mix(spark.createDataFrame(blank, DOCS)).collect()} == {(0, 0.0)}


def test_chat_round_trip(spark):
    rng = random.Random(13)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\\\", "\n", " ", "ok", "é\U0001f600", "[INST", "</s", "\\n", ""]
    rows = []
    for c in range(300):
        for turn in range(rng.randrange(1, 6)):
            text = None if rng.random() < 0.05 else "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "", None, "odd\nrole\\n", "<s>[INST]"]), text))
    rows += [(400, 0, "user", "twice"), (400, 0, "user", "twice"), (None, None, None, None), (401, 5, "assistant", "a" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "role as source", "text as formatted")
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.collect()}
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        talks[c].append((turn if turn is not None else -1, role or "", text or ""))
    digest = {r["conv_id"]: r for r in chat.chat_digest(out).collect()}
    for c, turns in talks.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, t) for _, r, t in turns]
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert digest[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert digest[c]["loss_chars"] == len(loss) and digest[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    plain = [c for c, turns in talks.items() if not any(re.search(r"</?s>|\[/?INST\]", r + t) for _, r, t in turns)]
    assert not any(got[c]["escaped"] for c in plain) and any(r["escaped"] for r in got.values())
    assert chat.format_conversations(df.filter("false")).count() == 0


def test_running_sums_and_maxima(spark):
    rng = random.Random(4)
    rows = [(k, [rng.randrange(-50, 50) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3, 4, 5, 8, 9, 10, 99, 100, 101, 1000])]
    df = spark.createDataFrame(rows, "k int, v array<int>")
    got = {r["k"]: (r["s"], r["m"]) for r in df.select("k", secret_scan.running(F.col("v"), lambda a, b: a + b).alias("s"), secret_scan.running(F.col("v"), F.greatest).alias("m")).collect()}
    assert got == {k: (list(itertools.accumulate(v)), list(itertools.accumulate(v, max))) for k, v in rows}


def test_runs_apart_from_base_spans(spark):
    rng = random.Random(6)

    def spans(n, kind):
        at, out = 0, []
        for _ in range(n):
            at += rng.randrange(0, 6)
            out.append((at, kind, at + rng.randrange(1, 9), f"v{at}"))
            at = out[-1][2]
        return out

    kind = "array<struct<start:int,kind:int,end:int,value:string>>"
    rows = [(k, spans(rng.randrange(0, 12), 3), spans(rng.randrange(0, 12), 0) + spans(rng.randrange(0, 5), 2)) for k in range(80)]
    got = spark.createDataFrame(rows, f"k int, runs {kind}, base {kind}").select("k", secret_scan.apart_from(F.col("runs"), F.col("base")).alias("x")).collect()
    assert {r["k"]: [tuple(x) for x in r["x"]] for r in got} == {k: [r for r in runs if not any(b[0] < r[2] and r[0] < b[2] for b in base)] for k, runs, base in rows}


def test_cutting_spans_out_of_pieces(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        text = "".join(rng.choice("aß\U0001f600 ") for _ in range(rng.randrange(1, 60)))
        spans = sorted((a, min(len(text), a + rng.randrange(1, 20))) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(1, 6))))
        rows.append((k, text, spans))
    want = {}
    for k, text, spans in rows:
        out, at = "", 0
        for a, b in spans:
            out += text[at:a] + "#" if a >= at else ""
            at = max(at, b)
        want[k] = out + text[at:]
    df = spark.createDataFrame(rows, "k int, text string, spans array<struct<start:int,end:int>>").repartition(2)
    for piece in (1, 3, 8, 64):
        assert {r["k"]: r["x"] for r in df.select("k", secret_scan.without(F.col("text"), F.col("spans"), "#", piece).alias("x")).collect()} == want


def test_a_text_of_some_megabytes_with_many_secrets(spark):
    """The time goes with the text, not with the square of its matches."""
    hexes = [hashlib.md5(str(k).encode()).hexdigest() for k in range(60_000)]
    text = " ".join(hexes)
    df = spark.createDataFrame([(1, text, "en", "a", len(text))], DOCS)
    began = time.monotonic()
    found = secret_scan.secret_digest(secret_scan.scan_secrets(df)).first()
    base = ",".join(f"hex:{33 * k}:{33 * k + 32}" for k in range(len(hexes)))
    assert (found["n_hex"], found["base_sha256"]) == (len(hexes), hashlib.sha256(base.encode()).hexdigest())
    new = secret_scan.redact_live(df).first()
    live = [any(c.isdigit() for c in h) and len(set(h)) >= 8 for h in hexes]
    assert new["text"] == " ".join("[SECRET]" if y else h for h, y in zip(hexes, live)) and new["n_chars"] == len(new["text"])
    assert time.monotonic() - began < 120
