"""LM scoring, WARC, SimHash, quality, language and main text against brute force and round trips."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lorehive.llm import html_text, interpolation, langid, quality, simhash, warc
from lorehive.llm.components import connected
from tests_llm_common import DOCS, random_text


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]


def remainder(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 5


def test_scores(spark, odd, odd_rows, nothing, monkeypatch):
    monkeypatch.setattr(interpolation, "BLOCK_TOKENS", 500)
    train = [tokens(r[1]) for r in odd_rows if remainder(r[0]) not in (None, 1)]
    counts = Counter(w for t in train for w in t)
    total, kinds = sum(counts.values()), len(counts)
    got = interpolation.score_texts(odd).collect()
    want = Counter((r[0], len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), remainder(r[0]) == 1, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(r[1])), 6)) for r in odd_rows)
    assert Counter((g["doc_id"], g["n_tokens"], g["n_known"], g["held_out"], round(g["base_score"], 6)) for g in got) == want
    assert {g["train_tokens"] for g in got} == {total} and all(g["score"] <= 0 for g in got)
    again = interpolation.score_texts(odd.repartition(3), stage=True).collect()
    assert len(again) == len(got)
    assert interpolation.score_texts(nothing).count() == 0


def test_model_is_a_distribution_and_beats_unigrams(spark):
    """Probabilities of all words (and one unknown) after a context sum to one."""
    rng = random.Random(17)
    text = lambda n: " ".join(f"{a} {b}" for a in (rng.choice("abcdefgh") for _ in range(n)) for b in [chr(ord(a) + 1) if rng.random() < 0.9 else "z"])
    rows = [(k, text(60), "en", "a", 0) for k in range(200)] + [(1000 + k, f"c {w}", "en", "a", 0) for k, w in enumerate("abcdefghiz?")]
    rows = [r for r in rows if r[0] < 1000 or remainder(r[0]) == 1] + [(5000 + k, f"c {w}", "en", "a", 0) for k, w in enumerate("abcdefghiz?")]
    got = {g["doc_id"]: g for g in interpolation.score_texts(spark.createDataFrame(rows, DOCS)).collect()}
    held = [g for k, g in got.items() if k < 200 and g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)


def test_weights_follow_the_held_out_counts():
    import pandas as pd

    cell = lambda context, level2, level1: (context * 1000 + level2) * 1000 + level1
    w = interpolation.fit_weights(pd.DataFrame({"cell": [cell(5, 1, 1), cell(3, 0, 8), cell(1, 0, 0)], "n": [100, 100, 100]}), 1000, 10_000)
    assert w[5, 0] > 0.99 and w[3, 1] > 0.9 and w[1, 2] > 0.99 and np.allclose(w.sum(axis=1), 1)


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_ROWS", 7)
    rows = [(k, f"http://{'ab'[k % 2]}.example.com/p{k % 5}", ["<p>x</p>", "", None, f"é{k}\r\n\r\nWARC/1.1\r\n\r\n", "same"][k % 5]) for k in range(40)]
    rows += [(None, None, "same"), (100, "bad\r\nurl: x", "only"), (101, "http://[", "same"), (101, "http://[", "same"), (None, "u", "lonely")]
    got = warc.capture_history(spark.createDataFrame(rows, PAGES).selectExpr("*", "url as digest", "html as record")).orderBy("shard", "position").collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    def want(i, h):
        data, top = (h or "").encode(), last[h or ""]
        response = top == -1 or i == top
        return (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top)
    assert Counter(tuple(g[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for g in got) == Counter(want(i, h) for i, _, h in rows)
    order = [(g["url_key"], g["captured"], g["page_id"] is not None, g["page_id"] or 0) for g in got]
    assert order == sorted(order) and len({g["shard"] for g in got}) > 3
    assert warc.capture_history(spark.createDataFrame([], PAGES)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8), max_size=9))
def test_loser_tree(runs):
    rows = [sorted((None, "", f"{x}", f"{k}") for x in run) for k, run in enumerate(runs)]
    assert [r[2:4] for r in warc.LoserTree(rows)] == sorted(r[2:4] for run in rows for r in run)


def brute_print(t):
    w = [x.decode() for x in tokens(t)[:-1]]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd, odd_rows, nothing, spark):
    got = simhash.simhash_digest(simhash.components(odd)).collect()
    prints = [brute_print(r[1]) for r in odd_rows]
    assert Counter((g["doc_id"], g["fingerprint"]) for g in got) == Counter((r[0], f"{p:016x}") for r, p in zip(odd_rows, prints))
    label = {p: p for p in prints}
    for _ in prints:
        for a in label:
            label[a] = min(label[b] for b in label if bin(a ^ b).count("1") <= 3)
    least = {}
    for r, p in zip(odd_rows, prints):
        if r[0] is not None:
            least[label[p]] = min(least.get(label[p], r[0]), r[0])
    assert {(g["doc_id"], g["fingerprint"]): g["component_id"] for g in got} == {(r[0], f"{p:016x}"): least.get(label[p]) for r, p in zip(odd_rows, prints)}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(label.values()))
    assert simhash.components(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


@pytest.mark.parametrize("limit", [4096, 8])
def test_near_links_lose_none(spark, limit):
    """Chains and balls of near fingerprints, also with buckets so small that they are split."""
    rng = random.Random(19)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)} | {0, 1, (1 << 64) - 1}
    prints = sorted(prints)
    v = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    label = np.arange(len(v))
    for _ in range(60):
        label = np.array([label[n].min() for n in near])
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    links = simhash.near_links(df, limit)
    pairs = {(r["a"], r["b"]) for r in connected(links).collect()}
    root = {a: b for a, b in pairs}
    groups = lambda keys: Counter(Counter(keys).values())
    got = [root.get(int(x), int(x)) for x in v.view(np.int64)]
    assert groups(got) == groups(label.tolist()) and len(set(zip(got, label.tolist()))) == len(set(label.tolist()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 50)] + [(7, 7)]
    got = {r["a"]: r["b"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(101, 141)} | {k: 0 for k in range(1, 50)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t é#$<\x0b\x1c", max_size=80))
def test_text_stats(t):
    assert quality.text_stats(t) == brute_stats(t)


def test_quality(spark, odd, odd_rows, nothing):
    got = quality.judge(odd).collect()
    assert Counter((g["doc_id"], *[g[c] for c in quality.STATS]) for g in got) == Counter((r[0], *brute_stats(r[1])) for r in odd_rows)
    for g in got:
        assert g["base_failed"] == (g["n_words"] < 50 or 100 * g["n_repeat_words"] > 50 * g["n_words"]) and not (g["base_failed"] and g["kept"])
    assert quality.judge(nothing).count() == 0
    rng = random.Random(23)
    clean = [(k, random_text(rng, rng.randrange(60, 900)), "en", "ab"[k % 2], 0) for k in range(300)]
    junk = [(1000 + k, " ".join(w + "###" for w in random_text(rng, 200).split()), "en", "ab"[k % 2], 0) for k in range(60)]
    kept = {g["doc_id"]: g["kept"] for g in quality.judge(spark.createDataFrame(clean + junk, DOCS)).collect()}
    assert all(kept[r[0]] for r in clean) and not any(kept[r[0]] for r in junk)


def test_quality_rejects_by_repetition_alone(spark):
    """Repeated lines, and a repeated phrase within one line, under the base rule's half of the words."""
    rng = random.Random(41)
    lines = lambda n: [random_text(rng, 10) for _ in range(n)]
    mix = lambda parts, sep: sep.join(rng.sample(parts, len(parts)))
    clean = [(k, mix(lines(rng.randrange(6, 60)), "\n"), "en", "a", 0) for k in range(200)]
    junk = [mix(lines(1) * 9 + lines(11), "\n") for _ in range(4)]  # 45 of 100 words, 4 lines per hundred
    junk += [mix(lines(1) * 9 + lines(11), " ") for _ in range(4)]  # the same words, no line twice
    junk += [mix(["w1 w2"] * 11 + lines(18), "\n") for _ in range(4)]  # 11 of 100 words, 5 lines per hundred
    rows = clean + [(1000 + k, t, "en", "a", 0) for k, t in enumerate(junk)]
    got = quality.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert not any(g["base_failed"] for g in got)
    assert {g["doc_id"] for g in got if not g["kept"]} == {1000 + k for k in range(len(junk))}


def test_languages(spark, odd, nothing):
    rng = random.Random(29)
    alphabets = {"aa": "abcde", "bb": "efghi", "cc": "mnopq"}
    say = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(n))
    rows = [(k, say(lang := rng.choice(list(alphabets)), 40), lang, "s", 0) for k in range(400)]
    rows += [(1001, say("aa", 60) + " " + say("bb", 30), "aa", "s", 0), (1002, None, "aa", "s", 0), (1003, "123 !?", "aa", "s", 0), (1004, "", None, "s", 0), (None, say("cc", 20), "cc", None, 0)]
    got = {g["doc_id"]: g for g in langid.language_of(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows[:400] if got[r[0]]["held_out"]) and sum(got[r[0]]["held_out"] for r in rows[:400]) > 40
    assert got[1001]["langs"] == ["aa", "bb"] and abs(got[1001]["score"] - 2 / 3) < 0.08
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (1002, 1003, 1004))
    assert all(got[k]["held_out"] == (remainder(k) == 0) for k in got) and got[None]["lang_pred"] == "cc" and not got[None]["held_out"]
    assert langid.language_of(odd).columns == ["doc_id", "held_out", "lang_pred", "score", "langs"] and langid.language_of(odd).count() == odd.count()
    assert langid.language_of(nothing).count() == 0 and langid.keep_identified(odd).columns == odd.columns
    kept = {r["doc_id"] for r in langid.keep_identified(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {r[0] for r in rows} - {1002, 1003, 1004}


def page(main, attrs="", tag="article"):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class=ad>Buy this now.</div><{tag}{attrs}>{main}</{tag}><div id=comments><p>Nice one, thanks.</p></div><footer>All rights kept.</footer><script>var x='<p>no</p>'</script></body></html>"


def test_main_text(spark, sf_dir):
    rng = random.Random(31)
    own = [(k, f"u{k}", page(f"<h1>{random_text(rng, 5)}</h1>" + "".join(f"<p>{random_text(rng, 40)}." for _ in range(4)))) for k in range(60)]
    odd = [(100, None, None), (101, "u", ""), (102, "u", "<p>unclosed <b>bold"), (None, "u", own[0][2]), (0, "u0", own[0][2]), (103, "u", page("<h1>A &amp; B</h1><p>First&nbsp;part,\n of the&#33; text goes on. " + "More words follow, as they do. " * 5 + "<p><b>Second</b> part<br>ends.", " class=content", "div"))]
    got = html_text.extract(spark.createDataFrame(own + odd, PAGES).selectExpr("*", "html as text")).collect()
    assert len(got) == len(own) + len(odd)
    by = {g["page_id"]: g["text"] for g in got if g["page_id"] != 0}
    for k, _, h in own[1:]:
        assert by[k] == "\n".join(" ".join(x.split()) for x in re.findall(r"<h1>(.*?)</h1>", h) + re.findall(r"<p>(w[^<]*)", h))
    assert by[100] == by[101] == ""
    assert by[103] == "A & B\nFirst part, of the! text goes on. " + " ".join(["More words follow, as they do."] * 5) + "\nSecond part ends."
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.floats(-3, 3)), min_size=1, max_size=9))
def test_decoding_is_best_and_consistent(nodes):
    parent = np.array([-1] + [p % k for k, (p, _) in enumerate(nodes[1:], 1)])
    odds = np.array([o for _, o in nodes])
    depth = np.zeros(len(nodes), dtype=int)
    for k in range(1, len(nodes)):
        depth[k] = depth[parent[k]] + 1
    inner = lambda y: sum(bool(y[k]) for k in range(1, len(nodes)))  # noqa: E731  only within content
    value = lambda y: float(np.where(y, -np.logaddexp(0, -odds), -np.logaddexp(0, odds)).sum() + html_text.COHERENCE * inner(y))
    all_y = [np.array([m >> k & 1 for k in range(len(nodes))], dtype=bool) for m in range(2 ** len(nodes))]
    fine = [y for y in all_y if all(not y[k] or y[parent[k]] for k in range(1, len(nodes)))]
    got = html_text.decode(odds, parent, depth)
    assert any((got == y).all() for y in fine) and abs(value(got) - max(map(value, fine))) < 1e-9
