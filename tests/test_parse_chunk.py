import random

from pyspark.sql import functions as F

from lorehive.operators import chunk as C
from lorehive.operators import parse as P


def blocks_of(spark, text):
    docs = spark.createDataFrame([("d", "my_policy-v2.txt", text)], "document_id string, filename string, text string")
    found = P.blocks(docs)
    return docs, found, [(r["level"], r["text"]) for r in found.orderBy("pos").collect()]


def test_markdown_switches_heuristics_off(spark):
    assert blocks_of(spark, "# Guide\n1. Install it\n2. Run it\n\nTEXT IN CAPITALS")[2] == [(1, "Guide"), (0, "1. Install it\n2. Run it"), (0, "TEXT IN CAPITALS")]


def test_plain_headings(spark):
    text = "1. PAY\nbody one\n\nmore\n2.1 Days off\n25 days per year plus holidays\nTitle\n=====\nx\nSub\n---\ny\nALL CAPS\nz."
    assert blocks_of(spark, text)[2] == [(1, "1. PAY"), (0, "body one"), (0, "more"), (2, "2.1 Days off"), (0, "25 days per year plus holidays"), (1, "Title"), (0, "x"), (2, "Sub"), (0, "y"), (2, "ALL CAPS"), (0, "z.")]


def test_titles_and_rejects(spark):
    docs, found, _ = blocks_of(spark, "just text")
    assert P.titles(docs, found).first()["title"] == "my policy v2"
    for text, reason in (("", "no_text"), ("\n \n", "no_text"), ("# Only", "headings_only")):
        docs, found, _ = blocks_of(spark, text)
        assert P.without_body(docs, found).first()["reason"] == reason


def test_heading_paths_are_a_stack(spark):
    rng, rows, want = random.Random(1), [], []
    for d in range(20):
        stack = []
        for pos in range(30):
            level = rng.randrange(7)
            rows.append((str(d), pos, f"t{pos}", level, None))
            if level:
                stack = [s for s in stack if s[0] < level] + [(level, f"t{pos}")]
            want.append((str(d), pos, " > ".join(["T", *[t for _, t in stack]]) if stack else "T"))
    blocks = spark.createDataFrame(rows, "document_id string, pos int, text string, level int, page int")
    titles = spark.createDataFrame([(str(d), "T") for d in range(20)], "document_id string, title string")
    got = C.heading_paths(blocks, titles).select("document_id", "pos", "heading_path").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def chunks_of(spark, text, target, overlap, least):
    docs, found, _ = blocks_of(spark, text)
    sections = C.sections(C.heading_paths(found, P.titles(docs, found)))
    return C.with_ids(C.chunks(C.units(sections, target), target, overlap, least)).orderBy("chunk_index").collect()


def test_long_section_overlaps_within_the_budget(spark):
    got = chunks_of(spark, "# T\n" + "\n\n".join(f"Sentence number {i} talks about topic {i}." for i in range(200)), 120, 40, 10)
    assert len(got) > 2 and all(r["token_count"] <= 156 for r in got)
    assert [r["chunk_index"] for r in got] == list(range(len(got)))
    for a, b in zip(got, got[1:]):
        assert b["text"].split("\n\n")[0] in a["text"]
    assert all(f"number {i} " in " ".join(r["text"] for r in got) for i in range(200))


def test_chunks_keep_to_top_sections(spark):
    text = "# Handbook\n## 1. Pay\n" + "Pay words here. " * 20 + "\n## 2. Leave\n### 2.1 Days\nFew words.\n### 2.2 Sick\nSome words.\n## 3. Travel\n" + "Trip words. " * 20
    got = chunks_of(spark, text, 200, 30, 40)
    tops = [{s for s in ("Pay words", "Few words", "Some words", "Trip words") if s in r["text"]} for r in got]
    assert {"Few words", "Some words"} in tops and all(r["heading_path"].startswith("Handbook") for r in got)
    assert not any({"Pay words", "Trip words"} <= t for t in tops)


def test_fill_cuts_oversized_units_apart():
    assert C.fill([("a", 5), ("b", 5), ("c", 3)], 10, 3) == [(["a", "b"], 10), (["c"], 3)]
    assert C.fill([("a", 6), ("b", 2), ("c", 6)], 10, 2) == [(["a", "b"], 8), (["b", "c"], 8)]
    assert C.fill([("a", 8), ("b", 2)], 10, 2) == [(["a", "b"], 10)]  # a rest that only overlaps is left out


def test_hard_cut_keeps_all_tokens(spark):
    words = " ".join(f"w{i}" for i in range(950))
    got = chunks_of(spark, words, 200, 0, 10)
    assert " ".join(r["text"].replace("\n\n", " ") for r in got).split() == words.split()


def test_layout(spark):
    words = [("d", 1, 0.0, 1.0, "Big", 20.0), ("d", 1, 0.2, 9.0, "Title", 20.0)] + [("d", 1, 10.0 + 4 * k, 0.0, f"line{k}", 10.0) for k in range(5)] + [("d", 2, 0.0, 0.0, "tail", 0.0)]
    lines = P.layout_lines(spark.createDataFrame(words, "document_id string, page int, top double, x0 double, text string, size double"))
    assert {(r["page"], r["line"], r["size"]) for r in lines.collect()} >= {(1, "Big Title", 20.0), (2, "tail", 1.0)}
    got = [(r["level"], r["page"], r["text"]) for r in P.layout_blocks(lines).orderBy("pos").collect()]
    assert got == [(1, 1, "Big Title"), (0, 1, "line0 line1 line2 line3 line4 tail")]


def test_flat_text(spark):
    _, found, _ = blocks_of(spark, "a\n\nb")
    assert P.flat_text(found).first()["text"] == "a\n\nb"
    assert P.flat_text(found).select(F.col("char_count")).first()[0] == 4


def pack_by_hand(units, target, overlap, least):
    """A second packer, written from the rules alone: units(section, path, page, text, tokens) of a
    document to (text, path, page, tokens) of its chunks."""
    found = []  # [texts, tokens, path parts, label, page, whole section]
    for section in sorted({u[0] for u in units}):
        mine = [u for u in units if u[0] == section]
        label, page = mine[0][1], mine[0][2]
        parts = [p.strip() for p in (label or "").split(">") if p.strip()]
        made, held = [], []  # held: units of the open chunk

        def close():
            made.append(([u[3] for u in held], sum(u[4] for u in held)))
            tail = []
            while len(tail) < len(held) and overlap > 0 and sum(u[4] for u in tail) + held[-1 - len(tail)][4] <= overlap:
                tail.insert(0, held[-1 - len(tail)])
            held[:] = tail

        for u in mine:
            if held and sum(v[4] for v in held) + u[4] > target:
                close()
            held.append(u)
            if sum(v[4] for v in held) >= target:
                close()
        texts, size = [u[3] for u in held], sum(u[4] for u in held)
        if texts and not (made and "\n\n".join(texts) in "\n\n".join(made[-1][0])):
            made.append((texts, size))
        found += [[list(t), n, parts, label, page, len(made) == 1] for t, n in made]
    common = lambda a, b: [x for k, (x, y) in enumerate(zip(a, b)) if a[: k + 1] == b[: k + 1]]
    k = 1
    while k < len(found):  # whole sections of one parent
        a, b = found[k - 1], found[k]
        if a[5] and b[5] and a[1] + b[1] <= target and len(common(a[2], b[2])) >= 2:
            path = common(a[2], b[2])
            found[k - 1 : k + 1] = [[a[0] + b[0], a[1] + b[1], path, " > ".join(path), a[4], True]]
        else:
            k += 1
    k = 1
    while k < len(found):  # small ones into the sibling before
        a, b = found[k - 1], found[k]
        if b[1] < least and a[1] + b[1] <= target * 1.3 and len(common(a[2], b[2])) >= 2:
            path = common(a[2], b[2])
            found[k - 1 : k + 1] = [[a[0] + b[0], a[1] + b[1], path, " > ".join(path), a[4], a[5]]]
        else:
            k += 1
    if len(found) > 1 and found[0][1] < least and found[0][1] + found[1][1] <= target * 1.3:
        a, b = found[:2]
        if len(a[2]) < len(b[2]) and b[2][: len(a[2])] == a[2]:  # a small first one into what stands below it
            path = common(a[2], b[2])
            found[:2] = [[a[0] + b[0], a[1] + b[1], path, " > ".join(path) or b[3], b[4], b[5]]]
    return [("\n\n".join(t).strip(), label, page, n) for t, n, _, label, page, _ in found]


def test_packing_against_a_second_packer(spark):
    """Random structures and budgets: sections that fit together, runts, overlaps, a leading runt."""
    rng, rows, want = random.Random(8), [], {}
    paths = [None, "T", "T > A", "T > A > x", "T > A > y", "T > B", "T > B > z", "U > V > w"]
    for d in range(250):
        units, unit = [], 0
        for section in range(rng.randrange(1, 7)):
            path, page = rng.choice(paths), rng.choice([None, section])
            for _ in range(rng.choice([1, 1, 2, 6, 15])):
                unit += 1
                units.append((section, path, page, f"unit {d}-{unit}", rng.choice([1, 3, 8, 15, 25])))
                rows.append((f"{d}", section, path, page, unit, *units[-1][3:]))
        want[f"{d}"] = pack_by_hand(units, 30, 8, 10)
    df = spark.createDataFrame(rows, "document_id string, section int, heading_path string, page int, unit int, text string, tokens int")
    got = {}
    for r in C.chunks(df, 30, 8, 10).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append((r["text"], r["heading_path"], r["page"], r["token_count"]))
    assert got == want
