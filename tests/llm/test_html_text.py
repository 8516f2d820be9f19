"""Main text without article elements, with broken markup, of very long pages, and of unseen layouts."""

import random

import numpy as np
import pandas as pd
import pytest

from lorehive.llm import html_text
from tests_llm_common import random_text

PAGES = "page_id long, url string, html string"


def said(rng, n):
    return random_text(rng, n).capitalize() + "."


def marked(rng):
    body = "".join(f"<p>{said(rng, rng.randrange(15, 60))}</p>" for _ in range(5))
    return f"<html><body><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><div class=ad>{said(rng, 8)}</div><article><h1>{said(rng, 5)}</h1>{body}</article><div id=comments><p>{said(rng, 9)}</p></div><footer>{said(rng, 6)}</footer></body></html>"


def plain(rng):
    """A page without article or main, and what it should give."""
    head, body = said(rng, 5), [said(rng, rng.randrange(15, 60)) for _ in range(5)]
    html = f"<html><body><div class=menu><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></div><div class=\"content\"><h1>{head}</h1>{''.join(f'<p>{x}</p>' for x in body)}</div><div class=sidebar><ul><li><a href=/q>{said(rng, 3)}</a></ul></div><div id=comments><p>{said(rng, 9)}</p></div><div class=footer>{said(rng, 6)}</div></body></html>"
    return html, "\n".join([head, *body])


def test_pages_without_labels(spark):
    """No page marks its main text: what the trees are trained on is said, and menus, sidebars,
    comments and footers go all the same."""
    rng = random.Random(1)
    pages = [plain(rng) for _ in range(50)]
    df = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(pages)], PAGES)
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert {r["labels"] for r in got.values()} == {"layouts"}
    assert sum(got[k]["text"] == text for k, (_, text) in enumerate(pages)) >= 48
    blank = html_text.extract(spark.createDataFrame([(1, None, None), (2, "u", "<script>x</script>")], PAGES)).collect()
    assert [(r["text"], r["labels"]) for r in blank] == [("", "none")] * 2


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return html_text.train([marked(rng) for _ in range(120)])[0]


def test_trained_on_marked_pages_and_used_on_plain_ones(model):
    rng = random.Random(3)
    pages = [plain(rng) for _ in range(80)]
    got = html_text.main_texts([h for h, _ in pages], model)
    assert sum(g == text for g, (_, text) in zip(got, pages)) >= 76


@pytest.mark.parametrize("broken", ["<button>x", "<select><option>x", "<svg><path>", "<svg><svg><g>", "<object>x", "<noscript>x", "<canvas>x", "<button>x<select>y", "<svg>x<object>y<svg>z"])
def test_unclosed_elements_end_at_the_next_block(model, broken):
    rng = random.Random(4)
    one, two, last = said(rng, 30), said(rng, 30), said(rng, 30)
    html = marked(rng)
    start, end = html.index("<article>") + 9, html.index("</article>")
    got = html_text.main_texts([f"{html[:start]}<p>{one}</p>{broken}<p>{two}</p><p>{last}</p>{html[end:]}"], model)[0]
    assert got == "\n".join([one, two, last])


def test_closed_elements_leave_with_all_they_hold(model):
    rng = random.Random(5)
    one, two = said(rng, 30), said(rng, 30)
    inner = "<button><div><p>" + said(rng, 20) + "</p></div></button><noscript><p>" + said(rng, 20) + "</p></noscript><svg><g><svg><text>a</text></svg><text>b</text></g></svg><select><option>x<option>y</select><template><p>t</p></template><textarea><p>z</p></textarea>"
    html = marked(rng)
    start, end = html.index("<article>") + 9, html.index("</article>")
    assert html_text.main_texts([f"{html[:start]}<p>{one}</p>{inner}<p>{two}</p><script>if (a < b) x('</p>')</script>{html[end:]}"], model)[0] == f"{one}\n{two}"


def test_very_long_page(model):
    """Every one of 30,000 paragraphs, and none of as many unclosed buttons."""
    rng = random.Random(6)
    html = marked(rng)
    start, end = html.index("<article>") + 9, html.index("</article>")
    texts = [f"Paragraph {k} says that {said(rng, 12)}" for k in range(30_000)]
    body = "".join(f"<p>{t}</p><button>b<svg>" for t in texts)
    got = html_text.main_texts([html[:start] + body + html[end:]], model)[0].split("\n")
    assert got == texts


def test_unseen_layouts(model):
    """Precision and recall of leaves over layouts drawn from another seed than those trained on."""
    rng, draw = random.Random(7), np.random.default_rng(99)
    names = html_text.Names(draw)
    hit = found = there = 0
    for _ in range(150):
        content = [(html_text.GROUP["h1"], said(rng, 5)), *[(html_text.GROUP["p"], said(rng, rng.randrange(15, 60))) for _ in range(6)]]
        dom = html_text.Dom()
        dom.add(html_text._layout(content, [said(rng, 8) for _ in range(8)], draw, names))
        x, parent, depth = html_text.features(dom, model.evidence)
        leaf, good = np.array(dom.leaf, dtype=bool), np.array(dom.mark, dtype=bool)
        got = html_text.decode(model.trees.log_odds(x), parent, depth) & leaf
        hit, found, there = hit + (got & good).sum(), found + got.sum(), there + (good & leaf).sum()
    print(f"precision {hit / found:.4f}, recall {hit / there:.4f}")
    assert hit / found > 0.93 and hit / there > 0.93


def test_no_feature_names_the_labels():
    """An article element and a div give the same features."""
    one, two = html_text.Dom(), html_text.Dom()
    one.add("<article class=x><p>a</p></article>")
    two.add("<div class=x><p>a</p></div>")
    words = np.linspace(-1, 1, html_text.FLAGS)
    assert (html_text.features(one, words)[0] == html_text.features(two, words)[0]).all()


def test_clashing_names(spark):
    rng = random.Random(8)
    rows = pd.DataFrame({"page_id": range(5), "url": ["u"] * 5, "html": [marked(rng) for _ in range(5)]})
    df = spark.createDataFrame(rows)
    for name in ("text", "h", "labels", "model"):
        df = df.withColumn(name, df["url"])
    assert html_text.extract(df).columns == ["page_id", "url", "text", "labels"] and html_text.extract(df).count() == 5
