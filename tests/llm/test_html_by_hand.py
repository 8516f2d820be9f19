"""Pages written by hand, in layouts and with names that no training page or generator has."""

import numpy as np
import pandas as pd
import pytest

from lorehive.llm import html_text

P = [
    "The old swing bridge over the harbour mouth opened to traffic again on Monday after eleven months of repairs.",
    "Engineers replaced the bearings, most of the timber deck and both of the electric motors that turn the span.",
    "Ferry crews, who had carried commuters across the water all winter, said they were glad of the rest.",
    "The council paid for two thirds of the work; the rest came from a fund that the port set up in the nineties.",
    "Lorries of more than twenty tonnes must still go round by the motorway until the approach road is widened.",
    "A small crowd waved flags as the first bus rolled over at a quarter past seven, a little late as ever.",
    "Tides at the mouth run at up to four knots, which is why the span may only be turned at slack water.",
    "Visitors can watch the machinery from a gallery in the north tower, which is open at weekends in summer.",
]
R = ["I walked over it yesterday and it still rattles like it always did.", "Lovely to have it back, my bus takes half the time now.", "What about the cyclists, were they simply forgotten again?"]


def paras(*k, tag="p"):
    return "".join(f"<{tag}>{P[i]}</{tag}>" for i in k)


def page(body):
    return f"<!doctype html><html><head><title>Harbour Post</title></head><body>{body}</body></html>"


def thread(tag="div", hold='<section id="kommentare">', end="</section>"):
    who = ["Anna K.", "old_salt", "M. Reed"]
    return hold + "".join(f'<{tag}><b>{w}</b> <time>{d} May 2024</time><p>{r}</p></{tag}>' for w, d, r in zip(who, (3, 4, 4), R)) + end


LAYOUTS = {
    "header in the article": (page(f"<nav><a href=/>Start</a> <a href=/s>Sport</a></nav><article><header><h1>Bridge opens</h1><p>By A. Writer</p></header>{paras(0, 1, 2, 3)}</article><footer>Harbour Post Ltd</footer>"), ["Bridge opens", "By A. Writer", *P[:4]]),
    "sections whose names sound like asides": (page(f'<div class="oberleiste"><ul><li><a href=/>Start</a></li><li><a href=/k>Kultur</a></li></ul></div><div class="text"><h1>Bridge opens</h1>{paras(0, 1)}<section id="related-work"><h2>Earlier repairs</h2>{paras(2, 3)}</section><div class="side-effects">{paras(4, 5)}</div><p class="header-note">{P[6]}</p></div><div class="unten">Impressum | Harbour Post</div>'), ["Bridge opens", P[0], P[1], "Earlier repairs", P[2], P[3], P[4], P[5], P[6]]),
    "formulas": (page(f"<nav><ul><li><a href=/>Start</a></li><li><a href=/m>Maths</a></li></ul></nav><article><h1>Forces</h1>{paras(0, 1)}<p>The load is <math><mi>F</mi> <mo>=</mo> <mn>9</mn></math> where the span is long, and it falls as the tide comes in.</p>{paras(2)}</article><footer>Harbour Post</footer>"), ["Forces", P[0], P[1], "The load is F = 9 where the span is long, and it falls as the tide comes in.", P[2]]),
    "comments below, under another name": (page(f'<header><a href=/>Harbour Post</a></header><div id="beitrag"><h1>Bridge opens</h1>{paras(0, 1, 2, 3, 4)}</div>{thread("div", "<div class=opinions>", "</div>")}<div class="fuss">Kontakt | Datenschutz</div>'), ["Bridge opens", *P[:5]]),
    "comments in the article": (page(f"<nav><a href=/>Start</a><a href=/s>Sport</a></nav><article><h1>Bridge opens</h1>{paras(0, 1, 2, 3, 4, 5)}{thread()}</article><footer>Harbour Post</footer>"), ["Bridge opens", *P[:6]]),
    "comments as a list": (page(f'<div class="kopf"><a href=/>Harbour Post</a></div><div class="blatt"><h1>Bridge opens</h1>{paras(0, 1, 2, 3)}</div>{thread("li", "<ol class=stimmen>", "</ol>")}'), ["Bridge opens", *P[:4]]),
    "columns": (page(f'<div class="zeile"><div class="links"><h3>Mehr</h3><ul><li><a href=/1>Fischmarkt</a></li><li><a href=/2>Leuchtturm</a></li><li><a href=/3>Werft</a></li></ul></div><div class="mitte"><h1>Bridge opens</h1>{paras(0, 1, 2, 3, 4)}</div><div class="rechts"><p><a href=/abo>Jetzt lesen</a></p></div></div>'), ["Bridge opens", *P[:5]]),
    "lists, tables and pictures": (page(f"<nav><ul><li><a href=/>Start</a></li><li><a href=/s>Sport</a></li></ul></nav><main><h1>Bridge opens</h1>{paras(0, 1)}<figure><img src=x><figcaption>The span at slack water.</figcaption></figure><ul><li>{P[2]}</li><li>{P[3]}</li></ul><table><tr><td>Length of the span</td><td>61 metres</td></tr></table>{paras(4)}</main><footer>Harbour Post</footer>"), ["Bridge opens", P[0], P[1], "The span at slack water.", P[2], P[3], "Length of the span", "61 metres", P[4]]),
    "a notice and a form": (page(f'<div id="hinweis"><p>We store small files on your device. <a href=/c>More</a></p><button>Fine</button></div><div class="seite"><h1>Bridge opens</h1>{paras(0, 1, 2)}<form action=/n><p>Get our letter every Friday.</p><input name=mail></form>{paras(3, 4)}</div><div class="fuss"><ul><li><a href=/i>Impressum</a></li><li><a href=/d>Datenschutz</a></li></ul></div>'), ["Bridge opens", *P[:5]]),
    "sections with headings": (page(f'<div class="kopf"><ul><li><a href=/>Start</a></li><li><a href=/s>Sport</a></li></ul></div><div class="blatt"><h1>Bridge opens</h1><section class="teil"><h2>The work</h2>{paras(0, 1)}</section><section class="teil"><h2>The money</h2>{paras(2, 3)}</section><section class="teil"><h2>The tides</h2>{paras(6, 7)}</section></div><div class="fuss">Harbour Post Ltd</div>'), ["Bridge opens", "The work", P[0], P[1], "The money", P[2], P[3], "The tides", P[6], P[7]]),
}


@pytest.fixture(scope="module")
def model():
    """Trained on given pages, which share one template: a menu, a div of class ad, an article, a footer."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"]
    return html_text.train(list(pages[:200]))[0]


def found(model, html, want):
    got = html_text.main_texts([html], model)[0].split("\n")
    return got, len(set(got) & set(want)), [x for x in got if x not in want], [x for x in want if x not in got]


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(model, name):
    html, want = LAYOUTS[name]
    got, _, extra, lost = found(model, html, want)
    assert not lost and not extra, (extra, lost)
    assert got == want


def test_precision_and_recall(model):
    hit = there = said = 0
    for html, want in LAYOUTS.values():
        got, same, *_ = found(model, html, want)
        hit, there, said = hit + same, there + len(want), said + len(got)
    print(f"precision {hit / said:.3f}, recall {hit / there:.3f}")
    assert hit / said >= 0.95 and hit / there >= 0.95


def test_names_alone_decide_nothing_that_pages_did_not_teach(model):
    """Words of attributes that training pages don't have say nothing."""
    taught = set(html_text._bits(html_text._named("ad")))
    assert set(np.flatnonzero(np.abs(model.evidence) > 1e-9).tolist()) == taught
