"""Main text of web pages: boosted trees over DOM nodes, and hierarchical decoding."""

from __future__ import annotations

import pickle
import re
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehive.llm.boosting import BoostedTrees

#: Pages that the classifier is trained on, and characters of each at most: bounds the sample. Layouts made of
#: their texts: three a page, more of each where pages are few.
TRAIN_PAGES, TRAIN_CHARS, LAYOUTS = 300, 200_000, 900

#: Elements without text of the page; those of NESTED may hold others of their kind.
SKIPPED = frozenset("script style title noscript template svg iframe object textarea select button canvas audio video".split())
NESTED = frozenset("svg object template audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GROUPS = ["h1 h2 h3 h4 h5 h6", "p", "li dt dd", "div", "section", "table tbody thead tfoot tr td th caption", "pre blockquote figure figcaption", "nav menu", "header hgroup", "footer address", "aside", "form fieldset legend", "article main", "ul ol dl", "html body center details summary dialog"]
GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags.split()}
INHERITED = [GROUP[t] for t in ("nav", "header", "footer", "aside", "form")]
#: Words of attributes are hashed to so many flags; a node has those of its ancestors too.
FLAGS = 1024
#: What a new element closes, up to the element that encloses a list or a table.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: A line that names an author or a date is no longer than this.
BRIEF = 80


@lru_cache(maxsize=50_000)
def _named(value: str) -> int:
    """The flags of an attribute's words, as bits."""
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    bits = 0
    for w in words:
        bits |= 1 << zlib.crc32(w.encode()) % FLAGS
    return bits


START, END, DATA = range(3)


class _Events(HTMLParser):
    """A page's tags and texts in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.found.append((START, tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SKIPPED:
            self.found.append((START, tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self.found.append((END, tag))

    def handle_data(self, data: str) -> None:
        self.found.append((DATA, data))


class Dom:
    """Block elements, and as leaves their runs of inline text, of all pages fed, in page order."""

    def __init__(self) -> None:
        self.page, self.parent, self.depth, self.group, self.leaf, self.named, self.own, self.marks, self.hidden, self.mark = [], [], [], [], [], [], [], [], [], []
        self.text, self.links = [], []
        self.pages = 0

    def add(self, html: str) -> None:
        reader = _Events()
        reader.feed(html)
        reader.close()
        self.events, self.ends = reader.found, {}
        self.open: list[tuple[str, int]] = []  # tag, and its node or -1 for inline elements
        self.inside, self.run, self.linked = 0, [], 0
        # in an element without text that nothing closes; the next block ends it
        self.loose = False
        self._node(GROUP["html"], 0, "", False, False, False)
        self.root = self.top = len(self.page) - 1
        k = 0
        while k < len(self.events):
            kind, said, *attrs = self.events[k]
            if kind == DATA:
                self._data(said)
            elif kind == END:
                self._end(said)
            elif said not in SKIPPED:
                self._start(said, attrs[0])
            elif (end := self._end_of(k)) is not None:
                k = end
            else:
                self.loose = True
            k += 1
        self._flush()
        self.events = []
        self.pages += 1

    def _end_of(self, k: int) -> int | None:
        """Where the skipped element ends that starts at k; None if nothing closes it before
        another of its kind starts (that can't be nested), an element around it ends, or the page."""
        if k in self.ends:
            return self.ends[k]
        tag, starts, within = self.events[k][1], [k], Counter()
        around = {t for t, node in self.open if node >= 0}
        for j in range(k + 1, len(self.events)):
            kind, name = self.events[j][:2]
            if kind == DATA:
                continue
            if name == tag:
                if kind == END:
                    self.ends[starts.pop()] = j
                    if not starts:
                        return j
                elif tag in NESTED:
                    starts.append(j)
                else:
                    break
            elif name in GROUP:
                if kind == START:
                    within[name] += 1
                elif within[name]:
                    within[name] -= 1
                elif name in around:
                    break
        for at in starts:
            self.ends[at] = None
        return None

    def _node(self, group: int, named: int, marks: str, hidden: bool, mark: bool, leaf: bool) -> None:
        top = -1 if not self.page or self.page[-1] != self.pages else self.top
        self.page.append(self.pages)
        self.parent.append(top)
        self.depth.append(0 if top < 0 else self.depth[top] + 1)
        self.group.append(group)
        self.leaf.append(leaf)
        self.named.append(named | (self.named[top] if top >= 0 else 0))
        self.own.append(named)
        self.marks.append(marks)
        self.hidden.append(hidden)
        self.mark.append(mark or (top >= 0 and self.mark[top]))
        self.text.append("")
        self.links.append(0)

    def _flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self._node(self.group[self.top], 0, "", False, False, True)
            self.text[-1], self.links[-1] = text, min(self.linked, len(text))
        self.run, self.linked = [], 0

    def _pop(self, to: int) -> None:
        """Closes all that is open from place to on."""
        for tag, node in reversed(self.open[to:]):
            if node >= 0:
                self._flush()
                self.top = self.parent[node]
            elif tag == "a":
                self.inside -= 1
        del self.open[to:]

    def _last(self, tags: frozenset[str], stop: frozenset[str]) -> int:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                return k
            if self.open[k][0] in stop:
                break
        return -1

    def _start(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br":
                self.run.append(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag not in GROUP:
            self.open.append((tag, -1))
            self.inside += tag == "a"
            return
        self.loose = False
        closed, stop = CLOSES.get(tag, (frozenset(), frozenset()))
        for tags, within in ((frozenset(("p",)), frozenset(("td", "th", "li", "div", "section", "article"))), (closed, stop)):
            if tags and (k := self._last(tags, within)) >= 0:
                self._pop(k)
        self._flush()
        named, hidden, mark = 0, False, False
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label") and value:
                named |= _named(value)
            elif name == "hidden" or name == "style" and value and "display:none" in value.replace(" ", ""):
                hidden = True
            elif name == "data-mark":
                mark = True
        self._node(GROUP[tag], named, tag if GROUP[tag] == GROUP["article"] else "", hidden, mark, False)
        self.top = len(self.page) - 1
        self.open.append((tag, self.top))

    def _end(self, tag: str) -> None:
        if (k := self._last(frozenset((tag,)), frozenset())) >= 0:
            self.loose = self.loose and self.open[k][1] < 0
            self._pop(k)

    def _data(self, data: str) -> None:
        if not self.loose:
            self.run.append(data)
            if self.inside:
                self.linked += len(data)


class Model(NamedTuple):
    """What attribute words say of main text, by flag (log odds), and the trees."""

    evidence: np.ndarray
    trees: BoostedTrees


def _learn_words(sets: list[tuple[Dom, np.ndarray]]) -> np.ndarray:
    """For each flag, how much more often leaves under it are content than leaves are: log odds,
    towards none where there are few. A page counts once for a flag, however many leaves it has there."""
    yes, no = np.zeros(FLAGS), np.zeros(FLAGS)
    good, bad = 1.0, 1.0
    for dom, label in sets:
        on_page: dict[int, list[bool]] = {}
        for k in np.flatnonzero(dom.leaf):
            for b in _bits(dom.named[k]):
                on_page.setdefault(b, []).append(bool(label[k]))
        for b, said in on_page.items():
            yes[b] += sum(said) / len(said)
            no[b] += 1 - sum(said) / len(said)
        share = label.sum() / max(1, sum(dom.leaf))
        good, bad = good + share, bad + 1 - share
    share = good / (good + bad)
    return np.clip(np.log((yes + 4 * share) / (no + 4 * (1 - share))) - np.log(good / bad), -4, 4)


@lru_cache(maxsize=50_000)
def _bits(mask: int) -> list[int]:
    found = []
    while mask:
        found.append((mask & -mask).bit_length() - 1)
        mask &= mask - 1
    return found


def _evidence(named: list[int], weights: np.ndarray) -> np.ndarray:
    """Least, greatest and total evidence of the words on each node and its ancestors."""
    known: dict[int, tuple[float, float, float]] = {0: (0.0, 0.0, 0.0)}
    for mask in named:
        if mask not in known:
            w = weights[_bits(mask)]
            known[mask] = (min(0.0, w.min()), max(0.0, w.max()), w.sum())
    return np.array([known[mask] for mask in named])


def features(dom: Dom, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes; their parents (-1: none) and depths.

    Article and main elements look like any div: pages name their main text by them when the trees
    are trained, so they are no feature. Sums run over whole levels.
    """
    page, parent, depth = np.array(dom.page), np.array(dom.parent), np.array(dom.depth)
    group, leaf = np.array(dom.group), np.array(dom.leaf, dtype=bool)
    group[group == GROUP["article"]] = GROUP["div"]
    chars = np.array([len(t) for t in dom.text], dtype=np.float64)
    marks = np.array([sum(map(t.count, ".,!?;")) for t in dom.text], dtype=np.float64)
    digits = np.array([sum(c.isdigit() for c in t[:BRIEF]) if len(t) <= BRIEF else 0 for t in dom.text], dtype=np.float64)
    dated = leaf & (chars <= BRIEF) & (digits > 0)
    own = np.stack([chars, np.array(dom.links, dtype=np.float64), marks, np.ones(len(chars)), leaf, leaf & (chars <= BRIEF), dated], axis=1).astype(np.float64)
    total = own.copy()
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    for at in reversed(levels[1:]):
        np.add.at(total, parent[at], total[at])
    hidden = np.array(dom.hidden, dtype=np.float32)
    above = np.zeros((len(page), len(INHERITED) + 1), dtype=np.float32)
    mine = np.stack([group == g for g in INHERITED] + [hidden], axis=1).astype(np.float32)
    for at in levels[1:]:
        above[at] = above[parent[at]] + mine[parent[at]]
    safe = np.maximum(parent, 0)
    family = np.where(parent < 0, -1 - page, parent)
    _, kin, kins = np.unique(family, return_inverse=True, return_counts=True)
    kin_chars = np.bincount(kin, weights=total[:, 0])
    same = np.unique(kin * 64 + group * 2 + leaf, return_inverse=True, return_counts=True)
    order = np.argsort(kin, kind="stable")
    rank = np.empty(len(page))
    rank[order] = np.arange(len(page)) - np.repeat(np.cumsum(kins) - kins, kins)
    # the heaviest of a node and its siblings; the least share of it on the way down
    top = np.zeros(len(kins))
    np.maximum.at(top, kin, total[:, 0])
    weight = total[:, 0] / np.maximum(top[kin], 1)
    starts_brief, starts_heading = _first_leaf(dom, leaf, chars, total[:, 4])
    alike, talk, signed = _repeats(dom, kin, group, leaf, total, starts_brief, starts_heading)
    path, talks, all_signed = np.ones(len(page)), talk.copy(), signed.copy()
    for at in levels[1:]:
        path[at] = np.minimum(path[parent[at]], weight[parent[at]])
        talks[at] = np.maximum(talks[at], talks[parent[at]])
        all_signed[at] = np.maximum(all_signed[at], all_signed[parent[at]])
    n_page = np.bincount(page)
    first = np.cumsum(n_page) - n_page
    page_chars = np.bincount(page, weights=chars)
    density = total[:, 0] / total[:, 3]
    before = np.cumsum(chars) - chars
    before = before - before[first[page]]
    dense = [
        leaf, np.log1p(total[:, 0]), np.log1p(chars), total[:, 1] / np.maximum(total[:, 0], 1), 100 * total[:, 2] / np.maximum(total[:, 0], 1), np.log1p(total[:, 3]), np.log1p(density),
        density / np.maximum(density[safe], 1), total[:, 0] / np.maximum(page_chars[page], 1), depth, (np.arange(len(page)) - first[page]) / n_page[page], np.log1p(kins[kin]), rank / kins[kin],
        np.log1p(kin_chars[kin] / kins[kin]), same[2][same[1]] / kins[kin], hidden,
        weight, path, np.log1p(top[kin]), before / np.maximum(page_chars[page], 1), (before + total[:, 0]) / np.maximum(page_chars[page], 1),
        np.log1p(total[:, 4]), total[:, 5] / np.maximum(total[:, 4], 1), total[:, 6] / np.maximum(total[:, 4], 1), starts_brief, starts_heading, np.log1p(alike), np.log1p(talk), np.log1p(talks), np.log1p(signed), np.log1p(all_signed), _below(signed, parent, levels),
    ]
    dense += [group == g for g in range(len(GROUPS))] + list(above.T)
    dense += list(_evidence(dom.named, evidence).T)
    return np.stack(dense, axis=1).astype(np.float32), parent, depth


def _first_leaf(dom: Dom, leaf: np.ndarray, chars: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the text of each node begins with a brief line, and with a heading; nodes are in page order."""
    at = np.append(np.flatnonzero(leaf), 0)
    first = at[np.searchsorted(at[:-1], np.arange(len(leaf)))]
    heads = np.array(dom.group)[first] == GROUP["h1"]
    return (leaves > 0) & (chars[first] <= BRIEF), (leaves > 0) & heads


def _repeats(dom: Dom, kin: np.ndarray, group: np.ndarray, leaf: np.ndarray, total: np.ndarray, brief: np.ndarray, heading: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many siblings have a node's kind and attribute words; how many of them, as reader
    comments do, begin with a brief line that is no heading, and go on; and how many begin with any
    brief line and have one with a number, such as a date."""
    codes: dict[int, int] = {}
    code = np.array([codes.setdefault(b, len(codes)) for b in dom.own])
    key = np.unique((kin * len(GROUPS) + group) * len(codes) + code, return_inverse=True)[1]
    block = ~leaf & (total[:, 4] >= 1)
    talks = block & (total[:, 4] >= 2) & brief & (total[:, 0] > total[:, 1])
    return tuple(np.bincount(key, weights=found)[key] * found for found in (block, talks & ~heading, talks & (total[:, 6] > 0)))


def _below(x: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The greatest x among a node's children."""
    out = np.zeros(len(x))
    for at in levels[1:]:
        np.maximum.at(out, parent[at], x[at])
    return out


#: Log odds that a node gains if what encloses it is content.
COHERENCE = 1.0


def decode(log_odds: np.ndarray, parent: np.ndarray, depth: np.ndarray, coherence: float = COHERENCE) -> np.ndarray:
    """Labels of the greatest likelihood of which none is content below a node that isn't; each
    node that is content within content adds coherence.

    From the leaves up, each node's best sum if it is content (each child free) or not (no child
    is); from the root down, the choices.
    """
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    for at in reversed(levels[1:]):
        yes[at] += coherence
        np.add.at(yes, parent[at], np.maximum(yes[at], no[at]))
        np.add.at(no, parent[at], no[at])
    label = yes > no
    for at in levels[1:]:
        label[at] &= label[parent[at]]
    return label


def _weak_labels(dom: Dom) -> np.ndarray:
    """What a page's own article elements hold, or where it has none its main elements: without menus,
    footers, asides, forms, hidden elements, and articles in articles, which by HTML's rules are
    comments; without blocks that repeat an author's or a date's brief line before their text."""
    group, parent = dom.group, dom.parent
    tag = "article" if "article" in dom.marks else "main"
    kin, replies = {}, set()
    for k in np.flatnonzero(np.array(dom.leaf)):
        kin.setdefault(parent[k], []).append(k)
    for block, leaves in kin.items():
        first = dom.text[leaves[0]]
        if len(leaves) >= 2 and group[leaves[0]] != GROUP["h1"] and len(first) <= BRIEF and any(len(dom.text[k]) <= BRIEF and any(map(str.isdigit, dom.text[k])) for k in leaves):
            replies.add(block)
    shapes = Counter((parent[b], group[b], dom.own[b]) for b in replies)
    inside, outside = np.zeros(len(group), dtype=bool), np.zeros(len(group), dtype=bool)
    for k, p in enumerate(parent):
        above = p >= 0 and inside[p]
        inside[k] = above or dom.marks[k] == tag
        comment = above and dom.marks[k] == "article" or k in replies and shapes[p, group[k], dom.own[k]] >= 2
        outside[k] = comment or group[k] in (GROUP["nav"], GROUP["footer"], GROUP["aside"], GROUP["form"]) or dom.hidden[k] or (p >= 0 and outside[p])
    return inside & ~outside & np.array(dom.leaf, dtype=bool)


def _sentences(dom: Dom) -> np.ndarray:
    """Leaves that read like running text, where no page marks its own: texts for layouts, no labels."""
    leaf = np.array(dom.leaf, dtype=bool)
    reads = [len(t.split()) >= 8 and n < 0.3 * len(t) and t[-1] in ".!?\"'" for t, n in zip(dom.text, dom.links)]
    return leaf & np.array(reads, dtype=bool) if (leaf & np.array(reads, dtype=bool)).any() else leaf


class Names:
    """Attribute names for made layouts: random strings, of which some are used for content only, some
    for the rest, and most for both. What a real page's names say is learned from real pages alone."""

    def __init__(self, rng: np.random.Generator) -> None:
        pool = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 9)) for _ in range(100)]
        self.content, self.rest, self.both = pool[:15], pool[15:40], pool[40:]

    def draw(self, rng: np.random.Generator, content: bool) -> str:
        """An attribute, or none."""
        kind = rng.random()
        if kind < 0.35:
            return ""
        telling = self.content if content else self.rest
        name = str(rng.choice(telling if kind < 0.55 else self.both))
        return f' {"class" if rng.random() < 0.7 else "id"}="{name}"'


def _layout(content: list[tuple[int, str]], other: list[str], rng: np.random.Generator, names: Names) -> str:
    """A page in a layout drawn at random, with its content marked.

    Around and in the content stand menus, forms, notices and adverts that may read like it, and
    reader comments: blocks that repeat an author, a date and a text. Content may have its own
    header with a byline, sections with headings, figures and tables; any element may have a name.
    """
    pick = lambda *x: x[int(rng.integers(len(x)))]
    some = lambda share: rng.random() < share
    count = lambda a, b: range(int(rng.integers(a, b)))
    texts = [t for _, t in content]
    # what isn't content may read like it, and be as long
    said = lambda: escape(pick(*texts) if some(0.4) or not other else pick(*other))
    passage = lambda: " ".join(said().split()[: int(rng.integers(5, 50))])
    words = lambda n: " ".join(said().split()[: int(rng.integers(1, n))])
    brief = lambda: words(9)
    named = lambda yes=False: names.draw(rng, yes)
    number = lambda: str(int(rng.integers(1, 60)))
    date = lambda: pick(f"{number()} {words(2)} 20{rng.integers(10, 30)}", f"20{rng.integers(10, 30)}-0{rng.integers(1, 10)}-1{rng.integers(0, 10)}", f"{number()}:{rng.integers(10, 60)}", f"{number()} {words(3)}")
    link = lambda: f"<a href=/x>{brief()}</a>"
    item = lambda: f"<li>{pick(brief, link, link)()}</li>"
    menu = lambda: f"<ul{named()}>" + "".join(item() for _ in count(2, 9)) + "</ul>"
    links = lambda: " | ".join(link() for _ in count(2, 6))
    lines = lambda: "".join(f"<{t}>{pick(said, brief)()}</{t}>" for t in [pick("p", "p", "div", "h3")] * int(rng.integers(1, 4)))
    inner = lambda: pick(said, passage, brief, lines, menu, links)()
    form = lambda: f"<form action=/s{named()}>{pick(brief, said, lines)()}<input name=q><label>{brief()}</label></form>"

    def talk() -> str:
        """Reader comments, one to nine."""
        tag, who, heard = pick("div", "div", "li", "article", "section"), pick("b", "span", "a", "cite", "p", "div", "h4"), pick("p", "p", "div", "blockquote")
        name, own, when, answer = named(), named(), who == "h4" or some(0.7), some(0.4)

        def one(deep: int) -> str:
            by = f"<{who}>{words(4)}</{who}>"
            at = pick("<time>{}</time>", "<span>{}</span>", "<div>{}</div>", "<p>{}</p>").format(date()) if when else ""
            line = by + " " + at if who not in ("p", "div", "h4") and some(0.5) else f"<div>{by} {at}</div>"
            text = "".join(f"<{heard}>{pick(said, passage, passage)()}</{heard}>" for _ in count(1, 3))
            more = f"<div>{one(deep + 1)}</div>" if deep < 2 and some(0.15) else ""
            return f"<{tag}{own}>{line}{text}{'<a href=/r>' + words(2) + '</a>' if answer else ''}{more}</{tag}>"

        head = pick("", f"<h2>{words(4)}</h2>", f"<h3>{number()} {words(3)}</h3>", f"<p>{brief()}</p>")
        hold = pick("ol", "ul") if tag == "li" else pick("section", "div", "div")
        items = "".join(one(0) for _ in count(2, 10))
        return f"<{hold}{name}>{head}{items}</{hold}>{form() if some(0.3) else ''}"

    def aside(within: bool) -> str:
        kind = pick("tag", "named", "named", "menu", "form")
        if kind == "form":
            return form()
        if kind == "menu":
            t = pick("nav", "div", "aside", "section")
            return f"<{t}{named()}>{pick('', f'<h3>{brief()}</h3>')}{pick(menu, links)()}</{t}>"
        if kind == "tag":
            t = pick("nav", "footer", "aside") if within else pick("nav", "header", "header", "footer", "aside")
            return f"<{t}{named()}>{inner()}</{t}>"
        if within:  # a block of prose among prose is the article's, but for what only its name could tell
            return f"<div class=\"{pick(*names.rest)}\">{pick(links, links, links, brief, passage)()}</div>"
        t = pick("div", "div", "section", "p")
        return f"<{t}{named()}>{brief() if t == 'p' else inner()}</{t}>"

    blocks: list[str] = []
    mark = ' data-mark="1"'
    short = lambda text, n: " ".join(text.split()[: int(rng.integers(1, n))]).rstrip(".") + pick("", "", ".")
    if all(group != GROUP["h1"] for group, _ in content) and some(0.85):  # sentences alone: a title is made
        content = [(GROUP["h1"], short(pick(*texts), 9)), *content]
    if some(0.04):  # a very long one
        content = content * int(rng.integers(5, 30))
    for group, text in content:
        if some(0.3):  # articles have short paragraphs too
            text = short(text, 9)
        elif some(0.5):
            text = short(text, 60)
        tag = pick("h1", "h2") if group == GROUP["h1"] else pick("p", "p", "p", "p", "p", "p", "p", "div", "blockquote", "pre", "li", "h3", "figure", "td")
        body = f'<{tag}{named(True) if some(0.15) else ""}{mark}>{"<b>" * some(0.1)}{escape(text)}{"</b>" * some(0.5)}</{tag}>'
        if tag == "li":
            more = "".join(f"<li{mark}>{escape(short(pick(*texts), 20))}</li>" for _ in count(0, 4))
            body = f"<{(t := pick('ul', 'ol'))}>{body}{more}</{t}>"
        elif tag == "td":
            body = f"<table><tr>{body}<td{mark}>{number()}</td></tr></table>"
        blocks.append(body)
        if some(0.05):
            blocks.append(aside(True))
    if len(blocks) > 3 and some(0.4):  # sections, with or without headings
        cuts = sorted({1, *(int(c) for c in rng.integers(1, len(blocks), int(rng.integers(1, 5))))})
        parts = [blocks[a:b] for a, b in zip(cuts, [*cuts[1:], len(blocks)])]
        t, name, headed = pick("section", "div", "section"), named(True), some(0.6)
        head = lambda: f"<{(h := pick('h2', 'h3'))}{mark}>{escape(short(pick(*texts), 6))}</{h}>" if headed else ""
        wrap = lambda x: f"<{t}{name if some(0.5) else named(True)}>{head()}{''.join(x)}</{t}>"
        loose = pick(0.0, 0.4)
        blocks = blocks[:1] + ["".join(x) if some(loose) else wrap(x) for x in parts]
    if some(0.4):  # a header of its own, or a byline
        by = f"<{(t := pick('p', 'div', 'p'))}{named(True)}{mark}>{words(5)}{' ' + date() if some(0.5) else ''}</{t}>"
        lead = blocks[0] + by * some(0.8)
        blocks[0] = f"<{(t := pick('header', 'header', 'div'))}{named(True) if some(0.5) else ''}>{lead}</{t}>" if some(0.7) else lead
    after = talk() if some(0.35) else ""
    closing = pick("", "", aside(True))
    nested = some(0.4)
    t = pick("article", "main", "div", "div", "section")
    core = f"<{t}{named(True)}>{''.join(blocks)}{closing}{after if nested else ''}</{t}>"
    if some(0.2):
        core = f"<div{named(True)}>{core}</div>"
    around = ["".join(aside(False) for _ in count(0, 5)) for _ in range(2)]
    body = around[0] + core + ("" if nested else after) + around[1]
    return f"<html><body>{pick(body, f'<div>{body}</div>', f'<div{named()}>{body}</div>')}</body></html>"


def train(pages: list[str], seed: int = 0) -> tuple[Model, str]:
    """A model, and what it is trained on.

    marked: pages with an article or main element, as they are and with the same texts in other
    layouts. Where no page has one: layouts alone, made of the pages' texts, whose places in the
    pages then say nothing.
    """
    rng, read = np.random.default_rng(seed), []
    for html in pages:
        dom = Dom()
        dom.add(html)
        if any(dom.leaf):
            read.append((dom, _weak_labels(dom)))
    marked = [(dom, good) for dom, good in read if good.any()]
    if read and not marked:
        warnings.warn("no page marks its main text; trained on layouts made of the pages' texts alone", stacklevel=2)
    if not read:  # no text in any page: nothing to extract
        return Model(np.zeros(FLAGS), BoostedTrees(trees=1).fit(np.zeros((2, 1), dtype=np.float32), np.array([0.0, 0.0]))), "none"
    names, made = Names(rng), []
    texts_of = marked or [(dom, _sentences(dom)) for dom, _ in read]
    for dom, good in texts_of:
        texts = [(dom.group[k], dom.text[k]) for k in np.flatnonzero(good)]
        other = [dom.text[k] for k in np.flatnonzero(np.array(dom.leaf, dtype=bool) & ~good)]
        for _ in range(min(20, -(-LAYOUTS // len(texts_of)))):
            page = Dom()
            page.add(_layout(texts[:40], other, rng, names))
            made.append((page, np.array(page.mark) & np.array(page.leaf, dtype=bool)))
    # layouts teach what evidence is worth; what evidence a page's own names have comes from pages alone
    words, made_words = _learn_words(marked), _learn_words(made)
    x, y = [], []
    for dom, good, known in [*((*s, words) for s in marked), *((*s, made_words) for s in made)]:
        f, parent, depth = features(dom, known)
        for d in range(depth.max(), 0, -1):  # an element is content if some of it is
            at = np.flatnonzero(depth == d)
            np.logical_or.at(good, parent[at], good[at])
        x.append(f)
        y.append(good)
    return Model(words, BoostedTrees().fit(np.concatenate(x), np.concatenate(y).astype(np.float64))), "marked" if marked else "layouts"


def main_texts(htmls: list[str | None], model: Model) -> list[str]:
    dom = Dom()
    for html in htmls:
        dom.add(html or "")
    if not dom.pages:
        return []
    x, parent, depth = features(dom, model.evidence)
    kept = decode(model.trees.log_odds(x), parent, depth) & np.array(dom.leaf, dtype=bool)
    out: list[list[str]] = [[] for _ in htmls]
    for k in np.flatnonzero(kept):
        out[dom.page[k]].append(dom.text[k])
    return ["\n".join(x) for x in out]


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row: the pickled trees of a bounded sample of pages, and what they are trained on."""
    model, labels = train([html for batch in batches for html in batch["html"]])
    yield pd.DataFrame({"model": [pickle.dumps(model)], "labels": [labels]})


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (main text; one line per block) and labels for each row of pages.

    The classifier is trained, in a task, on at most TRAIN_PAGES pages of at most TRAIN_CHARS
    characters, those with the least hashes; everything else covers each page whole. labels says
    what it was trained on: marked (pages that name their main text), layouts (no page does; see
    train()), or none.

    No list of names decides: what words of attributes say of main text is learned from pages that
    mark theirs, a page counting once for a word. In layouts made for training, names are random
    strings that content shares with the rest, so there structure has to tell: reader comments are
    blocks that repeat an author's or a date's brief line before their text. An article's own header
    and byline are content, its footers, menus and forms are not. Prose within the article that is set
    apart by an unknown name alone stays, be it an advert.

    Elements without text (scripts, buttons, drawings ...) are left out up to their end; where
    nothing closes one, up to the next block. An unclosed script or style hides the rest of its
    page, as in a browser.

    Null, empty or text-free html: an empty text. Very long html: parsed whole, in one task. Null urls
    and ids are passed on; repeated rows each get a row. Empty table: no rows. Other columns are not read.
    """
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # about twice the sample passes the filter, so each task sends few pages on
    n = page.count()
    least = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)).alias("h")
    some = page.select("html", least).filter((F.col("h") <= F.lit(min(1.0, 2 * TRAIN_PAGES / max(n, 1)) * (1 << 40))) & (F.length("html") <= TRAIN_CHARS))
    some = some.orderBy("h", "html").limit(TRAIN_PAGES).coalesce(1)
    fitted = some.mapInPandas(_fit, "model binary, labels string").first()
    model = pages.sparkSession.sparkContext.broadcast(pickle.loads(bytes(fitted["model"])))

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found: list[str] = []
            for at in range(0, len(batch), 200):
                found += main_texts(list(batch.iloc[at : at + 200]), model.value)
            yield pd.Series(found, dtype="object")

    return page.select("page_id", "url", F.pandas_udf(texts, T.StringType())("html").alias("text"), F.lit(fitted["labels"]).alias("labels"))
