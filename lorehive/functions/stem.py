"""Stems of English words: the second stemmer of Porter (2001), for words without apostrophes."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the algorithm: words with stems of their own, words that stay after the first step, beginnings
# after which the first region starts, and suffixes with what takes their place.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
BEGINNINGS = "gener|commun|arsen"
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_Y = re.compile("([aeiouy])y")
_BEGINNINGS = tuple(BEGINNINGS.split("|"))
#: The endings of each step, longest first.
_ENDINGS = [tuple(sorted(x, key=len, reverse=True)) for x in (["eedly", "eed", "ingly", "edly", "ing", "ed"], STEP2, STEP3, STEP4)]


def _regions(word: str) -> tuple[int, int]:
    """Where the regions after the first, and the second, vowel and consonant begin."""
    def after(start: int) -> int:
        found = _REGION.search(word, start)
        return found.end() if found else len(word)

    begun = next((len(b) for b in _BEGINNINGS if word.startswith(b)), 0)
    first = begun or after(0)
    return first, after(first)


def _ending(word: str, step: int) -> tuple[str, str]:
    """The word without its longest ending of a step, and the ending."""
    if not word.endswith(_ENDINGS[step]):  # most words
        return word, ""
    end = next(x for x in _ENDINGS[step] if word.endswith(x))
    return word[: -len(end)], end


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].+s$", w):
        return w[:-1]
    return w


def _past(w: str, first: int) -> str:
    body, end = _ending(w, 0)
    if end.startswith("eed"):
        return body + "ee" if len(body) >= first else w
    if not end or not re.search("[aeiouy]", body):
        return w
    if body.endswith(("at", "bl", "iz")) or len(body) == first and _SHORT.search(body):
        return body + "e"
    return body[:-1] if re.search("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", body) else body


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or with a digit stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()) and any(c.isnumeric() for c in word):
        return word
    if word in WHOLE:
        return WHOLE[word]
    # a y that is a consonant
    w = _Y.sub(r"\1Y", "Y" + word[1:] if word[0] == "y" else word) if "y" in word else word
    first, second = _regions(w)
    w = _plural(w)
    if w in KEPT:
        return w
    w = _past(w, first)
    w = re.sub("(.[^aeiouy])[yY]$", r"\1i", w) if w.endswith(("y", "Y")) else w
    body, end = _ending(w, 1)
    if end and len(body) >= first and not (end == "ogi" and not body.endswith("l") or end == "li" and not re.search("[cdeghkmnrt]$", body)):
        w = body + STEP2[end]
    body, end = _ending(w, 2)
    if end and len(body) >= (second if end == "ative" else first):
        w = body + STEP3[end]
    body, end = _ending(w, 3)
    if end and len(body) >= second and not (end == "ion" and not body.endswith(("s", "t"))):
        w = body
    body = w[:-1]
    if w.endswith("e") and (len(body) >= second or len(body) >= first and not _SHORT.search(body)) or w.endswith("ll") and len(body) >= second:
        w = body
    return w.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_of(words: pd.Series) -> pd.Series:
    """stem() of a column of words, once for each distinct word of a batch."""
    return words.map({w: stem(w) for w in words.dropna().unique()})


#: Lists of words that are counted at once.
HELD = 1024


def _counted(lists: pa.Array, left_out: frozenset[str]) -> pa.Array:
    words = lists.flatten().dictionary_encode()
    said = [None if w in left_out else stem(w) for w in words.dictionary.to_pylist()]
    stems = sorted(set(said) - {None})
    place, n = {s: k for k, s in enumerate(stems)} | {None: -1}, max(1, len(stems))
    codes = np.array([place[s] for s in said], np.int64)
    sizes, indices = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), words.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    known, found, counts = pa.array(stems, pa.string()), [], [np.zeros(1, np.int64)]
    for at in range(0, len(sizes), HELD):
        some = sizes[at : at + HELD]
        own, rows = codes[indices[ends[at] : ends[at + len(some)]]], np.repeat(np.arange(len(some)), some)
        pairs, tf = np.unique(rows[own >= 0] * n + own[own >= 0], return_counts=True)
        row, code = np.divmod(pairs, n)
        found.append(pa.StructArray.from_arrays([known.take(pa.array(code)), pa.array(tf, pa.int64())], names=["term", "tf"]))
        counts.append(np.bincount(row, minlength=len(some)))
    none = pa.array([], pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.concat_arrays([none, *found]))


def counted_stems(words: Column, left_out: Iterable[str] = ()) -> Column:
    """Distinct stems of an array of words, in order, as struct(term, tf), without those of the words left_out. A batch
    is counted as numbers, HELD lists at once, and stem() asked once for each distinct word of it; a null list has none."""
    less = frozenset(left_out)

    @F.arrow_udf("array<struct<term: string, tf: bigint>>")
    def run(lists: pa.Array) -> pa.Array:
        return _counted(lists, less)

    return run(words)
