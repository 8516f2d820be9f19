"""Scores against brute force, counts beyond 32 bits, and the exchange in two levels."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorehive.llm import interpolation as lm
from tests_llm_common import DOCS

END = b""


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [END]


def trains(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**53), max_size=20))
def test_planes_hold_large_numbers(numbers):
    assert lm._unplanes(lm._planes(np.array(numbers, dtype=np.int64))).tolist() == numbers


def test_totals_beyond_32_bits():
    """Two blocks count an n-gram five billion times each, as the end of a text would be at that scale."""
    keys, counts = np.array([3, 9], dtype=np.uint64), np.array([5_000_000_000, 2**32])
    rows = [(0, block, 0, lm._planes(keys), lm._planes(counts), 2, 12) for block in (1, 2)]
    got = lm._answer(pd.DataFrame(rows, columns=[c.split()[0] for c in lm.ASKED.split(", ")]))
    assert [lm._unplanes(x).tolist() for x in got["totals"]] == [[10_000_000_000, 2**33]] * 2
    assert got["tokens"].sum() == 10_000_000_000 + 2**33 and got["types"].sum() == 2


def rows_of(rng, n):
    words = [f"w{k}" for k in range(60)]
    return [(k, " ".join(rng.choice(words[: 5 + k % 55]) for _ in range(rng.randrange(1, 40))), "en", "a", 0) for k in range(n)] + [(n, None, "en", "a", 0), (None, "w1 w2 w1", "en", "a", 0), (0, "w1 w2 unknown", "en", "a", 0)]


def weights_by_hand(*_):
    out = np.tile([0.0, 0.6, 0.4], (64, 1))
    out[1:] = [[0.5 + k / 200, 0.3 - k / 400, 0.2 - k / 400] for k in range(63)]
    return out


@pytest.mark.parametrize("wire", [2048, 8])
def test_scores_against_brute_force(spark, monkeypatch, wire):
    """With given weights: every document's score, and probabilities after every context that sum to
    one; in one exchange, and with teams of blocks that ask finer buckets."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(lm, "TEAM_BLOCKS", 5)
    monkeypatch.setattr(lm, "WIRE_BUCKETS", wire)
    monkeypatch.setattr(lm, "fit_weights", weights_by_hand)
    rows = rows_of(random.Random(1), 300)
    one, two = Counter(), Counter()
    for i, text, *_ in rows:
        if trains(i):
            for a, b in zip([END, *tokens(text)], tokens(text)):
                one[b] += 1
                two[a, b] += 1
    total, kinds, w = sum(one.values()), len(one), weights_by_hand()

    def p(a, b):
        mix = w[int(math.log2(one[a] + 1))]
        return mix[0] * two[a, b] / max(one[a], 1) + mix[1] * one[b] / total + mix[2] / (kinds + 1)

    for a in [*one, b"never-seen"]:
        # a context that was never seen has no bigrams to give its share to
        assert abs(sum(p(a, b) for b in [*one, b"never-seen"]) - (1 if one[a] else 1 - w[0][0])) < 1e-9
    want = Counter((i, round(sum(math.log10(p(a, b)) for a, b in zip([END, *tokens(t)], tokens(t))), 6)) for i, t, *_ in rows)
    got = lm.score_texts(spark.createDataFrame(rows, DOCS).repartition(3), stage=True).collect()
    assert Counter((g["doc_id"], round(g["score"], 6)) for g in got) == want
    assert {g["train_tokens"] for g in got} == {total}


def test_weights_are_as_good_as_those_of_exact_expectation_maximisation(spark):
    """Likelihoods against those of EM on leave-one-document-out counts without rounded estimates."""
    rows = [r for r in rows_of(random.Random(2), 400) if trains(r[0])]
    seen = {}

    def keep(cells, types, tokens, _fit=lm.fit_weights):
        seen["w"] = _fit(cells, types, tokens)
        return seen["w"]

    original, lm.fit_weights = lm.fit_weights, keep
    try:
        lm.score_texts(spark.createDataFrame(rows, DOCS)).count()
    finally:
        lm.fit_weights = original
    docs = [list(zip([END, *tokens(t)], tokens(t))) for _, t, *_ in rows]
    one, two = Counter(b for d in docs for _, b in d), Counter(x for d in docs for x in d)
    total, held = sum(one.values()), {}
    for d in docs:
        own1, own2 = Counter(b for _, b in d), Counter(d)
        for (a, b), n in own2.items():
            c = one[a] - own1[a]
            held.setdefault(int(math.log2(c + 1)), []).append((n, (two[a, b] - n) / max(c, 1), (one[b] - own1[b]) / total, 1 / (len(one) + 1)))
    for k, cells in held.items():
        n, p = np.array([c[0] for c in cells], dtype=float), np.array([c[1:] for c in cells])
        w = np.full(3, 1 / 3)
        for _ in range(2000):
            share = p * w
            w = (share * (n / share.sum(axis=1))[:, None]).sum(axis=0) / n.sum()
        if n.sum() > 200:
            # weights may differ where they hardly matter; what they make of the held-out counts may not
            likely = lambda v: (n * np.log10(p @ v)).sum() / n.sum()  # noqa: E731, B023
            assert likely(w) - likely(seen["w"][k]) < 0.01
