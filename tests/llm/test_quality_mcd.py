"""The minimum covariance determinant against a search from many random starts, and what its parts do."""

import random

import numpy as np
import pytest

from lorehive.llm import quality
from tests_llm_common import DOCS, random_text

D = quality.D


def search(x, v, tries, rng):
    """Least log determinant of the core of 75 percent, over concentration from random subsets."""
    h = int(np.ceil(quality.H * len(x)))

    def fit(idx):
        return x[idx].mean(axis=0), np.cov(x[idx].T, bias=True) + np.diag([0, 0, *v[idx].mean(axis=0)])

    best = (np.inf, None, None)
    for _ in range(tries):
        mean, cov = fit(rng.choice(len(x), D + 3, replace=False))
        cov, last = cov + 1e-6 * np.eye(D), np.inf
        while True:
            inv = np.linalg.inv(cov)
            d = np.einsum("ij,jk,ik->i", x - mean, inv, x - mean) + v @ np.diag(inv)[2:]
            mean, cov = fit(np.argsort(d, kind="stable")[:h])
            now = np.linalg.slogdet(cov)[1]
            if last - now < 1e-9:
                break
            last = now
        if now < best[0]:
            best = (now, mean, cov)
    return best


def test_estimate_is_the_least_of_many_starts(spark):
    """Groups of all sizes, with a fifth of correlated outliers, some features zero in most rows."""
    rng = np.random.default_rng(3)
    rows, want, out = [], {}, {}
    for group, n in (("a", 50), ("b", 130), ("c", 600), ("d", 2500)):
        mix = rng.normal(size=(D, D)) * 0.4 + np.eye(D)
        x = rng.normal(size=(n, D)) @ mix
        far = np.arange(n) < n // 5
        x[far] = rng.normal(size=(far.sum(), D)) * 0.3 + rng.normal(size=D) * 2 + [9, -7, 3, 3, 0]
        if group in "bd":
            x[:, 4] = np.where(rng.random(n) < 0.9, 0, np.abs(x[:, 4]))
        v = rng.uniform(0.001, 0.1, size=(n, 3))
        want[group], out[group] = search(x, v, 60, rng), far
        rows += [(group, *map(float, r), *map(float, e)) for r, e in zip(x, v)]
    names = ", ".join([f"x{i} double" for i in range(D)] + [f"v{i} double" for i in quality.UNITS])
    fits = {r["group"]: r for r in quality.estimates(spark.createDataFrame(rows, f"group string, {names}")).collect()}
    for group, (logdet, mean, cov) in want.items():
        f = fits[group]
        assert abs(f["logdet"] - logdet) < 0.1, group
        x = np.array([r[1 : 1 + D] for r in rows if r[0] == group])
        inv = np.zeros((D, D))
        for i, j in quality.PAIRS:
            inv[i, j] = inv[j, i] = f[f"i{i}{j}"]
        m = np.array([f[f"m{i}"] for i in range(D)])
        d = np.einsum("ij,jk,ik->i", x - m, inv, x - m) / f["scale"]
        assert (d[out[group]] > quality.CHI2_CUT).all() and (d[~out[group]] > quality.CHI2_CUT).mean() < (0.01 if group in "ac" else 0.12)


def text_of(rng, n, chars):
    """n words of about so many characters, none of them the same."""
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(max(1, round(rng.gauss(chars, 0.5))))) for _ in range(n))


def correlated(rng):
    """Longer texts have longer words; what is planted is usual in each, but not together."""
    rows = [(k, text_of(rng, n := int(60 * 2 ** rng.uniform(0, 4)), 4 + 1.2 * np.log2(n / 60) + rng.gauss(0, 0.15)), "en", "a") for k in range(240)]
    return rows + [(1000 + k, text_of(rng, 100, 8 + rng.gauss(0, 0.1)), "en", "a") for k in range(12)]


def test_concentration_steps_decide(spark):
    rows = correlated(random.Random(5))
    df = spark.createDataFrame([(*r, None) for r in rows], DOCS)
    lost = lambda **o: {g["doc_id"] for g in quality.judge(df, **o).collect() if not g["kept"]}
    planted = {r[0] for r in rows if r[0] >= 1000}
    assert lost() == planted
    assert lost(steps=0, starts=("diagonal",)) == set()


def members_of(rows, spark):
    names = ", ".join([f"x{i} double" for i in range(D)] + [f"v{i} double" for i in quality.UNITS])
    return spark.createDataFrame(rows, f"group string, {names}")


def test_groups_lean_on_their_language(spark):
    """blended() against the same averages by hand: a large and a tiny group of one language, and one of its own."""
    rng = np.random.default_rng(8)
    langs, rows = {"a": "en", "b": "en", "c": "de"}, []
    for group, n in (("a", 300), ("b", 4), ("c", 60)):
        x = rng.normal(size=(n, D)) @ (np.eye(D) + 0.3 * rng.normal(size=(D, D))) + rng.normal(size=D)
        for r, e in zip(x, rng.uniform(0.001, 0.1, size=(n, 3))):
            rows += [(level, *map(float, r), *map(float, e)) for level in (group, langs[group], "*")]
    members = members_of(rows, spark)
    groups = spark.createDataFrame([(g, lang, "*") for g, lang in langs.items()], "group string, lang string, all string")
    got = {r["group"]: r for r in quality.blended(members, groups).collect()}
    assert set(got) == set(langs)

    def parts(r):
        inv = np.zeros((D, D))
        for i, j in quality.PAIRS:
            inv[i, j] = inv[j, i] = r[f"i{i}{j}"]
        return np.array([r[f"m{i}"] for i in range(D)]), inv

    cores = {r["group"]: r for r in quality.minimum(members).collect()}
    k = quality.PRIOR_ROWS
    for group, lang in langs.items():
        mean, cov, log = parts(cores["*"])[0], np.eye(D), 0.0
        for level in ("*", lang, group):
            x = np.array([r[1:] for r in rows if r[0] == level])
            (m, inv), n = parts(cores[level]), cores[level]["n"]
            assert n >= quality.H * len(x)
            off = x[:, :D] - m
            d = np.sort(np.einsum("ij,jk,ik->i", off, inv, off) + x[:, D:] @ np.diag(inv)[2:])
            spread = np.log(d[int(np.ceil(quality.H * len(x))) - 1] / quality.CHI2_H)
            mean, cov, log = (n * m + k * mean) / (n + k), (n * np.linalg.inv(inv) + k * cov) / (n + k), (len(x) * spread + k * log) / (len(x) + k)
        assert np.allclose(parts(got[group])[0], mean)
        assert np.allclose(parts(got[group])[1], np.linalg.inv(cov), rtol=1e-6)
        assert abs(np.log(got[group]["scale"]) - max(log, 0)) < 2 * np.log(2) / quality.FINE


@pytest.mark.parametrize("most", [quality.MAX_BROADCAST, 0])
def test_small_sources_lean_on_their_language(spark, monkeypatch, most):
    """Of 40 small sources, a language of one row, and junk in each: junk goes, all else stays; with
    estimates broadcast, and met by salted groups."""
    monkeypatch.setattr(quality, "MAX_BROADCAST", most)
    rng = random.Random(60)
    rows = [(k, random_text(rng, rng.randrange(60, 700)), "en", f"s{k % 40}", 0) for k in range(400)]
    rows += [(900, random_text(rng, 200), "de", "x", 0)]
    junk = [(1000 + k, " ".join(w + "###" for w in random_text(rng, 200).split()), lang, "s1", 0) for k, lang in enumerate(("en", "de", None))]
    got = {g["doc_id"]: g for g in quality.judge(spark.createDataFrame(rows + junk, DOCS)).collect()}
    assert all(got[r[0]]["kept"] for r in rows)
    assert not any(got[r[0]]["kept"] for r in junk)


@pytest.mark.parametrize("n", [1, 2, 30])
def test_tables_of_few_rows_have_distances(spark, n):
    rng = random.Random(n)
    rows = [(k, random_text(rng, rng.randrange(60, 700)), "en", f"s{k % 4}", 0) for k in range(n)]
    got = quality.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == n and all(g["kept"] and g["distance"] is not None for g in got)


def test_no_step_by_size(spark):
    """A table grows from 48 to 52 rows by one at a time: the distance of its first row moves by little each time."""
    rng = random.Random(11)
    rows = [(0, random_text(rng, 900), "en", "a", 0)] + [(k, random_text(rng, rng.randrange(100, 400)), "en", "a", 0) for k in range(1, 60)]
    found = []
    for n in range(48, 53):
        got = {g["doc_id"]: g["distance"] for g in quality.judge(spark.createDataFrame(rows[:n], DOCS)).collect()}
        found.append(got[0])
    assert all(abs(np.log(b / a)) < 0.25 for a, b in zip(found, found[1:])), found
