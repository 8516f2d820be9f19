"""Quality rules: robust multivariate outliers among text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehive.llm.common import staged

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
D = 5
#: What one step of each count is: symbols and lines by one, repeated words by a window of three.
UNITS = {2: 1, 3: 1, 4: 3}
#: Chi-square quantiles for five degrees of freedom: at 0.75, and at 1 - 1e-6.
CHI2_H, CHI2_CUT = 6.6257, 35.888
#: Share of rows in the core; most concentration steps, and the fall of a log determinant at which they
#: end; bins of distances per octave.
H, STEPS, SETTLED, FINE = 0.75, 20, 1e-3, 128
#: What a group's estimate takes from all of its language, a language's from the whole table, and the
#: table's from unit spreads: as much as so many rows, ten per dimension.
PRIOR_ROWS = 50
#: Rows of estimates, about 250 bytes each, that are broadcast; where there are more, rows meet them by
#: group and one of so many salts, so that a group which most rows belong to is no task of its own.
MAX_BROADCAST, SALTS = 50_000, 256
#: Least eigenvalue of a covariance, only against singular ones: a standard deviation of a thousandth.
LEAST_SPREAD = 1e-6
STARTS = ("diagonal", "tanh", "sign")
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
NAMES = [f"m{i}" for i in range(D)] + [f"i{i}{j}" for i, j in PAIRS] + ["logdet"]
FIT = "n double, " + ", ".join(f"{c} double" for c in NAMES)


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of STATS."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    return len(words), chars, symbols, again, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    pair = code[:-1] * len(ids) + code[1:]
    if len(ids) > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(ids) + code[2:]
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice, inside = np.zeros(n - 2, dtype=bool), np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in STATS]))
def stats_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_stats(t) for t in batch], columns=list(STATS), dtype="int64")


def _features() -> list[Column]:
    n = F.greatest("n_words", F.lit(1))
    per_hundred = lambda c: F.log1p(100 * F.col(c) / n)
    return [F.log1p("n_words"), F.col("word_chars") / n, per_hundred("n_symbols"), per_hundred("n_dup_lines"), per_hundred("n_repeat_words")]


def _errors() -> dict[int, Column]:
    """Variances that the features of counts have from rounding: a count stands for a step's width
    of rates, evenly, so the twelfth of its square, times the squared slope of the logarithm."""
    n = F.greatest("n_words", F.lit(1))
    return {i: F.pow(100 * unit / n, 2) / 12 / F.pow(1 + 100 * F.col(STATS[i]) / n, 2) for i, unit in UNITS.items()}


def _distance(errors: bool = False) -> Column:
    """Squared Mahalanobis distance of x0.. to m0.. under the inverse covariance i00.. ; with
    errors, its mean over what the row's counts stand for."""
    off = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + off[i] * off[j] * F.col(f"i{i}{j}") * (1 if i == j else 2)
    for i in UNITS if errors else ():
        total = total + F.col(f"v{i}") * F.col(f"i{i}{i}")
    return F.greatest(total, F.lit(0.0))


def _bin(d2: Column) -> Column:
    """Distances in steps of half a percent, so that quantiles are sums of counts."""
    return F.floor(F.log2(d2 + 1e-6) * FINE).cast("long")


def _meet(members: DataFrame, few: DataFrame, by: list[str], n: int) -> DataFrame:
    """members with the row of few, n rows in all, for each of its groups: members are never dealt by group alone."""
    if n <= MAX_BROADCAST:
        return members.join(F.broadcast(few), by)
    salted = members.withColumn("salt", F.pmod(F.xxhash64(*[f"x{i}" for i in range(D)]), F.lit(SALTS)).cast("int"))
    return salted.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*by, "salt"]).drop("salt")


def _quantile(rows: DataFrame, at: float, *by: str) -> DataFrame:
    """by, all (rows), cut: the least bin at or below which a share of a group's rows lies."""
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    run = Window.partitionBy(*by).orderBy("bin")
    counts = counts.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return counts.filter(F.col("upto") >= F.ceil(F.lit(at) * F.col("all"))).groupBy(*by).agg(F.first("all").alias("all"), F.min("bin").alias("cut"))


def _as_fit(mean: np.ndarray, cov: np.ndarray) -> list[float]:
    spread, axes = np.linalg.eigh(cov)
    spread = np.maximum(spread, LEAST_SPREAD)
    inv = (axes / spread) @ axes.T
    return [*mean.tolist(), *[float(inv[i, j]) for i, j in PAIRS], float(np.log(spread).sum())]


def _square(r: dict, name: str) -> np.ndarray:
    out = np.zeros((D, D))
    for i, j in PAIRS:
        out[i, j] = out[j, i] = r[f"{name}{i}{j}"] / r["n"]
    return out


def _refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Means, inverse covariances and log determinants from the sums over each core."""
    columns = ["group", "start", "before", "n", *NAMES]
    for batch in batches:
        rows = []
        for r in batch.to_dict("records"):
            mean = np.array([r[f"s{i}"] for i in range(D)]) / r["n"]
            cov = _square(r, "p") - np.outer(mean, mean)
            for i in UNITS:
                cov[i, i] += r[f"e{i}"] / r["n"]
            rows.append([r["group"], r["start"], r["before"], r["n"], *_as_fit(mean, cov)])
        yield pd.DataFrame(rows, columns=columns)


def _products(x: list[Column], name: str) -> list[Column]:
    return [F.sum(x[i] * x[j]).alias(f"{name}{i}{j}") for i, j in PAIRS]


def _starts(members: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """group, start and a first estimate of each kind, around the medians with spreads from the
    quartiles: without correlations, with those of the hyperbolic tangents, and with the spatial
    signs' covariance."""
    quart = members.groupBy("group").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(D)], *[F.avg(f"v{i}").alias(f"e{i}") for i in UNITS])
    spread = lambda i: F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + (F.col(f"e{i}") if i in UNITS else F.lit(0.0)) + F.lit(LEAST_SPREAD))
    quart = staged(quart.select("group", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(D)], *[spread(i).alias(f"d{i}") for i in range(D)]), "mcd-quartiles")
    at = _meet(members, quart, ["group"], quart.count())
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(D)]
    at = at.select("group", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    z = [F.col(f"z{i}") for i in range(D)]
    at = at.select("*", F.sqrt(sum((c * c for c in z), F.lit(1e-12))).alias("norm"), *[F.tanh(c).alias(f"t{i}") for i, c in enumerate(z)])
    t, u = [F.col(f"t{i}") for i in range(D)], [c / F.col("norm") for c in z]
    sums = at.groupBy("group").agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(t)], *_products(t, "p"), *_products(u, "u")).join(quart, "group")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                mean, d = np.array([r[f"m{i}"] for i in range(D)]), np.array([r[f"d{i}"] for i in range(D)])
                ts = np.array([r[f"s{i}"] for i in range(D)]) / r["n"]
                tanh = _square(r, "p") - np.outer(ts, ts)
                sd = np.sqrt(np.maximum(np.diag(tanh), 1e-6))
                shapes = {"diagonal": np.eye(D), "tanh": tanh / np.outer(sd, sd) + 0.01 * np.eye(D), "sign": D * _square(r, "u") + 0.01 * np.eye(D)}
                rows += [[r["group"], k, r["n"], *_as_fit(mean, shapes[kind] * np.outer(d, d))] for k, kind in enumerate(STARTS) if kind in kinds]
            yield pd.DataFrame(rows, columns=["group", "start", "n", *NAMES])

    return staged(sums.mapInPandas(first, f"group string, start int, {FIT}"), "mcd-starts")


def _concentrate(members: DataFrame, fit: DataFrame, n: int) -> DataFrame:
    """One concentration step of each of n starts: mean and covariance of the share H of rows that are nearest."""
    near = _meet(members, fit.drop("n"), ["group"], n).withColumn("bin", _bin(_distance(True)))
    # written, as it has no more rows than fit and can be broadcast where that is
    limit = staged(_quantile(near, H, "group", "start").drop("all"), "mcd-limit")
    core = _meet(near, limit, ["group", "start"], n).filter("bin <= cut")
    x = [F.col(f"x{i}") for i in range(D)]
    sums = core.groupBy("group", "start").agg(F.count("*").cast("double").alias("n"), F.first("logdet").alias("before"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *_products(x, "p"), *[F.sum(f"v{i}").alias(f"e{i}") for i in UNITS])
    return staged(sums.mapInPandas(_refit, f"group string, start int, before double, {FIT}"), "mcd-step")


def minimum(members: DataFrame, *, steps: int = STEPS, starts: tuple[str, ...] = STARTS) -> DataFrame:
    """group, n (rows of the core), mean m0.., inverse covariance i00.. and log determinant of the minimum
    covariance determinant of members(group, x0.., v2..): of all starts, each led to where concentration
    steps no longer lower its determinant, the least.

    The determinant is that of the core's covariance and mean rounding error; steps order rows by
    the mean distance over what their counts stand for, so a step never raises it, but for the
    width of a bin of distances. Each start of each group ends by itself: later steps have only the rows
    of groups with a start that still falls.
    """
    fit, ended, step = _starts(members, starts), [], 0
    while step < steps and (n := fit.count()):
        fit = _concentrate(members, fit, n)
        # what a start says of its own determinant is no covariance of rows, so the first step is none to compare
        falls = F.col("before") - F.col("logdet") >= SETTLED if step else F.lit(True)
        ended.append(fit.filter(~falls).drop("before"))
        fit, step = fit.filter(falls).drop("before"), step + 1
    every = reduce(DataFrame.unionByName, ended, fit)
    best = every.groupBy("group").agg(F.min(F.struct("logdet", "start", "n", *NAMES[:-1])).alias("b"))
    return staged(best.select("group", *[F.col(f"b.{c}").alias(c) for c in ("n", *NAMES)]), "mcd-best")


def _spread(members: DataFrame, fit: DataFrame) -> DataFrame:
    """group, n (rows), spread: log of what brings the distance of the share H of rows to that of a normal
    distribution. The nearest rows spread less than all do; this makes up for it."""
    cut = _quantile(_meet(members, fit.drop("n"), ["group"], fit.count()).withColumn("bin", _bin(_distance(True))), H, "group")
    return cut.select("group", F.col("all").cast("double").alias("n"), (F.col("cut") * float(np.log(2) / FINE) - float(np.log(CHI2_H))).alias("spread"))


def estimates(members: DataFrame, *, steps: int = STEPS, starts: tuple[str, ...] = STARTS) -> DataFrame:
    """minimum(), and scale, by which its squared distances are divided: each group by itself."""
    best = minimum(members, steps=steps, starts=starts)
    scale = _spread(members, best).select("group", F.greatest(F.exp("spread"), F.lit(1.0)).alias("scale"))
    return staged(best.join(scale, "group"), "mcd-fit")


def _blend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each group's estimate as an average by rows of its own, its language's, the table's and unit spreads."""
    for batch in batches:
        rows = []
        for r in batch.to_dict("records"):
            mean, cov, log = np.array([r[f"all_m{i}"] for i in range(D)]), np.eye(D), 0.0
            for level in ("all_", "lang_", ""):
                n, of_log = r[f"{level}n"], r[f"{level}rows"]
                mean = (n * np.array([r[f"{level}m{i}"] for i in range(D)]) + PRIOR_ROWS * mean) / (n + PRIOR_ROWS)
                cov = (n * np.linalg.inv(_square({**r, "n": 1}, f"{level}i")) + PRIOR_ROWS * cov) / (n + PRIOR_ROWS)
                log = (of_log * r[f"{level}spread"] + PRIOR_ROWS * log) / (of_log + PRIOR_ROWS)
            rows.append([r["group"], r["n"], *_as_fit(mean, cov), max(float(np.exp(log)), 1.0)])
        yield pd.DataFrame(rows, columns=["group", "n", *NAMES, "scale"])


def blended(members: DataFrame, groups: DataFrame, *, steps: int = STEPS, starts: tuple[str, ...] = STARTS) -> DataFrame:
    """group, mean, inverse covariance and scale of each of groups(group, lang, all), leaning on its language.

    members has each row under its group, its language (groups' lang) and the table (groups' all), and each
    of these has a minimum covariance determinant. Means and covariances are averages: the core's rows
    weigh as many, what is above them PRIOR_ROWS; the table leans on unit spreads. Logarithms of scales
    likewise, by all rows. So a group's own rows count the more the more there are, at every size alike.
    """
    best = minimum(members, steps=steps, starts=starts)
    spread = _spread(members, best).select("group", F.col("n").alias("rows"), "spread")
    fit = staged(best.join(spread, "group"), "mcd-own")
    of = lambda level: fit.select(*[F.col(c).alias(level if c == "group" else f"{level}_{c}") for c in fit.columns])
    three = groups.select("group", "lang", "all").join(fit, "group").join(of("lang"), "lang").join(of("all"), "all")
    return staged(three.mapInPandas(_blend, f"group string, {FIT}, scale double"), "mcd-blend")


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = CHI2_CUT, steps: int = STEPS, starts: tuple[str, ...] = STARTS) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, distance (squared; null if none was taken).

    Base: fewer than 50 words, or more than half of the words in repeated 3-word windows. Of the
    rest, per language and source, the minimum covariance determinant of 75 percent of the rows is
    estimated over all rows, from three starts. A row is rejected if its squared Mahalanobis
    distance is above the chi-square quantile for one in a million. Features: log words, characters
    a word, and logs of symbols, repeated lines and repeated words per hundred words. The last three
    are zero in most rows; there the rounding error of counts keeps the covariance regular, so what
    a single step of a count changes in a short text is not held against it.

    Each step is two aggregations per group and start over a narrow table; distances are counted in
    bins, so quantiles need no sort.

    Small groups have few rows to go by, so each estimate leans on that over all rows of its language,
    and that on the whole table's, as blended() says: without a least size, and without a switch.
    Null or empty text: no words, base_failed; very long texts are counted whole. Null language or
    source: a value of its own. Ties and repeated rows: judged each, alike. Null ids: as any other.
    Empty table: no rows. Other columns are not read.
    """
    null = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    row = docs.select(F.col(id_col).alias("doc_id"), null(lang_col).alias("lang"), null(source_col).alias("source"), stats_of(F.col(text_col)).alias("s"))
    row = row.select("doc_id", "lang", "source", "s.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    row = row.withColumn("base_failed", failed).select("*", *[x.cast("double").alias(f"x{i}") for i, x in enumerate(_features())], *[v.alias(f"v{i}") for i, v in _errors().items()])
    row = staged(row, "text-stats")

    rest = row.filter("not base_failed")
    levels = [F.concat_ws("\u0001", "lang", "source").alias("group"), F.concat(F.lit("lang"), "lang").alias("of_lang"), F.lit("*").alias("all")]
    groups = staged(rest.select("lang", "source").distinct().select("*", *levels), "groups")
    each = F.explode(F.array(*levels)).alias("group")
    members = staged(rest.select(each, *[f"x{i}" for i in range(D)], *[f"v{i}" for i in UNITS]), "mcd-members")
    fit = blended(members, groups.select("group", F.col("of_lang").alias("lang"), "all"), steps=steps, starts=starts)
    judged = staged(groups.select("lang", "source", "group").join(fit, "group").drop("group"), "mcd-judged")
    out = row.join(judged, ["lang", "source"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return out.select("doc_id", *STATS, "base_failed", kept.alias("kept"), "distance")
