"""Language identification by inference over mixtures of languages."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehive.llm.common import id_remainder

#: Hash buckets of letter trigrams: bounds the model to 256 KB a language, whatever the corpus.
BUCKETS = 1 << 16
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Hash buckets of the trigrams around each letter; whatever is no letter counts as one space."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = _letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16))[is_letter[1:-1]]


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            counts = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            if len(h := trigrams(text)) < BUCKETS // 8:
                np.add.at(counts, h, 1)
            else:
                counts += np.bincount(h, minlength=BUCKETS)
    for lang, counts in total.items():
        yield pd.DataFrame({"lang": [lang], "counts": [counts.tobytes()]})


def _sum_counts(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for x in group["counts"]:
        total += np.frombuffer(x, dtype=np.int64)
    return pd.DataFrame({"lang": group["lang"].iloc[:1], "counts": [total.tobytes()]})


def learn(docs: DataFrame, train: Column, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log likelihood of each trigram bucket in each of them.

    Counts cover all training rows: each task sums per language, and a task's sums, 512 KB a
    language, are combined in two rounds. Only the finished counts come to the driver.
    """
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    schema = "lang string, counts binary"
    parts = rows.mapInPandas(_count_batches, schema).withColumn("part", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("lang", "part").applyInPandas(lambda g: _sum_counts(g[["lang", "counts"]]), schema)
    found = some.groupBy("lang").applyInPandas(_sum_counts, schema).collect()
    found = sorted(((r["lang"], np.frombuffer(r["counts"], dtype=np.int64)) for r in found), key=lambda x: x[0])
    if not found:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    counts = np.stack([c for _, c in found]) + 0.5
    return [lang for lang, _ in found], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _mix(like: np.ndarray, weight: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the proportions; and the log likelihood under them."""
    share = start
    for _ in range(60):
        joint = like * share
        total = joint.sum(axis=1)
        new = (joint * (weight / total)[:, None]).sum(axis=0) / weight.sum()
        moved, share = np.abs(new - share).max(), new
        if moved < 1e-3:
            break
    return share, float((np.log((like * share).sum(axis=1)) * weight).sum())


def infer(text: str | None, model: np.ndarray, penalty: float = 3.0) -> dict[int, float]:
    """Proportions of the languages in a text, the largest first; empty if it has no letter.

    Sets of languages are nested by their proportion in the full mixture. Another language must
    raise the log likelihood by more than penalty * log(trigrams).
    """
    h = trigrams(text)
    if not len(h) or not len(model):
        return {}
    counts = np.bincount(h, minlength=BUCKETS)
    kinds = np.flatnonzero(counts)
    weight = counts[kinds].astype(np.float64)
    log_like = model[:, kinds].T.astype(np.float64)
    like = np.exp(log_like - log_like.max(axis=1, keepdims=True))
    like += 1e-12
    start = np.full(len(model), 1 / len(model))
    share, _ = _mix(like, weight, start)
    order = np.argsort(-share, kind="stable")
    best, best_score, cost = {}, -np.inf, penalty * np.log(weight.sum() + 1)
    for size in range(1, len(order) + 1):
        if size > 1 and share[order[size - 1]] < 0.01:
            break
        chosen = order[:size]
        part, log = _mix(like[:, chosen], weight, share[chosen] / share[chosen].sum())
        if log - cost * size <= best_score:
            break
        best_score, best = log - cost * size, dict(zip(chosen.tolist(), part.tolist()))
    return dict(sorted(best.items(), key=lambda x: (-x[1], x[0])))


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, *, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column out: lang_pred, score (its proportion, 0 to 1) and langs (the
    chosen set, largest first).

    lang_pred is und, with score 0 and no langs, for a null text, one without a letter, or without
    a model. Only the text is an input. Columns of docs stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                found = infer(text, shared.value)
                names = [langs[k] for k in found]
                rows.append((names[0] if names else UNDETERMINED, min(1.0, next(iter(found.values()), 0.0)), names))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "langs"])

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType()))])
    return docs.withColumn(out, F.pandas_udf(predict, kind)(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the id's remainder is 0; false for a null id, whose rows are never learned from."""
    return F.coalesce(id_remainder(F.col(id_col)) == 0, F.lit(False))


def language_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs for each row, learned from the rows not held out.

    Null, empty and letterless texts: und. Very long texts: read whole; only their distinct trigram
    buckets enter the inference. Ties between languages: the lesser name first. Null ids: not held out,
    and not learned from. Repeated rows each get a row. Empty table: no rows. Other columns are not read.
    """
    train = id_remainder(F.col(id_col)) != 0
    langs, model = learn(docs, train, text_col=text_col, lang_col=lang_col)
    row = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identify(row, langs, model).select("doc_id", "held_out", "language.*")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """docs whose text has one language with at least half of its letters' trigrams.

    Null, empty and letterless texts go. Repeated rows and null ids: each by its own text. Very long
    texts: read whole. Empty table: no rows. Columns stay as they are, with any names.
    """
    langs, model = learn(docs, id_remainder(F.col(id_col)) != 0, text_col=text_col, lang_col=lang_col)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("text"))
    return identify(row, langs, model).filter((F.col("language.lang_pred") != UNDETERMINED) & (F.col("language.score") >= least)).select("doc.*")
