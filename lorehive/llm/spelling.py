"""Spelling variants by rotations of terminator-marked words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehive.llm.common import staged

END = "$"  # no word has it
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("near", pa.string())])


def vocabulary(docs: DataFrame, *, least: int = 3, length: int = 5, typo_of: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the distinct words of at least so many letters and occurrences.

    Words are maximal runs of letters, in lower case for A-Z alone. Of one run in typo_of a letter is
    left out, chosen by the crc32 of document and run. Null and empty texts: no words. Null id: as an
    empty one. Repeated rows count. Very long texts: whole. Empty table: no rows. Other columns are not read.
    """
    # a letter may go but none comes: shorter runs never make a word
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{length},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), runs.alias("raw"))
    ascii_ = F.octet_length("raw") == F.length("raw")
    rows = rows.select("doc", F.when(ascii_, F.lower("raw")).otherwise(F.translate("raw", UPPER, LOWER)).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    rest = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % typo_of == 0, rest).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _scanned(keys: pa.Array, edited: pa.Array, n: pa.Array, new: np.ndarray) -> pd.DataFrame:
    """Rows of whole groups, in order, with neighbours; new: whether each row begins a group."""
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(new)))
    rows = pa.array(np.flatnonzero(np.repeat(size > 1, size)))
    if not len(rows):
        return pd.DataFrame(columns=["word", "n_near", "less", "near"])
    keys, edited, n = (pc.take(x, rows).to_pylist() for x in (keys, edited, n))
    size, n = size[size > 1], np.array(n)
    starts = np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(n))
    words = np.array([x + y for y, x in ((k + c).split(END) for k, c in zip(keys, edited))], dtype=object)
    is_edited = np.array([c != "" for c in edited])
    # of a run of equal letters only the first counts as left out
    first_of_run = is_edited & np.array([k[-1] != c for k, c in zip(keys, edited)])
    last = starts + size - 1
    shorter = np.where(is_edited[last], -1, last)
    n_edited = size - (shorter >= 0)
    to_shorter = first_of_run & (shorter[group] >= 0)
    other = np.where(at == starts[group], np.where(n_edited > 1, starts + 1, -1)[group], starts[group])
    # of the shorter word: the best that has the letter besides
    far = len(n)
    best_longer = np.minimum.reduceat(np.where(first_of_run, at, far), starts)
    other = np.where(is_edited, other, np.where(best_longer < far, best_longer, -1)[group])
    count = np.where(is_edited, n_edited[group] - 1 + to_shorter, np.add.reduceat(first_of_run.astype(np.int64), starts)[group])
    less = -n
    left, right = other, np.where(to_shorter, shorter[group], -1)
    take = (right >= 0) & ((left < 0) | (less[right] < less[left]))
    for k in np.flatnonzero((right >= 0) & (left >= 0) & (less[right] == less[left])).tolist():
        take[k] = words[right[k]] < words[left[k]]
    best = np.where(take, right, left)
    met = count > 0
    return pd.DataFrame({"word": words[met], "n_near": count[met], "less": less[best[met]], "near": words[best[met]]})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        keys, edited, n = (rows[c].combine_chunks() for c in ("key", "edited", "n"))
        new = np.ones(len(keys), bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
        rest = rows.slice(cut)
        yield pa.RecordBatch.from_pandas(_scanned(keys.slice(0, cut), edited.slice(0, cut), n.slice(0, cut), new[:cut]), NEAR, preserve_index=False)
    if rest is not None:
        keys, edited, n = (rest[c].combine_chunks() for c in ("key", "edited", "n"))
        yield pa.RecordBatch.from_pandas(_scanned(keys, edited, n, np.arange(len(keys)) == 0), NEAR, preserve_index=False)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of words(word, n) that have near words: their number, and the one of largest n
    (ties: the least) as struct(less = -n, near).

    All rotations of a word and its end are sorted. A replaced letter is the last one of a rotation: the
    words that differ in it have the prefix before it in common, and a word without it is that prefix.
    So a group is a prefix with at most one word per letter and one shorter word: at most 91 rows,
    whatever the vocabulary. A scan finds the best two of each group and emits for each member how many
    it meets and the best of them, never pairs. Of a run of equal letters only the first counts as
    left out, so that each link is met once.
    """
    turn = words.select("n", F.length("word").alias("size"), F.concat("word", F.lit(END)).alias("marked"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    turn = turn.select("n", "size", "at", F.concat(F.substring(F.col("marked"), F.col("at") + 1, F.col("size") + 1), F.substring(F.col("marked"), F.lit(1), F.col("at"))).alias("turned"))
    whole = F.struct(F.col("turned").alias("key"), F.lit("").alias("edited"))
    cut = F.when(F.col("at") > 0, F.struct(F.substring(F.col("turned"), F.lit(1), F.col("size")).alias("key"), F.right("turned", F.lit(1)).alias("edited")))
    entry = turn.select("n", F.explode(F.array(whole, cut)).alias("x")).filter("x is not null").select("x.key", "x.edited", "n")
    # words of one prefix are in the order of the letters in which they differ
    entry = entry.repartition("key").sortWithinPartitions("key", F.col("edited") == "", F.desc("n"), "edited")
    found = entry.mapInArrow(_scan, "word string, n_near long, less long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): each step looks twice as far; n doubles with each form at
    least, so chains are short and never closed."""
    links = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = staged(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of words(word, n).

    Near words differ by one inserted, deleted or replaced code point. form is the near word of largest
    n (ties: the least in code-point order) if that n is twice the word's or more, else null; root is
    where forms lead to, the word itself if it has none. Words must be distinct and without the mark
    of their end. Null words: no rows. Empty table: no rows.
    """
    words = staged(words.select("word", F.col("n").cast("long").alias("n")).filter("word is not null"), "words")
    near = words.join(neighbours(words), "word", "left").withColumn("form_n", -F.col("best.less"))
    has = F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False))
    near = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "near-words")
    rooted = near.join(_roots(near.filter("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
