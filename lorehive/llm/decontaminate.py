"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorehive.llm.common import staged

TOKEN = r"[\p{L}\p{N}]+"
# Masks over consecutive tokens; a 0 is a position whose token is ignored. Each is two pairs of
# tokens with the same gap, so that the hash of a pair serves several masks.
# (gap within a pair, distance between the pairs)
MASKS = {"11011": (1, 3), "110011": (1, 4), "10100101": (2, 5)}
SPAN = max(len(m) for m in MASKS)
#: Seeds that are broadcast at once, about 24 bytes each; more are joined in blocks of items.
MAX_SEEDS = 500_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _zip(a: Column, b: Column, *more: Column) -> Column:
    """Hashes of what stands at equal places, as long as the shorter array."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.xxhash64(x, y, *more))


def _with_seeds(df: DataFrame) -> DataFrame:
    """Adds seeds: for each mask in turn, the hash at each start position."""
    for gap in sorted({gap for gap, _ in MASKS.values()}):
        df = df.withColumn(f"pair_{gap}", _zip(F.col("h"), _shifted(F.col("h"), gap)))
    each = [_zip(F.col(f"pair_{gap}"), _shifted(F.col(f"pair_{gap}"), apart), F.lit(k)) for k, (gap, apart) in enumerate(MASKS.values())]
    return df.withColumn("seeds", F.concat(*each)).drop(*[c for c in df.columns if c.startswith("pair_")])


def _first_index(n: Column, mask: Column) -> Column:
    """Where the seeds of a mask begin in seeds, for n tokens."""
    counts = [F.greatest(n - (len(m) - 1), F.lit(0)) for m in MASKS]
    starts = [functools.reduce(operator.add, counts[:k], F.lit(0)) for k in range(len(MASKS))]
    return F.element_at(F.array(*starts), mask + 1)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, similarity: float = 0.8, least_tokens: int = SPAN, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """Overlaps of documents with benchmark items, tolerant to substituted tokens.

    Returns one row per document id and item with an overlap: doc_id, item_id, matched (equal
    tokens in the best window), window (its tokens), similarity, item_pos and doc_pos (its token
    positions), n_seeds (runs of seed hits that were verified).

    Tokens are runs of letters and digits, lower-cased. Fixed masks over 5, 6 and 8 tokens leave
    out some positions; equal hashes of the rest in a document and an item are a hit. Only the
    leftmost of hits that follow each other on one diagonal is verified: around it, some window of
    13 aligned tokens (the whole item if shorter) must have 80 percent of its tokens equal.

    Seeds of the benchmark are broadcast, in blocks of items of at most max_seeds where there are
    more, so documents are never shuffled. With 80 percent of 13 tokens equal, at most two are
    substituted, and every place for them leaves a seed untouched; the same holds for windows of 8
    tokens or more. Items of under least_tokens are no evidence and match nothing; it may be as low
    as 5, where items of 5 to 7 tokens are found by the masks that fit them, that is, for certain only
    where they stand verbatim.

    Null or empty text: no match; very long texts are searched whole, in one row. Null ids group as one
    document or item; ties between windows: the first in the item, then in the document; repeated rows
    give one row. Empty tables: no rows. Other columns are not read.
    """
    if least_tokens < min(len(m) for m in MASKS):
        raise ValueError("no mask fits items so short")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.transform(tokens(F.col(item_text_col)), lambda t: F.xxhash64(t)).alias("h"))
    items = items.filter(F.size("h") >= least_tokens).distinct().withColumn("item", F.xxhash64("item_id", "h"))
    seeds = _with_seeds(items).select("item", F.size("h").alias("n"), F.col("seeds").alias("all"), F.posexplode("seeds").alias("at", "seed"))
    mask = functools.reduce(lambda c, k: F.when(F.col("at") >= _first_index(F.col("n"), F.lit(k)), F.lit(k)).otherwise(c), range(1, len(MASKS)), F.lit(0))
    seeds = seeds.withColumn("mask", mask).withColumn("item_at", F.col("at") - _first_index(F.col("n"), F.col("mask")))
    before = F.when(F.col("item_at") > 0, F.element_at("all", F.greatest(F.col("at"), F.lit(1))))
    seeds = staged(seeds.select("item", "seed", "mask", "item_at", before.alias("before")), "seeds")
    items = staged(items.withColumnRenamed("h", "item_h"), "items")
    blocks = max(1, -(-seeds.count() // max_seeds))

    read = docs.select(F.col(id_col).alias("doc_id"), F.transform(tokens(F.col(text_col)), lambda t: F.xxhash64(t)).alias("h"))
    read = _with_seeds(read)
    found = [_block(read, seeds.filter(F.pmod("item", F.lit(blocks)) == b), items.filter(F.pmod("item", F.lit(blocks)) == b), window, similarity) for b in range(blocks)]
    both = functools.reduce(DataFrame.unionByName, found)
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "window", (-F.col("item_pos")).alias("i"), (-F.col("doc_pos")).alias("d"))).alias("b"), F.count("*").alias("n_seeds"))
    return best.select("doc_id", "item_id", F.col("b.matched"), F.col("b.window"), (F.col("b.matched") / F.col("b.window")).alias("similarity"), (-F.col("b.i")).alias("item_pos"), (-F.col("b.d")).alias("doc_pos"), "n_seeds")


def _block(read: DataFrame, seeds: DataFrame, items: DataFrame, window: int, similarity: float) -> DataFrame:
    # size checked: at most max_seeds rows of numbers, besides what one item has above that
    # outer, as else Spark puts a filter on the array's size below and computes the array again for it
    hits = read.select("doc_id", "h", "seeds", F.posexplode_outer("seeds").alias("at", "seed")).join(F.broadcast(seeds), "seed")
    hits = hits.withColumn("doc_at", F.col("at") - _first_index(F.size("h"), F.col("mask")))
    follows = F.col("before").isNotNull() & (F.col("doc_at") > 0) & (F.get("seeds", F.col("at") - 1) == F.col("before"))
    hits = hits.filter(~F.coalesce(follows, F.lit(False))).select("doc_id", "h", "item", "item_at", "doc_at")
    hits = hits.join(F.broadcast(items), "item")
    size = F.least(F.size("item_h"), F.lit(window))
    # equal[k]: whether the item's token low + k stands in the document; beyond the text: not equal
    low, high = F.greatest(F.col("item_at") - size + 1, F.lit(0)), F.least(F.size("item_h") - size, F.col("item_at"))
    equal = F.transform(F.sequence(low, high + size - 1), lambda k: F.coalesce(F.when(F.col("doc_at") - F.col("item_at") + k >= 0, F.get("h", F.col("doc_at") - F.col("item_at") + k)) == F.get("item_h", k), F.lit(False)))
    hits = hits.select("doc_id", "item_id", "item_at", "doc_at", size.alias("window"), low.alias("low"), equal.alias("equal"))
    scored = F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("window") + 1), lambda s: F.struct(F.size(F.filter(F.slice("equal", s, F.col("window")), lambda x: x)).alias("m"), (-s).alias("s")))
    hits = hits.select("doc_id", "item_id", "item_at", "doc_at", "window", "low", F.array_max(scored).alias("best"))
    hits = hits.filter(F.col("best.m") >= F.ceil(F.lit(similarity) * F.col("window")))
    start = F.col("low") - F.col("best.s") - 1
    return hits.select("doc_id", "item_id", F.col("best.m").alias("matched"), "window", start.alias("item_pos"), (start + F.col("doc_at") - F.col("item_at")).alias("doc_pos"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text overlaps a benchmark item, by find_overlaps().

    The decision depends on the text alone, so rows with null or repeated ids are treated alike. Null and
    empty texts stay; very long ones are searched whole. Empty tables: nothing goes. Columns stay as they
    are, with any names.
    """
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    # written, so that Spark knows its size: where few texts go, documents aren't shuffled
    found = staged(find_overlaps(texts, benchmark, id_col="key").select("doc_id").distinct(), "contaminated")
    return docs.join(found, key == found["doc_id"], "left_anti")
