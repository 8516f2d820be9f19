"""Audit of filters that follow one another, over all their orders."""

from __future__ import annotations

from collections import Counter
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorehive.llm.common import WORD, staged

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MEASURES = ("removed", "good_lost", "toxic_lost")


def failures(text: Column) -> list[Column]:
    """Whether a text fails A to D: few words, repeated words, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def removal_intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, first rank, end rank) of the orders, by lexicographic rank, in which a row that fails the
    filters of mask goes at a step.

    Orders that begin alike are an interval of ranks: the Lehmer digits of the beginning (how many
    filters not used yet are before each) give its first rank, what is open its length. A beginning
    of filters that the row passes goes on, and ends with the first one that it fails.
    """
    found, begun = [], [((), 0)]
    while begun:
        used, first = begun.pop()
        free = [k for k in range(len(FILTERS)) if k not in used]
        length = factorial(len(free) - 1)
        for digit, k in enumerate(free):
            start = first + digit * length
            if mask >> k & 1:
                found.append((len(used) + 1, start, start + length))
            elif len(free) > 1:
                begun.append(((*used, k), start))
    return found


def difference_arrays() -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, change) for all masks: at these ranks a removal at the step begins (1) or ends (-1)."""
    out = []
    for mask in range(1 << len(FILTERS)):
        change: Counter[tuple[int, int]] = Counter()
        for step, start, end in removal_intervals(mask):
            change[step, start] += 1
            change[step, end] -= 1
        out += [(mask, step, rank, n) for (step, rank), n in sorted(change.items()) if n and rank < len(ORDERS)]
    return out


def failure_masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of each part fail just the filters of mask, and how many
    of these are labelled good or toxic. Bit k of mask is filter k."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.lit(0)
    for k, fails in enumerate(failures(F.col("text"))):
        own = own + F.when(fails, 1 << k).otherwise(0)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = staged(rows.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "failures")
    known = rows.filter("doc_id is not null")
    # a text's first id, not its rows, meets the others: a text that many rows have is no hot key
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = known.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    known = known.select("part", (F.col("own") + F.when(F.col("first").isNull(), 1 << 4).otherwise(0)).alias("mask"), "good", "toxic")
    rest = rows.filter("doc_id is null").select("part", F.col("own").alias("mask"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.unionByName(rest).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit_orders(masks: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from masks(part, mask, n, good, toxic).

    Each mask adds its count where the ranks of a removal step begin and takes it off where they end; a
    running sum over the 120 ranks gives what goes at each step of each order. From here on the
    work is the number of parts times 600, however many rows there are.
    """
    spark = masks.sparkSession
    masks = staged(masks, "masks")
    # some 900 rows, whatever the input
    changes = spark.createDataFrame(difference_arrays(), "mask int, step int, rank int, change int")
    ends = masks.join(F.broadcast(changes), "mask").select("part", "step", "rank", *[(F.col(n) * F.col("change")).alias(m) for n, m in zip(("n", "good", "toxic"), MEASURES)])
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) > 0, F.col("n")).otherwise(0)) for k in range(len(FILTERS))]
    only = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(FILTERS))]
    parts = masks.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*only).alias("only"))
    zero = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    zero = zero.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(m) for m in MEASURES])
    # partitioned by part alone, which serves the sums and all windows
    cells = ends.unionByName(zero).repartition("part").groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in MEASURES])
    by_rank = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("part", "step", "rank", *[F.sum(m).over(by_rank).alias(m) for m in MEASURES]).join(parts, "part")
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("rank") + 1)
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    cells = cells.withColumn("filter_order", order).withColumn("filter", F.instr(F.lit(FILTERS), letter))
    by_step = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(by_step)).alias("kept"), "removed", (F.element_at("fails", F.col("filter")) - F.col("removed")).alias("redundant"),
        F.element_at("only", F.col("filter")).alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each of five filters removes in each part, at each step of each of their 120 orders.

    Filters: A under 50 words, B under 65 % distinct words, C over 5 % capitals, D a symbol, E the same
    text as a row of a smaller id, removed or not. Columns: part, filter_order, step, kept (after the
    step), removed, redundant (failing the filter, removed before), unique_fails (failing it alone),
    good_lost and toxic_lost (removed, labelled so), shapley (what the filter removes, summed over all
    orders).

    Null and empty texts: the same empty text. Null part: an empty one. Null ids: are no copies, have no
    copies and no label. Rows of one id are no copies of each other. Several labels of an id: good or
    toxic if one says so; null labels say nothing. Very long texts: whole. Empty table: no rows. Other
    columns are not read.
    """
    return audit_orders(failure_masks(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))
