"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorehive.llm.common import hash_unit, n_words, staged

RANK_BUCKETS = 4096


def _shares(sources: DataFrame, weights: tuple[int, ...], budget: float, cap: int) -> DataFrame:
    """Target words per source: weights share the budget, cap times the source's words at most.

    Resharing the excess by weight until none is above its cap has the closed form
    min(cap * words, c * weight) for one level c. Sources in order of cap * words / weight fill up
    first, so c is found by running sums over that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", pick).withColumn("cap", F.col("source_size").cast("double") * cap)
    s = s.withColumn("fills_at", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("fills_at", "key").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * budget)
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    s = s.withColumn("c", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "key", "level"))).over(Window.partitionBy())["level"])
    return s.select("key", "source_size", F.least("cap", F.coalesce(F.col("c") * F.col("weight"), F.col("cap"))).alias("target"))


def _rates(classes: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Copies expected per document of each size class, so that a source's words meet its target.

    A class of documents of 2**k words or more has the relative rate sqrt(2**k), cap at most.
    The largest classes reach the cap first; the rest share what remains.
    """
    c = classes.filter("size_class > 0").join(targets, "key")
    down = Window.partitionBy("key").orderBy(F.col("size_class").desc())
    up_to = down.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("tilt", F.sqrt(F.col("size_class").cast("double")))
    c = c.withColumn("tilted", F.col("words") * F.col("tilt"))
    c = c.withColumn("capped", F.coalesce(F.sum("words").over(up_to), F.lit(0)) * cap)
    c = c.withColumn("rest", F.sum("tilted").over(down.rowsBetween(0, Window.unboundedFollowing)))
    c = c.withColumn("level", (F.col("target") - F.col("capped")) / F.col("rest"))
    fits = F.col("level") * F.col("tilt") <= cap
    c = c.withColumn("c", F.max(F.when(fits, F.struct("size_class", "level"))).over(Window.partitionBy("key"))["level"])
    rate = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.coalesce(F.col("c") * F.col("tilt"), F.lit(float(cap)))))
    return c.select("key", "size_class", "words", rate.alias("rate"))


def pareto_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """Copies of each document for a mix of sources by weight.

    Returns doc_id, source, size (words), source_size, target, copies and taken = copies * size,
    one row per row of docs. Every document has an expected number of copies: its whole part is
    allocated for certain, and the fraction pi is its inclusion probability in a Pareto order
    sample: documents rank by (u / (1 - u)) / (pi / (1 - pi)) with u from a hash of the id, and
    are taken in this order until the source's remaining words are met, to the nearest document.

    The rank order is never sorted whole: sums by rank bucket find the bucket where the target is
    met, and only that bucket's rows (one in 4096) are ordered.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last. Null and repeated
    ids are separate documents; equal ids of equal size tie and are interchangeable. Very long texts are
    counted whole. Targets are worked out in one task over a row per source. An empty table gives no rows. Other columns of docs are not read.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    size = n_words(F.col(text_col))
    sized = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), size.alias("size")), "mix-sizes")
    power = F.when(F.col("size") > 0, F.expr("shiftleft(1L, length(bin(size)) - 1)")).otherwise(F.lit(0))
    sized = sized.withColumn("size_class", power.cast("long")).withColumn("u", hash_unit(F.lit(seed), F.col("doc_id")))

    classes = sized.groupBy("key", "source", "size_class").agg(F.sum("size").alias("words"))
    classes = staged(classes, "mix-classes")
    sources = classes.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    targets = _shares(sources, weights, budget, cap)
    rates = staged(_rates(classes.select("key", "size_class", "words"), targets, cap), "mix-rates")
    certain = rates.groupBy("key").agg(F.sum(F.floor("rate") * F.col("words")).alias("certain"))
    targets = staged(targets.join(certain, "key", "left").withColumn("open", F.col("target") - F.coalesce("certain", F.lit(0))), "mix-targets")

    pi = F.col("rate") - F.floor("rate")
    q = (F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi))
    ranked = sized.join(rates.select("key", "size_class", "rate"), ["key", "size_class"], "left")
    ranked = ranked.withColumn("q", F.when(pi > 0, q)).withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * RANK_BUCKETS))
    ranked = ranked.withColumn("whole", F.coalesce(F.floor("rate"), F.lit(0)).cast("long"))
    sums = ranked.filter("bucket is not null").groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("after", F.sum("words").over(run)).withColumn("before", F.col("after") - F.col("words"))
    edge = sums.join(targets.select("key", "open"), "key").filter("before <= open and open < after").groupBy("key").agg(F.min("bucket").alias("edge"), F.min("before").alias("before"))
    limits = staged(targets.join(edge, "key", "left"), "mix-limits")

    joined = ranked.join(limits.select("key", "source_size", "target", "open", "edge", "before"), "key")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    line = Window.partitionBy("key").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = joined.filter(at_edge).withColumn("ahead", F.col("before") + F.sum("size").over(line) - F.col("size") / 2)
    last = last.withColumn("extra", (F.col("ahead") <= F.col("open")).cast("long")).drop("ahead")
    # no bucket holds the edge: all of the ranked words fit
    extra = F.coalesce(F.col("bucket").isNotNull() & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))) & (F.col("open") > 0), F.lit(False))
    other = joined.filter(~at_edge).withColumn("extra", extra.cast("long"))
    copies = F.col("whole") + F.col("extra")
    return other.unionByName(last).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
