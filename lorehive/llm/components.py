"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehive.llm.common import staged


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Links every node to the least of its neighbours: all of them (large), or the lesser ones."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = near.join(least, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
    return out.filter("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(a, b) links of numbers to (a, b): each linked node but the least of its component, and that.

    Alternates large-star and small-star steps until nothing changes; each step is a join and an
    aggregation on nodes and is written to the shared folder.
    """
    links = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    while True:
        now = links.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return links
        seen = now
        links = staged(_stars(_stars(links, True), False), "links")
