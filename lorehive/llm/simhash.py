"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehive.llm.common import staged
from lorehive.llm.components import connected

RADIUS = 3
#: Reference fingerprints: bytes of 0 or 1 bits in eight different layouts.
PIVOTS = [0x0000000000000000, 0x00000000FFFFFFFF, 0x0000FFFF0000FFFF, 0x00FF00FF00FF00FF, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555, 0x6996966996696996]
#: Fingerprints of a bucket that are compared in one task; larger buckets are split by more bits.
MAX_BUCKET = 4096


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the lower-cased words' 3-word shingles; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - 2)
    ends = ends[2:] if len(words) > 2 else ends[-1:]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    starts, ends = starts.tolist(), ends.tolist()
    for at in range(0, n, 65536):
        h = np.array([digest(line[s:e], 42) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536])], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def _parts(bits: list[int], n: int) -> list[int]:
    """bits in n runs of about equal length, as masks."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: Two of five parts: with three bits different at most, two parts are equal.
MASKS = sorted(_signed(a | b) for a, b in combinations(_parts(list(range(64)), 5), 2))


def _finer(masks: list[int]) -> dict[int, list[int]]:
    """Of the bits that a mask leaves free, four parts: one of them is equal too."""
    return {m: [_signed((m & (2**64 - 1)) | p) for p in _parts([b for b in range(64) if not m >> b & 1], RADIUS + 1)] for m in masks}


def _pivot_table(fp: Column) -> Column:
    """The Hamming distances to the eight pivots, a byte each."""
    table = F.lit(0).cast("long")
    for k, p in enumerate(PIVOTS):
        table = table.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long"), 8 * k))
    return table


def _linked(group: pd.DataFrame) -> pd.DataFrame:
    """Of rows in order of bucket and first pivot distance: each fingerprint that has a link within
    its bucket, and the first one that it reaches there."""
    fp = group["fp"].to_numpy().view(np.uint64)
    table = group["pivots"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8).astype(np.int16)
    bucket = group["bucket"].to_numpy()
    label, live, apart = np.arange(len(fp)), np.arange(len(fp)), 0
    while len(live):
        apart += 1
        live = live[live + apart < len(fp)]
        other = live + apart
        # sorted by the first distance: once it differs too much, it does for all that follow
        keep = (bucket[live] == bucket[other]) & (table[other, 0] - table[live, 0] <= RADIUS)
        live = live[keep]
        i, j = live, live + apart
        near = np.abs(table[i] - table[j]).max(axis=1) <= RADIUS if len(i) else np.zeros(0, bool)
        i, j = i[near], j[near]
        same = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
        i, j = i[same], j[same]
        while len(i):
            a, b = label[i], label[j]
            m = np.minimum(a, b)
            np.minimum.at(label, a, m)
            np.minimum.at(label, b, m)
            while (label != (up := label[label])).any():
                label = up
            differ = label[i] != label[j]
            i, j = i[differ], j[differ]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[label[moved]].view(np.int64)})


def _links_in_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        change = (batch["mask"].to_numpy()[1:] != batch["mask"].to_numpy()[:-1]) | (batch["value"].to_numpy()[1:] != batch["value"].to_numpy()[:-1])
        batch["bucket"] = np.concatenate(([0], np.cumsum(change)))
        last = batch["bucket"] == batch["bucket"].iloc[-1]
        rest = batch[last].drop(columns="bucket")
        yield _linked(batch[~last].reset_index(drop=True))
    if rest is not None:
        yield _linked(rest.assign(bucket=0).reset_index(drop=True))


def near_links(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints fp within RADIUS bits.

    Fingerprints meet in buckets of two equal parts of five. A bucket of more than max_bucket is
    split by four parts of its free bits, and so on: after five rounds at most 13 bits are free, so
    no bucket ever exceeds 8192. In a bucket, pairs are discarded by the largest difference of their
    pivot distances, and the survivors verified; a group of copies gives a star, not all pairs.
    """
    fps = fps.select("fp", _pivot_table(F.col("fp")).alias("pivots"))
    masks = MASKS
    rows = fps.select("fp", "pivots", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    done = None
    for level in range(6):
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        large = rows.groupBy("mask", "value").count().filter(F.col("count") > max_bucket).drop("count")
        if level == 5 or large.isEmpty():
            break
        large = staged(large, "large-buckets")
        ready = rows.join(large, ["mask", "value"], "left_anti")
        done = ready if done is None else done.unionByName(ready)
        finer = _finer(masks)
        # at most 10 * 4**level rows
        split = fps.sparkSession.createDataFrame([(m, p) for m, parts in finer.items() for p in parts], "mask long, part long")
        again = rows.join(large, ["mask", "value"], "left_semi").join(F.broadcast(split), "mask")
        rows = staged(again.select("fp", "pivots", F.col("part").alias("mask")).distinct(), "finer-buckets")
        masks = sorted({p for parts in finer.values() for p in parts})
    rows = rows if done is None else done.select(rows.columns).unionByName(rows)
    near = F.col("pivots").bitwiseAND(F.lit(255))
    rows = rows.repartition("mask", "value").sortWithinPartitions("mask", "value", near, "fp")
    return rows.mapInPandas(_links_in_buckets, "a long, b long").distinct()


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long), root and component_id for each row of docs.

    Rows of equal fingerprints are one node, so copies are never paired. component_id is the
    smallest id that is reachable over links of RADIUS bits at most, root the component's least
    fingerprint.

    Null, empty or blank text: fingerprint 0, linked like any other. Null ids are reachable but
    never smallest; a component of null ids alone has a null component_id. Repeated rows each get
    a row. Very long texts: fingerprinted whole, 65,536 shingles at a time. Empty table: no rows. Other
    columns are not read.
    """
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")), "fingerprints")
    return rows.join(component_of(rows), "fp").select("doc_id", "fp", "root", "component_id")


def component_of(rows: DataFrame) -> DataFrame:
    """fp, root, component_id for each distinct fingerprint of rows(doc_id, fp)."""
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    stars = connected(near_links(nodes.select("fp")))
    rooted = nodes.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def simhash_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest id (of equal ids, the least text).

    Null, empty and blank texts have fingerprint 0 and are one component. A component of null ids
    alone keeps one of them. Repeated rows: one stays. Very long texts: fingerprinted whole. Empty
    table: no rows. Columns stay as they are, with any names.
    """
    # texts are found again by their hash, as that is cheaper than their fingerprint
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), fingerprints(F.col(text_col)).alias("fp")), "fingerprints")
    known = rows.join(component_of(rows), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # what is left of a component are rows of one id, so a text that many documents have is no hot key
    known = known.groupBy("root").agg(F.min(F.struct("key", "doc_id")).alias("x")).select("x.key", F.col("x.doc_id").alias("id"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"))
    found = marked.join(known, (marked["key"] == known["key"]) & F.col("doc")[id_col].eqNullSafe(known["id"]))
    # rows that repeat both id and text
    first = F.row_number().over(Window.partitionBy(known["key"], known["id"]).orderBy(F.lit(0)))
    return found.withColumn("nth", first).filter("nth = 1").select("doc.*")
