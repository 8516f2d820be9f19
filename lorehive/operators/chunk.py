"""Blocks to chunks under a token budget, along the heading structure."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorehive.functions import text as X

TARGET, OVERLAP, LEAST = 800, 120, 150
LEVELS = range(1, 7)


def heading_paths(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """blocks with section (headings so far) and heading_path (of the section they are in). Without titles, blocks
    have their document's title themselves.

    A heading stays on the path until one of its level or above comes. So of each level only the
    last heading counts, and only if no heading above it in rank came later.
    """
    order = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks if titles is None else blocks.join(titles, "document_id", "left")
    rows = rows.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(order))
    for k in LEVELS:
        rows = rows.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("pos", "text")), ignorenulls=True).over(order))
    above, parts = F.lit(-1), []
    for k in LEVELS:
        at = F.coalesce(F.col(f"h{k}.pos"), F.lit(-1))
        parts.append(F.when(at > above, X.strip(F.col(f"h{k}.text"))))
        above = F.greatest(above, at)
    rows = rows.withColumn("parts", F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))).drop(*[f"h{k}" for k in LEVELS])
    known = F.coalesce(F.lower(F.get("parts", F.lit(0))) == F.lower(X.strip(F.col("title"))), F.lit(False))
    full = F.when(known | F.col("title").isNull(), F.col("parts")).otherwise(F.concat(F.array(X.strip(F.col("title"))), F.col("parts")))
    path = F.when(F.col("section") == 0, F.col("title")).otherwise(F.substring(F.array_join(full, " > "), 1, 1024))
    return rows.withColumn("heading_path", path).drop("parts", "title")


def sections(pathed: DataFrame) -> DataFrame:
    """document_id, section, heading_path, page, paragraphs (in order); only those with a body."""
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "text")))), lambda x: x["text"])
    page = F.coalesce(F.max(F.when(F.col("level") > 0, F.col("page"))), F.min_by("page", F.when(F.col("page").isNotNull() & (F.col("level") == 0), F.col("pos"))))
    out = pathed.groupBy("document_id", "section").agg(F.first("heading_path").alias("heading_path"), page.alias("page"), body.alias("paragraphs"))
    return out.filter(F.size("paragraphs") > 0)


def units(found: DataFrame, target: int = TARGET) -> DataFrame:
    """document_id, section, heading_path, page, unit (number), text, tokens: paragraphs, or their
    sentences if too long, or cuts of target tokens of sentences that still are."""
    # outer, as else Spark works each array out twice to filter on its size; nulls drop out at the end
    keep = ["document_id", "section", "heading_path", "page"]
    # what fits is handed on with its tokens, which are counted once
    sized = lambda text: F.struct(text.alias("text"), X.count_tokens(text).alias("tokens"))
    whole = F.when(F.col("tokens") <= target, F.array(F.struct("text", "tokens")))
    one = found.select(*keep, F.posexplode_outer("paragraphs").alias("p", "text")).withColumn("text", X.strip(F.col("text"))).withColumn("tokens", X.count_tokens(F.col("text")))
    one = one.withColumn("parts", whole.otherwise(F.transform(X.sentences(F.col("text")), sized)))
    one = one.select(*keep, "p", F.posexplode_outer("parts").alias("s", "x")).select(*keep, "p", "s", "x.*")
    # cuts fall before every target-th token: its start is the length of what the pattern matches up to there
    cuts = F.regexp_extract_all("text", F.lit(rf"(?s)(?:\s*(?:{X.TOKEN})){{1,{target}}}"), F.lit(0))
    one = one.withColumn("parts", whole.otherwise(F.transform(F.transform(cuts, X.strip), sized)))
    one = one.select(*keep, "p", "s", F.posexplode_outer("parts").alias("c", "x")).select(*keep, "p", "s", "c", "x.*").filter("text <> ''")
    order = Window.partitionBy("document_id").orderBy("section", "p", "s", "c")
    return one.select(*keep, F.row_number().over(order).alias("unit"), "text", "tokens")


@dataclass
class Piece:
    texts: list[str]
    tokens: int
    path: list[str] | None
    label: str | None
    page: int | None
    whole: bool = True

    @property
    def text(self) -> str:
        return "\n\n".join(self.texts).strip()

    def join(self, other: Piece, path: list[str], front: bool = False) -> None:
        self.texts = other.texts + self.texts if front else self.texts + other.texts
        self.tokens += other.tokens
        self.path, self.label = path, " > ".join(path) or None


def _shared(a: Piece, b: Piece) -> list[str]:
    n = 0
    while n < min(len(a.path), len(b.path)) and a.path[n] == b.path[n]:
        n += 1
    return a.path[:n]


def fill(rows: list[tuple[str, int]], target: int, overlap: int) -> list[tuple[list[str], int]]:
    """Units of one section in chunks of at most target tokens, each beginning with the last units
    of the one before that fit in overlap."""
    out: list[tuple[list[str], int]] = []
    start, size = 0, 0  # the open chunk is rows[start:k]

    def shut(k: int) -> None:
        nonlocal start, size
        out.append(([t for t, _ in rows[start:k]], size))
        first, size = k, 0
        while overlap > 0 and first > start and size + rows[first - 1][1] <= overlap:
            first -= 1
            size += rows[first][1]
        start = first

    for k, (_, n) in enumerate(rows):
        if start < k and size + n > target:
            shut(k)
        size += n
        if size >= target:
            shut(k + 1)
    rest = [t for t, _ in rows[start:]]
    if rest and not (out and "\n\n".join(rest) in "\n\n".join(out[-1][0])):
        out.append((rest, size))
    return out


def _fold(pieces: Iterable[Piece], joins: Callable[[Piece, Piece], bool]) -> list[Piece]:
    """Each piece into the one before it, wherever the two may join and share a parent."""
    out: list[Piece] = []
    for piece in pieces:
        path = _shared(out[-1], piece) if out and joins(out[-1], piece) else []
        if len(path) >= 2:
            out[-1].join(piece, path)
        else:
            out.append(piece)
    return out


def assemble(pieces: Iterable[Piece], target: int, least: int) -> list[Piece]:
    """One pass per rule: whole sections fill a chunk together; what is below least goes to the sibling
    before it; and a first chunk below least goes to the one after it, if that stands below its heading."""
    size = lambda a, b: a.tokens + b.tokens
    out = _fold(pieces, lambda a, b: a.whole and b.whole and size(a, b) <= target)
    out = _fold(out, lambda a, b: b.tokens < least and size(a, b) <= target * 1.3)
    if len(out) > 1 and out[0].tokens < least and size(*out[:2]) <= target * 1.3:
        first, second = out[:2]
        if len(second.path) > len(first.path) == len(_shared(first, second)):
            label = second.label
            second.join(first, first.path, front=True)
            second.label = second.label or label
            return out[1:]
    return out


PACKED = "document_id string, chunks array<struct<chunk_index: int, text: string, heading_path: string, page: int, token_count: int>>"
#: Documents that Python takes out of an Arrow batch at once.
HELD = 64


def packed(found: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """units() to document_id, chunks (structs of chunk_index, text, heading_path, page, token_count).

    Order decides what joins what, so a document's units are one row, and folded as such: HELD
    documents at once, of a batch that stays in Arrow.
    """
    piece = pa.struct([("chunk_index", pa.int32()), ("text", pa.string()), ("heading_path", pa.string()), ("page", pa.int32()), ("token_count", pa.int32())])

    def fold(units_: list[tuple]) -> list[Piece]:
        pieces = []
        for _, some in groupby(units_, key=lambda u: u[0]):
            rows = list(some)
            label, page = rows[0][1:3]
            path = [p.strip() for p in (label or "").split(">") if p.strip()]
            filled = fill([(text, tokens) for *_, text, tokens in rows], target, overlap)
            pieces += [Piece(texts, n, path, label, page, len(filled) == 1) for texts, n in filled]
        return assemble(pieces, target, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                some = batch.slice(at, HELD)
                units_ = some.column("units").flatten()
                rows = iter(zip(*[units_.field(c).to_pylist() for c in ("section", "heading_path", "page", "text", "tokens")]))
                done = [fold(list(islice(rows, n))) for n in pc.list_value_length(some.column("units")).to_pylist()]
                flat = [(k, p.text, p.label, p.page, p.tokens) for pieces in done for k, p in enumerate(pieces)]
                columns = [pa.array([x[c] for x in flat], f.type) for c, f in enumerate(piece)]
                ends = [0, *accumulate(map(len, done))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(piece)))
                yield pa.RecordBatch.from_arrays([some.column("document_id"), lists], names=["document_id", "chunks"])

    unit = F.struct("section", "unit", "heading_path", F.col("page").cast("int").alias("page"), "text", "tokens")
    return found.groupBy(F.col("document_id").cast("string").alias("document_id")).agg(F.sort_array(F.collect_list(unit)).alias("units")).mapInArrow(run, PACKED)


def chunks(found: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """units() to chunks: document_id, chunk_index, text, heading_path, page, token_count."""
    return packed(found, target, overlap, least).select("document_id", F.inline("chunks"))


def with_own_ids(found: DataFrame) -> DataFrame:
    """with_ids() of packed(): repeats and numbers are seen to within a document's row, so nothing is shuffled."""
    hashed = F.transform("chunks", lambda c: F.struct(F.sha2(X.chunk_embedding_text(c["heading_path"], c["text"]), 256).alias("h"), c.alias("c")))
    first = X.let(hashed, lambda cs: X.let(F.transform(cs, lambda x: x["h"]), lambda hs: F.filter(cs, lambda x, i: F.array_position(hs, x["h"]) == i + 1)))
    # outer, as else Spark works the array out once more to filter on its size
    rows = found.select("document_id", F.posexplode_outer(first).alias("chunk_index", "x")).filter("x is not null")
    return rows.select("document_id", "chunk_index", "x.c.text", "x.c.heading_path", "x.c.page", "x.c.token_count", F.col("x.h").alias("content_hash"), X.chunk_id(F.col("document_id"), F.col("x.h")).alias("chunk_id"))


def with_ids(found: DataFrame) -> DataFrame:
    """Adds content_hash and chunk_id, drops repeats within a document, and numbers the rest anew."""
    hashed = found.withColumn("content_hash", F.sha2(X.chunk_embedding_text(F.col("heading_path"), F.col("text")), 256))
    # dealt out once, for both windows
    hashed = hashed.withColumn("chunk_id", X.chunk_id(F.col("document_id").cast("string"), F.col("content_hash"))).repartition("document_id")
    first = F.row_number().over(Window.partitionBy("document_id", "chunk_id").orderBy("chunk_index"))
    once = hashed.withColumn("nth", first).filter("nth = 1").drop("nth")
    return once.withColumn("chunk_index", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1)


def leads(found: DataFrame) -> DataFrame:
    """document_id, summary: the head of the first chunk of 120 characters or more, where there is one."""
    body = found.select("document_id", "chunk_index", F.explode(F.array(X.collapse(F.col("text")))).alias("body")).filter(F.length("body") >= 120)
    return body.withColumn("body", X.lead_text(F.col("body"))).groupBy("document_id").agg(F.min_by("body", "chunk_index").alias("summary"))


def summaries(found: DataFrame, flat: DataFrame) -> DataFrame:
    """document_id, summary: the lead of a document's chunks, else the whole text's head."""
    head = flat.select("document_id", X.lead_text(X.collapse(F.col("text"))).alias("head"))
    return head.join(leads(found), "document_id", "left").select("document_id", F.coalesce("summary", "head").alias("summary"))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"), F.max("page").alias("page_count"), F.sum("token_count").alias("token_count"))
