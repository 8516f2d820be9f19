"""Text and layout words to blocks of headings and paragraphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorehive.functions import text as X

# Fixed patterns of headings.
MARKDOWN = r"^(#{1,6})\s+(.*\S)\s*$"
UNDER_1, UNDER_2 = r"^={3,}\s*$", r"^-{3,}\s*$"
NUMBERED = r"^\s*(?:(\d+(?:\.\d+)+)\.?|(\d+)[.)])\s+(\S.{0,80})$"


def lines(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """document_id, pos, line, next_line, and whether the document has a markdown heading.

    All of it is worked out within the document's row, so lines need no shuffle.
    """
    split = F.split(F.translate(F.col(text_col), "\u0000", ""), "\n", -1)
    row = docs.select("document_id", *keep, split.alias("lines"))
    pairs = F.zip_with("lines", F.expr("slice(lines, 2, size(lines))"), lambda a, b: F.struct(a.alias("line"), F.coalesce(b, F.lit("")).alias("next_line")))
    row = row.select("document_id", *keep, F.exists("lines", lambda x: x.rlike(MARKDOWN)).alias("explicit"), pairs.alias("pairs"))
    # outer, as else Spark filters on the array's size first and works the array out again for it
    return row.select("document_id", *keep, "explicit", F.posexplode_outer("pairs").alias("pos", "x")).filter("pos is not null").select("document_id", *keep, "explicit", "pos", "x.line", "x.next_line")


def heading(line: Column, next_line: Column, explicit: Column) -> Column:
    """struct(level, text), or null: markdown; then, where the document has no markdown heading:
    underlined, numbered, and all-capital lines."""
    bare = X.strip(line)
    of = lambda level, text: F.struct(level.cast("int").alias("level"), text.alias("text"))
    number = F.concat(F.regexp_extract(line, NUMBERED, 1), F.regexp_extract(line, NUMBERED, 2))
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    capitals = (F.length(bare) <= 80) & (F.upper(bare) == bare) & bare.rlike(r"\p{L}") & ~bare.rlike(r"[.,]\z")
    return (
        F.when(line.rlike(MARKDOWN), of(F.length(F.regexp_extract(line, MARKDOWN, 1)), F.regexp_extract(line, MARKDOWN, 2)))
        .when(explicit | (bare == ""), F.lit(None))
        .when(next_line.rlike(UNDER_1), of(F.lit(1), bare))
        .when(next_line.rlike(UNDER_2) & ~bare.startswith("-"), of(F.lit(2), bare))
        .when(line.rlike(NUMBERED) & ~bare.rlike(r"[.,;:]\z"), of(F.least(dots + 1, F.lit(6)), bare))
        .when(capitals, of(F.lit(2), bare))
    )


def _gather(marked: DataFrame, joint: str, page: Column, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Blocks from rows with pos, line, h (heading or null) and cut (whether a paragraph ends here).

    A running count of what ends a paragraph numbers the islands between; each island's lines are
    joined in order.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    ends = (F.col("cut") | F.col("h").isNotNull()).cast("int")
    # a heading begins an island of its own, and so does what follows it
    island = F.sum(ends).over(order) * 2 + F.when(F.col("h").isNotNull(), 0).otherwise(1)
    rows = marked.withColumn("island", island).filter(~F.col("cut"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), joint)
    blocks = rows.groupBy(*keys, "island").agg(F.min("pos").alias("pos"), F.min_by(page, "pos").alias("page"), F.min_by("h", "pos").alias("h"), text.alias("body"))
    body = F.when(F.col("h").isNotNull(), F.col("h.text")).otherwise(X.strip(F.col("body")))
    return blocks.select(*keys, "pos", body.alias("text"), F.coalesce("h.level", F.lit(0)).alias("level"), "page").filter("text <> ''")


BLOCK = "struct<pos: int, text: string, level: int, page: int>"


def block_lists(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """document_id, blocks (structs of pos, text, level and page, in order). All of it is worked out within the
    document's row."""
    split = F.split(F.translate(F.col(text_col), "\u0000", ""), "\n", -1)
    row = docs.select("document_id", split.alias("lines")).withColumn("explicit", F.exists("lines", lambda x: x.rlike(MARKDOWN)))
    headed = lambda x, i: F.struct(i.alias("pos"), x.alias("line"), heading(x, F.coalesce(F.get("lines", i + 1), F.lit("")), F.col("explicit")).alias("h"))
    kept = F.filter(F.transform("lines", headed), lambda x: x["h"].isNotNull() | ~(x["line"].rlike(UNDER_1) | x["line"].rlike(UNDER_2)))
    marked = F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("pos", "line", "h")], (x["h"].isNull() & (X.strip(x["line"]) == "")).alias("cut")))

    return row.select("document_id", _joined(marked, "\n", lambda first: F.lit(None).cast("int")).alias("blocks"))


def _joined(marked: Column, joint: str, page: Callable[[Column], Column]) -> Column:
    """What _gather() does, of an array of structs of pos, line, h and cut, in order: a block begins after what ends
    a paragraph, and goes to where the next one begins."""

    def begins(m: Column) -> Column:
        new = lambda x, last: ~x["cut"] & (last.isNull() | last["cut"] | last["h"].isNotNull() | x["h"].isNotNull())
        return F.filter(F.transform(m, lambda x, i: F.when(new(x, F.get(m, i - 1)), i)), lambda i: i.isNotNull())

    def block(m: Column, at: Column, i: Column, k: Column) -> Column:
        some = F.filter(F.slice(m, i + 1, F.coalesce(F.get(at, k + 1), F.size(m)) - i), lambda x: ~x["cut"])
        first = F.get(m, i)
        text = F.when(first["h"].isNotNull(), first["h"]["text"]).otherwise(X.strip(F.array_join(F.transform(some, lambda x: x["line"]), joint)))
        return F.struct(first["pos"].alias("pos"), text.alias("text"), F.coalesce(first["h"]["level"], F.lit(0)).alias("level"), page(first).alias("page"))

    found = X.let(marked, lambda m: X.let(begins(m), lambda at: F.transform(at, lambda i, k: block(m, at, i, k))))
    return F.filter(found, lambda b: b["text"] != "")


def blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """document_id, pos (of the first line), text, level (0: body), page (null)."""
    return unpacked(block_lists(docs, text_col))


def unpacked(lists: DataFrame, *keep: str, column: str = "blocks") -> DataFrame:
    """The blocks of block_lists(), a row each, with the columns of the document that are named."""
    # outer, as else Spark filters on the array's size first and works the array out again for it
    return lists.select("document_id", *keep, F.explode_outer(column).alias("x")).filter("x is not null").select("document_id", *keep, "x.*")


def titles(docs: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, title: the first heading, else the filename's stem with _ and - as spaces."""
    first = found.filter("level > 0").groupBy("document_id").agg(F.min_by("text", "pos").alias("heading"))
    return docs.select("document_id", "filename").join(first, "document_id", "left").select("document_id", title(F.col("heading"), F.col("filename")).alias("title"))


def title(heading_: Column, filename: Column) -> Column:
    return F.coalesce(heading_, F.translate(F.regexp_replace(filename, r"\.[^.]*\z", ""), "_-", "  "))


def without_body(docs: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, reason: no_text (no block at all) or headings_only; neither gives a chunk."""
    some = found.groupBy("document_id").agg(F.bool_or(F.col("level") == 0).alias("body"))
    out = docs.select("document_id").join(some, "document_id", "left").filter("not coalesce(body, false)")
    return out.select("document_id", F.when(F.col("body").isNull(), "no_text").otherwise("headings_only").alias("reason"))


def flat_text(found: DataFrame) -> DataFrame:
    """document_id, text (blocks with blank lines between), char_count."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    return found.groupBy("document_id").agg(joined.alias("text")).withColumn("char_count", F.length("text"))


def facts(lists: DataFrame, *keep: str) -> DataFrame:
    """What flat_text(), titles() and without_body() say of block_lists(), within the document's row: document_id,
    text and char_count (null without a block), heading (the first one, or null) and reason (or null)."""
    blocks_, some = F.col("blocks"), F.size("blocks") > 0
    flat = F.when(some, F.array_join(F.transform(blocks_, lambda b: b["text"]), "\n\n"))
    heading_ = F.get(F.filter(blocks_, lambda b: b["level"] > 0), F.lit(0))["text"]
    reason = F.when(~F.coalesce(some, F.lit(False)), "no_text").when(~F.exists(blocks_, lambda b: b["level"] == 0), "headings_only")
    return lists.select("document_id", *keep, flat.alias("text"), heading_.alias("heading"), reason.alias("reason")).withColumn("char_count", F.length("text"))


def _median(values: Column) -> Column:
    """Of an array of numbers without nulls; null if there are none."""
    # the two in the middle, which are one where their number is odd
    mid = lambda v, k: F.get(v, F.floor((F.size(v) - k) / 2).cast("int"))
    return X.let(F.sort_array(values), lambda v: F.when(mid(v, 1) == mid(v, 0), mid(v, 0)).otherwise(mid(v, 1) * 0.5 + mid(v, 0) * 0.5))


def line_lists(docs: DataFrame) -> DataFrame:
    """docs(document_id, words: structs of page, top, x0, text and size) to their visual lines: document_id, lines
    (structs of page, row, line and size, in order; size: the median of the positive sizes, else 1). All of it is
    worked out within the document's row, so words need no shuffle."""
    keyed = F.transform("words", lambda w: F.struct(w["page"].alias("page"), F.bround(w["top"] / 3.0).cast("int").alias("row"), w["x0"].alias("x0"), w["text"].alias("text"), w["size"].cast("double").alias("size")))
    apart = lambda x, last: ~(x["page"].eqNullSafe(last["page"]) & x["row"].eqNullSafe(last["row"]))
    begins = lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | apart(F.get(m, i), F.get(m, i - 1)))

    def line(first: Column, some: Column) -> Column:
        said = F.trim(F.array_join(F.transform(some, lambda w: w["text"]), " "))
        size = F.coalesce(_median(F.filter(F.transform(some, lambda w: w["size"]), lambda z: z > 0)), F.lit(1.0))
        return F.struct(first["page"].alias("page"), first["row"].alias("row"), said.alias("line"), size.alias("size"))

    part = lambda m, at, i, k: X.let(F.slice(m, i + 1, F.coalesce(F.get(at, k + 1), F.size(m)) - i), lambda some: line(F.get(m, i), some))
    found = X.let(F.sort_array(keyed), lambda m: X.let(begins(m), lambda at: F.transform(at, lambda i, k: part(m, at, i, k))))
    return docs.select("document_id", F.when(F.size("words") > 0, F.filter(found, lambda x: x["line"] != "")).alias("lines"))


def layout_lines(words: DataFrame) -> DataFrame:
    """The lines of line_lists(), a row each, from words(document_id, page, top, x0, text, size), a row each, which are
    shuffled once."""
    docs = words.groupBy("document_id").agg(F.collect_list(F.struct("page", "top", "x0", "text", "size")).alias("words"))
    return unpacked(line_lists(docs), column="lines")


def layout_block_lists(lists: DataFrame, only_sized: bool = False) -> DataFrame:
    """document_id, sized (whether any line is large), blocks from line_lists(), within the document's row. Lines over 1.15
    times the median size, in 120 characters at most, are large, and headings (from 1.4 times the median size:
    level 1); a document without any falls back to the patterns of plain text, or has null blocks if only_sized.

    All of it is one expression, in which each step is worked out once: as columns of their own, steps are put in
    wherever a filter or a lambda names them, and a line's heading then takes all lines once more."""
    large = lambda x, middle: (x["size"] > middle * 1.15) & (F.length(x["line"]) <= 120)

    def blocks_of(lines_: Column, middle: Column, sized: Column) -> Column:
        by_size = lambda x: F.when(large(x, middle), F.struct(F.when(x["size"] > middle * 1.4, 1).otherwise(2).alias("level"), x["line"].alias("text")))
        h = lambda x: F.when(sized, by_size(x)) if only_sized else F.when(sized, by_size(x)).otherwise(heading(x["line"], F.lit(""), F.lit(False)))
        marked = F.transform(lines_, lambda x, i: F.struct((i + 1).alias("pos"), x["line"].alias("line"), h(x).alias("h"), F.lit(False).alias("cut"), x["page"].alias("page")))
        found = _joined(marked, " ", lambda first: first["page"])
        return F.struct(sized.alias("sized"), (F.when(sized, found) if only_sized else found).alias("blocks"))

    def of(lines_: Column) -> Column:
        any_large = lambda middle: F.coalesce(F.exists(lines_, lambda x: large(x, middle)), F.lit(False))
        return X.let(_median(F.transform(lines_, lambda x: x["size"])), lambda middle: X.let(any_large(middle), lambda sized: blocks_of(lines_, middle, sized)))

    return lists.select("document_id", X.let(F.col("lines"), of).alias("x")).select("document_id", "x.sized", "x.blocks")


def layout_blocks(found: DataFrame) -> DataFrame:
    """The blocks of layout_block_lists(), a row each, from layout_lines()."""
    lists = found.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page", "row", "line", "size"))).alias("lines"))
    return unpacked(layout_block_lists(lists))


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """pages(document_id, page, text) to paragraphs at blank lines, white space collapsed."""
    parts = F.transform(F.split(F.col("text"), r"\n\s*\n", -1), X.collapse)
    return pages.select("document_id", "page", F.posexplode(parts).alias("pos", "text")).filter("text <> ''")


#: A parser of one kind of file: bytes and filename to (text, level, page) of each block, in order.
Parser = Callable[[bytes, str], Iterable[tuple[str, int, int | None]]]


def plugged_blocks(docs: DataFrame, parser: Parser) -> DataFrame:
    """docs(document_id, filename, content) to blocks() by a parser, with an error column: a file that
    the parser fails on has one row, without a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for document_id, filename, content in zip(batch["document_id"], batch["filename"], batch["content"]):
                try:
                    found = [(document_id, k, text.replace("\0", ""), level, page, None) for k, (text, level, page) in enumerate(parser(bytes(content), filename))]
                except Exception as e:  # noqa: BLE001  one broken file doesn't stop the others
                    found = [(document_id, None, None, None, None, f"{type(e).__name__}: {e}"[:2000])]
                rows += found
            yield pd.DataFrame(rows, columns=["document_id", "pos", "text", "level", "page", "error"]).astype({"pos": "Int64", "level": "Int64", "page": "Int64"})

    return docs.select("document_id", "filename", "content").mapInPandas(run, "document_id string, pos int, text string, level int, page int, error string")


def plugged_lists(docs: DataFrame, parser: Parser) -> DataFrame:
    """plugged_blocks() as block_lists(), with the error column; no row for a file without a block."""
    block = F.when(F.col("error").isNull(), F.struct("pos", "text", "level", "page"))
    return plugged_blocks(docs, parser).groupBy("document_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"), F.max("error").alias("error"))
