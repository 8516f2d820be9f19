"""Catalogue questions: tags, filters, paging, references, outlines, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorehive.functions import text as X
from lorehive.stage import staged


def add_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """tags with the normalised names that are new; names that normalise to nothing are left out."""
    new = names.select(X.normalize_tag(F.col("tag")).alias("tag")).filter("tag <> ''").distinct()
    return tags.select("tag").unionByName(new.join(tags, "tag", "left_anti"))


def tag_counts(links: DataFrame, documents: DataFrame, ready_only: bool = False) -> DataFrame:
    """tag, documents: by count, then name."""
    kept = documents.filter("status = 'ready'") if ready_only else documents
    return links.join(kept.select("document_id"), "document_id", "left_semi").groupBy("tag").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "tag")


def known_tags(asked: DataFrame, tags: DataFrame) -> DataFrame:
    """asked(query_id, tag) with known: whether the tag exists."""
    return asked.join(tags.select("tag", F.lit(True).alias("found")), "tag", "left").select("query_id", "tag", F.col("found").isNotNull().alias("known"))


def asked_tags(asked: DataFrame) -> DataFrame:
    """asked(query_id, tag) as it is looked up: normalised, once per query, without what normalises to nothing."""
    return asked.select("query_id", X.normalize_tag(F.col("tag")).alias("tag")).filter("tag <> ''").distinct()


def tag_report(asked: DataFrame, tags: DataFrame) -> DataFrame:
    """query_id, known_tags (their number) and unknown_tags (in order) of each query in asked(query_id, tag).

    Queries without any tag, or of null tags alone, know none and lack none. The vocabulary is
    joined by tag, so neither it nor the queries need to be small.
    """
    found = known_tags(asked_tags(asked), tags.distinct())
    per = found.groupBy("query_id").agg(F.count_if("known").alias("known_tags"), F.array_sort(F.collect_list(F.when(~F.col("known"), F.col("tag")))).alias("unknown_tags"))
    return asked.select("query_id").distinct().join(per, "query_id", "left").select("query_id", F.coalesce("known_tags", F.lit(0)).alias("known_tags"), F.coalesce("unknown_tags", F.array().cast("array<string>")).alias("unknown_tags"))


def tagged(asked: DataFrame, links: DataFrame, match_all: bool) -> DataFrame:
    """query_id, document_id of documents with any or all of a query's tags asked(query_id, tag)."""
    asked = asked.distinct()
    met = asked.join(links.distinct(), "tag")
    if not match_all:
        return met.select("query_id", "document_id").distinct()
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("wanted"))
    return met.groupBy("query_id", "document_id").agg(F.count("*").alias("n")).join(wanted, "query_id").filter("n = wanted").select("query_id", "document_id")


def name_contains(fragment: Column | str) -> Column:
    """Filename or title contain the fragment in any case; % and _ in it are wildcards."""
    fragment = F.lit(fragment) if isinstance(fragment, str) else fragment
    pattern = F.concat(F.lit("%"), F.lower(fragment), F.lit("%"))
    return F.like(F.lower("filename"), pattern) | F.coalesce(F.like(F.lower("title"), pattern), F.lit(False))


def page(documents: DataFrame, by: str = "recent", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of documents with its rank and the total before paging; recent or by name.

    Only offset + limit rows are sorted whole; the total is an aggregate of its own.
    """
    order = [F.desc("created_at"), "document_id"] if by == "recent" else [F.lower("filename"), "document_id"]
    total = documents.agg(F.count("*").alias("total"))
    return documents.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def paging_note(returned: Column, total: Column, offset: Column, corpus: Column) -> Column:
    """more, filtered_empty, corpus_empty or complete."""
    return F.when((returned == 0) & (corpus == 0), "corpus_empty").when(returned == 0, "filtered_empty").when(offset + returned < total, "more").otherwise("complete")


def with_tags(documents: DataFrame, links: DataFrame) -> DataFrame:
    tags = links.groupBy("document_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return documents.join(tags, "document_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def corpus_state(documents: DataFrame) -> DataFrame:
    """One row: state is ready, pending or empty."""
    some = documents.agg(F.coalesce(F.bool_or(F.col("status") == "ready"), F.lit(False)).alias("r"), F.coalesce(F.bool_or(F.col("status").isin("pending", "processing")), F.lit(False)).alias("p"))
    return some.select(F.when(F.col("r"), "ready").when(F.col("p"), "pending").otherwise("empty").alias("state"))


def _grams(text: Column) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda k: F.substring(text, k, F.lit(3)))).otherwise(F.array().cast("array<string>")))


def name_grams(documents: DataFrame) -> DataFrame:
    """gram, document_id: each document's runs of three characters in filename and title, in lower case. Stored in
    buckets by gram, it is the index that name_matches() reads."""
    names = F.array_distinct(F.concat(_grams(F.lower("filename")), F.coalesce(_grams(F.lower("title")), F.array().cast("array<string>"))))
    return documents.select(F.explode(names).alias("gram"), "document_id")


def name_matches(references: DataFrame, documents: DataFrame, grams: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """references(ref_id, needle) and the documents whose filename or title contain the needle, as
    name_contains() has it.

    Every name that a pattern matches has the pattern's runs of three plain characters. Documents are
    looked up by the rarest of them, and the pattern is tried on those found only. grams gives the rows of
    a stored name_grams() for a table of gram, so that no other names are read; without it all names are
    taken apart, once. What has no such run (short or wildcards alone) is tried on all documents, each such
    pattern once however many ask it.
    """
    refs = references.withColumn("low", F.lower("needle")).withColumn("grams", F.array_distinct(F.flatten(F.transform(F.split("low", r"[%_\\\\]+", -1), _grams))))
    asked = refs.select("ref_id", F.explode("grams").alias("gram"))
    wanted = asked.select("gram").distinct()
    met = name_grams(documents).join(wanted, "gram", "left_semi") if grams is None else grams(wanted)
    met = staged(met.select("gram", "document_id"), "met-grams")
    found = asked.join(met.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    # a gram that no document has is rarest of all, and finds none
    rarest = found.groupBy("ref_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    pairs = rarest.join(met, "gram").select("ref_id", "document_id").join(refs.select("ref_id", "needle"), "ref_id").join(documents, "document_id")
    bare = refs.filter(F.size("grams") == 0).select("ref_id", "needle")
    plain = documents.join(bare.select("needle").distinct(), name_contains(F.col("needle"))).join(bare, "needle")
    return pairs.filter(name_contains(F.col("needle"))).unionByName(plain)


def same_name(references: DataFrame, documents: DataFrame) -> DataFrame:
    """ref_id, document_id of every document whose filename is the needle of references(ref_id, needle),
    in any case: where resolve() names some candidates, this names all."""
    names = documents.select("document_id", F.lower("filename").alias("name"))
    return references.withColumn("name", F.lower("needle")).join(names, "name").select("ref_id", "document_id")


def resolve(references: DataFrame, documents: DataFrame, limit: int = 8, grams: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """references(ref_id, reference) to ref_id, document_id, matched_on, candidates.

    In order: id; filename (any case; ambiguous if several share it); fragment of filename or title,
    the newest 8, of which an exact title wins. matched_on is empty, ambiguous or none where there
    is no single document; candidates has the ids then, the least or newest 8 (same_name() has all).
    grams looks fragments up in a stored index (name_matches()).
    """
    refs = references.select("ref_id", X.strip(F.col("reference")).alias("needle"))
    docs = documents.select("document_id", "filename", "title", "created_at")
    none = F.array().cast("array<string>")
    in_order = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "document_id"))), lambda x: x["document_id"])
    asked = refs.filter("needle <> ''")
    empty = refs.filter("needle = ''").select("ref_id", F.lit(None).cast("string").alias("document_id"), F.lit("empty").alias("matched_on"), none.alias("candidates"))
    by_id = asked.join(docs, F.col("needle") == F.col("document_id")).select("ref_id", "document_id", F.lit("id").alias("matched_on"), none.alias("candidates"))
    rest = asked.join(by_id.select("ref_id"), "ref_id", "left_anti")
    least = F.row_number().over(Window.partitionBy("ref_id").orderBy("document_id"))
    named = same_name(rest, docs).withColumn("nth", least).filter(F.col("nth") <= limit).groupBy("ref_id").agg(in_order("nth").alias("ids"))
    single = F.size("ids") == 1
    by_name = named.select("ref_id", F.when(single, F.col("ids")[0]).alias("document_id"), F.when(single, "filename").otherwise("ambiguous").alias("matched_on"), F.when(single, none).otherwise(F.col("ids")).alias("candidates"))
    rest = rest.join(named.select("ref_id"), "ref_id", "left_anti")
    newest = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("created_at"), "document_id"))
    met = name_matches(rest, docs, grams).withColumn("nth", newest).filter(F.col("nth") <= limit)
    exact = F.lower(X.strip(F.coalesce("title", F.lit("")))) == F.lower("needle")
    parts = met.groupBy("ref_id").agg(in_order("nth").alias("ids"), F.collect_list(F.when(exact, F.col("document_id"))).alias("titled"))
    one, title = F.size("ids") == 1, F.size("titled") == 1
    by_part = parts.select(
        "ref_id", F.when(title, F.col("titled")[0]).when(one, F.col("ids")[0]).alias("document_id"),
        F.when(title, "title").when(one, "partial-name").otherwise("ambiguous").alias("matched_on"), F.when(one | title, none).otherwise(F.col("ids")).alias("candidates"),
    )
    found = by_id.unionByName(by_name).unionByName(by_part).unionByName(empty)
    missing = refs.join(found.select("ref_id"), "ref_id", "left_anti").select("ref_id", F.lit(None).cast("string").alias("document_id"), F.lit("none").alias("matched_on"), none.alias("candidates"))
    return found.unionByName(missing)


def distinct_documents(resolved: DataFrame) -> DataFrame:
    """resolved(query_id, position, document_id): each document once, at its first position."""
    return resolved.filter("document_id is not null").groupBy("query_id", "document_id").agg(F.min("position").alias("position"))


def outline(chunks: DataFrame) -> DataFrame:
    """document_id, heading_path, first_chunk_index, last_chunk_index, page: runs of equal paths."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    begins = ~F.coalesce(F.col("heading_path").eqNullSafe(F.lag("heading_path").over(order)) & F.lag("chunk_index").over(order).isNotNull(), F.lit(False))
    rows = chunks.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(order))
    return rows.groupBy("document_id", "island").agg(F.first("heading_path").alias("heading_path"), F.min("chunk_index").alias("first_chunk_index"), F.max("chunk_index").alias("last_chunk_index"), F.min_by("page", "chunk_index").alias("page")).drop("island")


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["text"]), "\n\n")


def context(chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Each chunk with its neighbours: first_index, last_index and their joined text.

    One window over the document; the frame goes by index, so gaps stay gaps.
    """
    near = Window.partitionBy("document_id").orderBy("chunk_index").rangeBetween(-before, after)
    pairs = F.collect_list(F.struct("chunk_index", "text")).over(near)
    return chunks.select("chunk_id", "document_id", "chunk_index", F.min("chunk_index").over(near).alias("first_index"), F.max("chunk_index").over(near).alias("last_index"), _joined(pairs).alias("context"))


def context_of(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same for requests(request_id, chunk_id, before, after): an interval join within documents."""
    at = requests.join(chunks.select("chunk_id", "document_id", F.col("chunk_index").alias("at")), "chunk_id")
    near = at.join(chunks.select("document_id", "chunk_index", "text"), "document_id").filter(F.col("chunk_index").between(F.col("at") - F.col("before"), F.col("at") + F.col("after")))
    return near.groupBy("request_id").agg(F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), _joined(F.collect_list(F.struct("chunk_index", "text"))).alias("context"))


def document_view(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Metadata, tags, summary (or a placeholder) and a note on the status."""
    out = with_tags(documents, links)
    note = F.when(F.col("status") == "ready", F.lit(None)).when(F.col("status") == "duplicate", "stored under another document").when(F.col("status") == "failed", "processing failed").otherwise("not searchable yet")
    return out.withColumn("summary", F.coalesce("summary", F.lit("(no summary)"))).withColumn("note", note)
