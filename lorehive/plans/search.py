"""Hybrid search jobs: the retrieval operators in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehive.functions import text as X
from lorehive.operators import catalog
from lorehive.operators import retrieval as R
from lorehive.stage import staged


@dataclass
class Corpus:
    """What is searched. stemmed says what the postings hold; with vectors and a semantic embedder,
    which makes the questions' vectors too, search is hybrid."""

    documents: DataFrame
    chunks: DataFrame
    postings: DataFrame
    document_tags: DataFrame
    vectors: DataFrame | None = None
    embedder: R.Embedder | None = None
    stemmed: bool = True
    #: looks the names of documents up by their grams (sources.files.stored_grams); else all names are read
    grams: Callable[[DataFrame], DataFrame] | None = None

    def semantic(self, queries: DataFrame) -> bool:
        """Whether a search for these queries compares vectors."""
        if self.vectors is None or (self.embedder and not self.embedder.is_semantic):
            return False
        return self.embedder is not None or "vector" in queries.columns


def ranked_lists(corpus: Corpus, queries: DataFrame, scope: DataFrame | None = None, pool: int = R.POOL) -> DataFrame:
    """query_id, chunk_id, document_id, retriever, rank, similarity: each admitted query's keyword list,
    and its dense one where the search compares vectors."""
    asked = R.admit_queries(queries).filter("reason is null")
    columns = ["query_id", "chunk_id", "document_id"]
    ranked = R.keyword_search(corpus.postings, R.query_terms(asked, corpus.stemmed), scope, pool).select(*columns, F.lit("keyword").alias("retriever"), "rank", F.lit(None).cast("double").alias("similarity"))
    if corpus.semantic(queries):
        if corpus.embedder:
            asked = R.embed(asked, corpus.embedder, "query")
        dense = R.dense_search(corpus.vectors, asked, scope, pool)
        ranked = ranked.unionByName(dense.select(*columns, F.lit("dense").alias("retriever"), "rank", "similarity"))
    return ranked


def search(corpus: Corpus, queries: DataFrame, scope: DataFrame | None = None, *, top_k: int = R.TOP_K, min_relevance: float = 0.0, max_chars: int = 1200, cap: int | None = R.PER_DOCUMENT) -> DataFrame:
    """One row per query and rank. queries(query_id, query[, vector]); with vectors on both sides
    the lists are fused, else it is keyword-only and similarity is null. A scope(query_id,
    document_id) limits both lists before they are ranked."""
    ranked = ranked_lists(corpus, queries, scope, max(R.POOL, 4 * top_k))
    known = ranked.groupBy("query_id", "chunk_id").agg(F.max("similarity").alias("similarity"))
    hits = R.relevance(R.fuse(ranked)).filter(F.col("relevance") >= min_relevance).join(known, ["query_id", "chunk_id"])
    full = R.hydrate(hits, corpus.chunks, corpus.documents)
    full = full if cap is None else R.diversify(full, cap)
    best = R.top(full, top_k, "fused_rank")
    passage = X.cut_passage(F.col("text"), max_chars)
    out = best.select(
        "query_id", "rank", "chunk_id", "document_id", "filename", "document_title", "heading_path", "page", "chunk_index", passage.alias("text"), (F.length("text") > max_chars).alias("truncated"),
        "relevance", "similarity", R.matched_by(F.col("dense_rank"), F.col("keyword_rank")).alias("matched_by"),
    )
    return catalog.with_tags(out, corpus.document_tags)


def tag_scope(corpus: Corpus, asked: DataFrame, tags: DataFrame, match_all: bool = False) -> DataFrame:
    """query_id, document_id: the ready documents with any (or all) of a query's known tags."""
    known = catalog.known_tags(catalog.asked_tags(asked), tags).filter("known").select("query_id", "tag")
    ready = corpus.documents.filter("status = 'ready'").select("document_id")
    return catalog.tagged(known, corpus.document_tags, match_all).join(ready, "document_id", "left_semi")


def search_by_tag(corpus: Corpus, queries: DataFrame, asked: DataFrame, tags: DataFrame, match_all: bool = False, **options: object) -> DataFrame:
    """search() within ready documents that have the queries' known tags asked(query_id, tag), with the
    unknown_tags that were left out. A query none of whose tags is known finds nothing; what it asked in
    vain is in search_by_tag_responses()."""
    found = search(corpus, queries, tag_scope(corpus, asked, tags, match_all), **options)
    return found.join(catalog.tag_report(asked, tags).select("query_id", "unknown_tags"), "query_id")


def search_by_tag_responses(corpus: Corpus, queries: DataFrame, asked: DataFrame, tags: DataFrame, match_all: bool = False, *, state: DataFrame | None = None, top_k: int = R.TOP_K, **options: object) -> DataFrame:
    """One row per query of a search_by_tag(): counts, unknown_tags and verdict. Where none of a query's
    tags is known the verdict is unknown_tags, whatever else could be said."""
    scope = staged(tag_scope(corpus, asked, tags, match_all), "tag-scope")
    results = search(corpus, queries, scope, top_k=top_k, **options)
    ranked = ranked_lists(corpus, queries, scope, max(R.POOL, 4 * top_k))
    return responses(queries, results, ranked, scope, state, semantic=corpus.semantic(queries), report=catalog.tag_report(asked, tags))


def search_by_document(corpus: Corpus, queries: DataFrame, references: DataFrame, *, top_k: int = 8, **options: object) -> DataFrame:
    """search() within the documents that references(query_id, position, reference) resolve to; no
    cap per document."""
    refs = references.withColumn("ref_id", F.concat_ws("/", "query_id", "position"))
    found = catalog.resolve(refs, corpus.documents, grams=corpus.grams).select("ref_id", "document_id")
    scope = catalog.distinct_documents(refs.join(found, "ref_id").select("query_id", "position", "document_id"))
    return search(corpus, queries, scope, top_k=top_k, cap=None, **options)


def responses(queries: DataFrame, results: DataFrame, ranked: DataFrame, scope: DataFrame | None = None, state: DataFrame | None = None, *, semantic: bool, report: DataFrame | None = None) -> DataFrame:
    """One row per query, also for those without a result: counts, best similarity, verdict. semantic:
    whether the search compared vectors (Corpus.semantic). A report (catalog.tag_report) adds the tags that
    a query asked in vain; a query that it doesn't have asked none."""
    found = results.groupBy("query_id").agg(F.count("*").alias("result_count"), F.max("similarity").alias("best_similarity"))
    pool = ranked.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("total_candidates"), F.count_distinct("document_id").alias("documents_searched"))
    out = queries.select("query_id").join(found, "query_id", "left").join(pool, "query_id", "left")
    if scope is not None:
        size = scope.groupBy("query_id").agg(F.count_distinct("document_id").alias("in_scope"))
        out = out.drop("documents_searched").join(size.withColumnRenamed("in_scope", "documents_searched"), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select("query_id", zero("result_count"), zero("documents_searched"), zero("total_candidates"), "best_similarity").join(R.quality(results, semantic), "query_id", "left")
    empty = F.when(F.lit(scope is not None) & (F.col("documents_searched") == 0), "no_document_in_scope").otherwise("nothing_matched")
    if state is not None:
        out = out.crossJoin(F.broadcast(state))  # one row
        empty = F.when(F.col("state") != "ready", F.concat(F.lit("corpus_"), F.col("state"))).otherwise(empty)
    code = F.coalesce("verdict", empty)
    if report is not None:
        out = out.join(report, "query_id", "left").withColumn("unknown_tags", F.coalesce("unknown_tags", F.array().cast("array<string>")))
        code = F.when(F.coalesce("known_tags", F.lit(0)) == 0, "unknown_tags").otherwise(code)
    return out.withColumn("guidance_code", code).drop("verdict", "state", "known_tags")
