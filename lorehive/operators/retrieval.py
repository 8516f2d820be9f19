"""Lexical and dense retrieval, fusion, and what is made of the hits. All by batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehive.functions import text as X
from lorehive.functions.stem import counted_stems, stem_of
from lorehive.stage import staged

POOL, RRF_K, PER_DOCUMENT, TOP_K, WEAK = 40, 60, 3, 6, 0.30
# English words that are not indexed.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: Bytes of query vectors that are sent to the tasks at once, and of similarities that a task holds;
#: more queries are taken in blocks, one after the other.
QUERY_BYTES, SIMILARITY_BYTES = 64 << 20, 32 << 20
#: Tasks that add up the scores of what one task reads of the index.
SCORE_SPREAD = 8


@dataclass(frozen=True)
class Embedder:
    """A model of texts: embed takes a list of texts and gives a vector of so many numbers for each.
    One that isn't semantic (a hash, say) makes vectors, but search is by keywords only."""

    embed: Callable[[list[str]], np.ndarray]
    dimensions: int
    is_semantic: bool = True


def postings(chunks: DataFrame, stemmed: bool = False) -> DataFrame:
    """term, chunk_id, document_id, tf over heading path and text, without stop words.

    A chunk is one row, and its terms are counted within it: nothing is shuffled, and a task holds the
    terms of one chunk at a time, however many it has to do.
    """
    words = X.terms(F.concat_ws(" ", "heading_path", "text"))
    found = counted_stems(words, STOP_WORDS) if stemmed else X.counted(F.filter(words, lambda t: ~t.isin(STOP_WORDS)))
    # outer, as else Spark works the terms out once more to filter on their number
    rows = chunks.select("chunk_id", "document_id", F.explode_outer(found).alias("x")).filter("x is not null")
    return rows.select("x.term", "chunk_id", "document_id", "x.tf")


def query_terms(queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """query_id, term: distinct words of each question, without stop words."""
    kept = F.array_distinct(F.filter(X.terms(F.col("query")), lambda t: ~t.isin(STOP_WORDS)))
    terms = queries.select("query_id", F.explode(kept).alias("term"))
    return terms.select("query_id", stem_of(F.col("term")).alias("term")).distinct() if stemmed else terms


def keyword_search(index: DataFrame, terms: DataFrame, scope: DataFrame | None = None, pool: int = POOL) -> DataFrame:
    """query_id, chunk_id, document_id, score, rank: the best chunks with any of a query's terms.

    The score is a tenth of the matched positions. What the index has of the asked terms is dealt out by chunk before
    it meets the queries, to as many tasks as follow the index: a task's scores are those of its chunks, however many
    there are in all. Ranks are cut to the pool per query, which Spark pushes below the shuffle. A scope(query_id,
    document_id) is applied before anything is ranked; queries that aren't in it find nothing.
    """
    tasks = SCORE_SPREAD * max(1, index.rdd.getNumPartitions())
    met = index.join(terms.select("term").distinct(), "term", "left_semi")
    if scope is None:
        met = met.repartition(tasks, "chunk_id").join(terms, "term")
    else:
        met = met.join(terms, "term").repartition(tasks, "query_id", "document_id").join(scope.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_semi")
    scored = met.groupBy("query_id", "chunk_id", "document_id").agg((F.sum("tf") * 0.1).alias("score"))
    return top(scored, pool, F.desc("score"), "chunk_id")


def top(scored: DataFrame, k: int, *order: Column | str, by: str = "query_id") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def dense_search(vectors: DataFrame, queries: DataFrame, scope: DataFrame | None = None, pool: int = POOL, threshold: float | None = None) -> DataFrame:
    """query_id, chunk_id, document_id, similarity, rank: exact cosine top-pool of each query.

    The questions, a stated set, are compared with all vectors in blocks: each task multiplies its
    vectors with the block's matrix and keeps a pool per query, so what is shuffled is tasks x
    queries x pool rows at most. Scopes are applied within, before the pool is cut. A block has at
    most QUERY_BYTES of vectors; where there are more, its result is written before the next one is
    sent, so the driver never holds more than one.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector")
    size = asked.agg(F.sum(F.size("vector") * 8).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    out = None
    for b in range(blocks):
        some = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = top(_dense_block(vectors, some, scope, pool, threshold), pool, F.desc("similarity"), "chunk_id")
        found = found if blocks == 1 else staged(found, "dense")
        out = found if out is None else out.unionByName(found)
    return out


def _dense_block(vectors: DataFrame, queries: DataFrame, scope: DataFrame | None, pool: int, threshold: float | None) -> DataFrame:
    block = sorted((r["query_id"], r["vector"]) for r in queries.collect())  # QUERY_BYTES, about, at most
    ids = np.array([q for q, _ in block], dtype=object)
    place = {q: k for k, q in enumerate(ids)}
    matrix = np.array([v for _, v in block], dtype=np.float64) if block else np.zeros((0, 1))
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = vectors.sparkSession.sparkContext.broadcast(matrix / np.where(norm > 0, norm, 1))
    columns = ["chunk_id", "document_id", "vector"]
    scoped = scope is not None
    if scoped:
        mine = scope.join(queries.select("query_id"), "query_id", "left_semi")
        vectors = vectors.join(mine.groupBy("document_id").agg(F.collect_set("query_id").alias("asked")), "document_id")
        columns.append("asked")
    step = max(1, SIMILARITY_BYTES // 8 // max(1, len(ids)))

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        v = np.array(part["vector"].tolist(), dtype=np.float64)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        sim = np.round(shared.value @ (v / np.where(size > 0, size, 1)).T, 12)
        if scoped:
            allowed = np.zeros(sim.shape, dtype=bool)
            for col, asked in enumerate(part["asked"]):
                allowed[[place[q] for q in asked], col] = True
            sim = np.where(allowed, sim, -np.inf)
        keep = sim > -np.inf if threshold is None else sim >= threshold
        if sim.shape[1] > pool:  # all that tie with the last one stay for the exact cut
            keep &= sim >= -np.partition(-sim, pool - 1, axis=1)[:, pool - 1 : pool]
        row, col = np.nonzero(keep)
        return pd.DataFrame({"query_id": ids[row], "chunk_id": part["chunk_id"].to_numpy()[col], "document_id": part["document_id"].to_numpy()[col], "similarity": sim[row, col]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch) if len(ids) else 0, step):
                yield nearest(batch.iloc[at : at + step])

    return vectors.select(columns).mapInPandas(compare, "query_id string, chunk_id string, document_id string, similarity double")


def payload_filter(tags: Column, wanted: Column, match_all: bool) -> Column:
    return F.forall(wanted, lambda t: F.array_contains(tags, t)) if match_all else F.arrays_overlap(tags, wanted)


def pool_size(top_k: Column, least: int = POOL) -> Column:
    return F.greatest(F.lit(least), top_k * 4)


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """ranked(query_id, retriever, rank, chunk_id) to query_id, chunk_id, score, dense_rank,
    keyword_rank, fused_rank by Reciprocal Rank Fusion; a repeat in a list counts at its first rank."""
    once = ranked.groupBy("query_id", "retriever", "chunk_id").agg(F.min("rank").alias("rank"))
    of = lambda name: F.min(F.when(F.col("retriever") == name, F.col("rank")))
    # summed in a fixed order: the dense list's share first
    share = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    hits = once.groupBy("query_id", "chunk_id").agg(of("dense").alias("dense_rank"), of("keyword").alias("keyword_rank"))
    hits = hits.withColumn("score", share("dense_rank") + share("keyword_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.least("dense_rank", "keyword_rank"), "chunk_id")
    return hits.withColumn("fused_rank", F.row_number().over(order))


def matched_by(dense_rank: Column, keyword_rank: Column) -> Column:
    return F.array_compact(F.array(F.when(dense_rank.isNotNull(), "semantic"), F.when(keyword_rank.isNotNull(), "keyword")))


def relevance(hits: DataFrame) -> DataFrame:
    """Adds relevance: the score over the query's best, to 4 decimals."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("relevance", F.round(F.least(F.lit(1.0), F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0))), 4))


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their chunk and document; ids without a stored chunk drop out."""
    full = hits.join(chunks.select("chunk_id", "document_id", "chunk_index", "heading_path", "page", "text"), "chunk_id")
    return full.join(documents.select("document_id", "filename", F.col("title").alias("document_title")), "document_id")


def diversify(hits: DataFrame, cap: int = PER_DOCUMENT) -> DataFrame:
    """At most cap chunks of a document per query, by fused rank."""
    nth = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("fused_rank"))
    return hits.withColumn("nth", nth).filter(F.col("nth") <= cap).drop("nth")


def admit_queries(queries: DataFrame, least: int = 2, most: int = 1000) -> DataFrame:
    """Adds reason: blank, too_short, too_long, or null."""
    n = F.length("query")
    return queries.withColumn("reason", F.when(X.strip(F.coalesce("query", F.lit(""))) == "", "blank").when(n < least, "too_short").when(n > most, "too_long"))


def quality(results: DataFrame, semantic: bool = True, weak: float = WEAK) -> DataFrame:
    """query_id, verdict: weak (the best similarity is low), moderate (the search had vectors, but no
    hit is in both lists) or grounded, which is all that a keyword-only search can say."""
    per = results.groupBy("query_id").agg(F.max("similarity").alias("best"), F.count_if(F.size("matched_by") > 1).alias("both"))
    return per.select("query_id", F.when(F.col("best") < weak, "weak").when((F.col("both") == 0) & F.lit(semantic), "moderate").otherwise("grounded").alias("verdict"))


def embed(chunks: DataFrame, model: Callable[[list[str]], np.ndarray] | Embedder, text_col: str = "text", batch: int = 96) -> DataFrame:
    """chunks with a vector column from a model that takes lists of texts, batch by batch; blank
    texts are sent as one space, order is kept. Fails where the model gives another number of vectors
    than it got texts, or (an Embedder) vectors of another size."""
    of, size = (model.embed, model.dimensions) if isinstance(model, Embedder) else (model, None)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            said = [t if isinstance(t, str) and t.strip() else " " for t in texts]
            found: list[list[float]] = []
            for at in range(0, len(said), batch):
                some = said[at : at + batch]
                got = np.asarray(of(some), dtype=np.float32)
                if len(got) != len(some) or (size and got.shape[1] != size):
                    raise ValueError(f"the model gave {got.shape} for {len(some)} texts of {size or 'any'} numbers each")
                found += got.tolist()
            yield pd.Series(found, dtype="object")

    return chunks.withColumn("vector", F.pandas_udf(run, T.ArrayType(T.FloatType()))(F.col(text_col)))


def missing_vectors(chunks: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """Chunks without a vector of the right size."""
    return chunks.select("chunk_id").join(vectors.filter(F.size("vector") == dimensions).select("chunk_id"), "chunk_id", "left_anti")
