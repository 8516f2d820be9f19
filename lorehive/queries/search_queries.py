"""Retrieval and chat logs: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorehive.functions import stem as T
from lorehive.functions import text as X
from lorehive.operators import catalog as K
from lorehive.operators import chatlog as L
from lorehive.operators import retrieval as R
from lorehive.plans import search as J
from lorehive.queries.base import CHUNKS, DOCS, LINKS, RANKED, chunks, documents, links, query, questions, ranked, read, vectors, with_sql
from lorehive.queries.catalogue_queries import ASKED, RAW_ASKED, REPORT, asked, raw_asked

STOP = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
WORD = r"[\p{L}\p{N}]+"
POSTINGS = f"post AS (SELECT term, chunk_id, document_id, count(*) AS tf FROM (SELECT chunk_id, document_id, unnest(regexp_extract_all(lower(concat_ws(' ', heading_path, text)), '{WORD}')) AS term FROM chunks) WHERE term NOT IN ({STOP}) GROUP BY ALL)"
TERMS = f"qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id::VARCHAR AS query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM benchmark) WHERE term NOT IN ({STOP}))"
SCORED = "sc AS (SELECT query_id, chunk_id, document_id, sum(tf)::DOUBLE * 0.1::DOUBLE AS score FROM post JOIN qt USING (term) GROUP BY ALL)"
KEYWORD = "kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 40)"


@query(with_sql(CHUNKS, POSTINGS, select="SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS tf FROM post GROUP BY term"))
def ret1_postings(spark, d):
    return R.postings(chunks(spark, d)).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf"))


# the steps of the stemmer one after the other: y that is a consonant is Y, p1 and p2 are where its regions begin
SHORT = "regexp_matches({0}, '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$')"
CASES = lambda pairs: " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items())
ENDS = lambda words: "(" + "|".join(words) + ")$"
STEMS = rf"""s0 AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS m, CASE WHEN length(term) < 3 OR regexp_matches(term, '\p{{N}}') THEN term ELSE CASE term {CASES(T.WHOLE)} END END AS whole FROM (SELECT DISTINCT term FROM {{0}})),
s1 AS (SELECT *, CASE WHEN regexp_matches(m, '^({T.BEGINNINGS})') THEN length(regexp_extract(m, '^({T.BEGINNINGS})')) ELSE coalesce(nullif(length(regexp_extract(m, '^.*?[aeiouy][^aeiouy]')), 0), length(m)) END AS p1 FROM s0),
s2 AS (SELECT *, p1 + coalesce(nullif(length(regexp_extract(substr(m, p1 + 1), '^.*?[aeiouy][^aeiouy]')), 0), length(m) - p1) AS p2, CASE WHEN m LIKE '%sses' THEN left(m, length(m) - 2) WHEN regexp_matches(m, '(ied|ies)$') THEN left(m, length(m) - CASE WHEN length(m) > 4 THEN 2 ELSE 1 END) WHEN regexp_matches(m, '(us|ss)$') THEN m WHEN regexp_matches(m, '[aeiouy].+s$') THEN left(m, length(m) - 1) ELSE m END AS a FROM s1),
s3 AS (SELECT *, CASE WHEN a IN ({", ".join(f"'{w}'" for w in sorted(T.KEPT))}) THEN a END AS kept, regexp_extract(a, '(eedly|eed|ingly|edly|ing|ed)$') AS e1 FROM s2),
s4 AS (SELECT *, left(a, length(a) - length(e1)) AS c FROM s3),
s5 AS (SELECT *, CASE WHEN e1 LIKE 'eed%' THEN CASE WHEN length(c) >= p1 THEN c || 'ee' ELSE a END WHEN e1 = '' OR NOT regexp_matches(c, '[aeiouy]') THEN a WHEN regexp_matches(c, '(at|bl|iz)$') THEN c || 'e' WHEN regexp_matches(c, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(c, length(c) - 1) WHEN length(c) = p1 AND {SHORT.format("c")} THEN c || 'e' ELSE c END AS b FROM s4),
s6 AS (SELECT *, regexp_replace(b, '(.[^aeiouy])[yY]$', '\1i') AS d FROM s5), s7 AS (SELECT *, regexp_extract(d, '{ENDS(T.STEP2)}') AS e2 FROM s6),
s8 AS (SELECT *, CASE WHEN e2 = '' OR length(d) - length(e2) < p1 OR e2 = 'ogi' AND d NOT LIKE '%logi' OR e2 = 'li' AND NOT regexp_matches(d, '[cdeghkmnrt]li$') THEN d ELSE left(d, length(d) - length(e2)) || CASE e2 {CASES(T.STEP2)} END END AS f FROM s7),
s9 AS (SELECT *, regexp_extract(f, '{ENDS(T.STEP3)}') AS e3 FROM s8),
s10 AS (SELECT *, CASE WHEN e3 = '' OR length(f) - length(e3) < CASE e3 WHEN 'ative' THEN p2 ELSE p1 END THEN f ELSE left(f, length(f) - length(e3)) || CASE e3 {CASES(T.STEP3)} END END AS g FROM s9),
s11 AS (SELECT *, regexp_extract(g, '{ENDS(T.STEP4)}') AS e4 FROM s10),
s12 AS (SELECT *, CASE WHEN e4 = '' OR length(g) - length(e4) < p2 OR e4 = 'ion' AND NOT regexp_matches(g, '[st]ion$') THEN g ELSE left(g, length(g) - length(e4)) END AS h FROM s11),
s13 AS (SELECT *, CASE WHEN h LIKE '%e' AND (length(h) > p2 OR length(h) > p1 AND NOT {SHORT.format("left(h, length(h) - 1)")}) OR h LIKE '%ll' AND length(h) > p2 THEN left(h, length(h) - 1) ELSE h END AS i FROM s12),
st AS (SELECT term, coalesce(whole, kept, replace(i, 'Y', 'y')) AS stem FROM s13)"""
STEMMED = "sp AS (SELECT stem AS term, chunk_id, document_id, sum(tf)::BIGINT AS tf FROM post JOIN st USING (term) GROUP BY ALL)"


@query(with_sql(CHUNKS, POSTINGS, STEMS.replace("{0}", "post"), STEMMED, select="SELECT * FROM sp"))
def ret1_stemmed_postings(spark, d):
    return R.postings(chunks(spark, d), stemmed=True)


@query(with_sql(TERMS, select="SELECT * FROM qt"))
def ret2_query_terms(spark, d):
    return R.query_terms(questions(spark, d))


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, KEYWORD, select="SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw"))
def ret3_keyword_search(spark, d):
    found = R.keyword_search(R.postings(chunks(spark, d)), R.query_terms(questions(spark, d)))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


SCOPE = "scope AS (SELECT DISTINCT query_id, document_id FROM asked JOIN links USING (tag) JOIN docs USING (document_id) WHERE status = 'ready')"


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, DOCS, LINKS, ASKED, SCOPE, select="SELECT query_id, chunk_id, rank FROM (SELECT sc.query_id, chunk_id, row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, chunk_id) AS rank FROM sc JOIN scope ON scope.query_id = sc.query_id AND scope.document_id = sc.document_id) WHERE rank <= 40"))
def ret4_scoped_keyword_search(spark, d):
    return R.keyword_search(R.postings(chunks(spark, d)), R.query_terms(questions(spark, d)), scope(spark, d)).select("query_id", "chunk_id", "rank")


def scope(spark, d):
    ready = documents(spark, d).filter("status = 'ready'").select("document_id")
    return K.tagged(asked(spark, d), links(spark, d), match_all=False).join(ready, "document_id", "left_semi")


@query(with_sql(DOCS, LINKS, ASKED, SCOPE, select="SELECT query_id, document_id FROM scope"))
def ret5_tag_scope(spark, d):
    return scope(spark, d).select("query_id", "document_id")


DENSE = "dn AS (SELECT q.vec_id::VARCHAR AS query_id, v.vec_id::VARCHAR AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM dn) WHERE rank <= 40)"


def vector_questions(spark, d):
    return read(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


@query(with_sql(DENSE, select="SELECT query_id, chunk_id, round(sim, 6) AS similarity, rank FROM dr"))
def ret6_dense_search(spark, d):
    return R.dense_search(vectors(spark, d), vector_questions(spark, d)).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(with_sql(DENSE, select="SELECT query_id, chunk_id, round(sim, 6) AS similarity FROM dr WHERE sim >= 0.5"))
def ret6_dense_threshold(spark, d):
    return R.dense_search(vectors(spark, d), vector_questions(spark, d), threshold=0.5).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, lang IN ('en', 'de') OR source = 'src1' AS any_of, lang = 'en' AND source = 'src1' AS all_of FROM documents")
def ret7_payload_filter(spark, d):
    tags = F.array("lang", "source")
    wanted = lambda *x: F.array(*[F.lit(v) for v in x])
    return read(spark, d, "documents").select("doc_id", R.payload_filter(tags, wanted("en", "de", "src1"), False).alias("any_of"), R.payload_filter(tags, wanted("en", "src1"), True).alias("all_of"))


@query("SELECT item_id, greatest(40, item_id % 20 * 4) AS pool FROM benchmark")
def ret8_pool_size(spark, d):
    return read(spark, d, "benchmark").select("item_id", R.pool_size(F.col("item_id") % 20).alias("pool"))


FUSED = """once AS (SELECT query_id, chunk_id, min(CASE retriever WHEN 'dense' THEN rank END) AS dense_rank, min(CASE retriever WHEN 'keyword' THEN rank END) AS keyword_rank FROM ranked GROUP BY 1, 2),
fz AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS score FROM once),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(dense_rank, keyword_rank), chunk_id) AS fused_rank FROM fz)"""


@query(with_sql(RANKED, FUSED, select="SELECT query_id, chunk_id, dense_rank, keyword_rank, round(score, 9) AS score, fused_rank FROM fused"))
def ret9_fusion(spark, d):
    return R.fuse(ranked(spark, d)).select("query_id", "chunk_id", "dense_rank", "keyword_rank", F.round("score", 9).alias("score"), "fused_rank")


@query(with_sql(RANKED, FUSED, select="SELECT query_id, chunk_id, array_to_string(list_filter([CASE WHEN dense_rank IS NOT NULL THEN 'semantic' END, CASE WHEN keyword_rank IS NOT NULL THEN 'keyword' END], lambda x: x IS NOT NULL), ',') AS matched_by FROM fused"))
def ret10_provenance(spark, d):
    return R.fuse(ranked(spark, d)).select("query_id", "chunk_id", R.matched_by(F.col("dense_rank"), F.col("keyword_rank")).alias("matched_by"))


@query(with_sql(RANKED, FUSED, select="SELECT query_id, chunk_id, round(least(1.0, score / max(score) OVER (PARTITION BY query_id)), 3) AS relevance FROM fused"))
def ret11_relevance(spark, d):
    return R.relevance(R.fuse(ranked(spark, d))).select("query_id", "chunk_id", F.round(F.least(F.lit(1.0), F.col("score") / F.max("score").over(_per_query())), 3).alias("relevance"))


def _per_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id")


@query(with_sql(RANKED, FUSED, select="SELECT query_id, count(*) AS kept FROM (SELECT query_id, score / max(score) OVER (PARTITION BY query_id) AS r FROM fused) WHERE r >= 0.6 GROUP BY 1"))
def ret12_least_relevance(spark, d):
    return R.relevance(R.fuse(ranked(spark, d))).filter("relevance >= 0.6").groupBy("query_id").agg(F.count("*").alias("kept"))


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, KEYWORD, select="SELECT query_id, kw.chunk_id, doc_id::VARCHAR AS document_id, source || '_' || doc_id || '.txt' AS filename FROM kw JOIN documents ON doc_id::VARCHAR = kw.chunk_id WHERE doc_id % 4 > 0"))
def ret13_hydrated_hits(spark, d):
    """With a quarter of the chunks gone from the store."""
    hits = R.keyword_search(R.postings(chunks(spark, d)), R.query_terms(questions(spark, d))).select("query_id", "chunk_id")
    return R.hydrate(hits, chunks(spark, d).filter("cast(chunk_id as long) % 4 > 0"), documents(spark, d)).select("query_id", "chunk_id", "document_id", "filename")


DIVERSE = "dv AS (SELECT *, row_number() OVER (PARTITION BY query_id, right(chunk_id, 1) ORDER BY fused_rank) AS nth FROM fused)"


@query(with_sql(RANKED, FUSED, DIVERSE, select="SELECT query_id, chunk_id, fused_rank FROM dv WHERE nth <= 3"))
def ret14_diversity(spark, d):
    """A chunk's last digit stands for its document."""
    return R.diversify(R.fuse(ranked(spark, d)).withColumn("document_id", F.right("chunk_id", F.lit(1)))).select("query_id", "chunk_id", "fused_rank")


@query(with_sql(RANKED, FUSED, DIVERSE, select="SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM dv WHERE nth <= 3) WHERE rank <= 6"))
def ret15_top_k(spark, d):
    kept = R.diversify(R.fuse(ranked(spark, d)).withColumn("document_id", F.right("chunk_id", F.lit(1))))
    return R.top(kept, R.TOP_K, "fused_rank").select("query_id", "chunk_id", "rank")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN regexp_replace(text[1:200], ' [^ ]*$', '') || ' ...' ELSE text END AS passage, length(text) > 200 AS truncated FROM documents")
def ret16_passages(spark, d):
    return read(spark, d, "documents").select("doc_id", X.cut_passage(F.col("text"), 200).alias("passage"), (F.length("text") > 200).alias("truncated"))


def corpus(spark, d):
    c = chunks(spark, d)
    return J.Corpus(documents(spark, d), c, R.postings(c), links(spark, d), stemmed=False)


# one list only: the score of rank r is 1 / (60 + r), and each document has one chunk
TOP = "tp AS (SELECT query_id, chunk_id, rank, round(61.0::DOUBLE / (60 + rank), 4) AS relevance FROM kw WHERE rank <= 6)"


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, KEYWORD, TOP, select="SELECT q.item_id::VARCHAR AS query_id, coalesce(r, 0) AS result_count, coalesce(c, 0) AS documents_searched, coalesce(c, 0) AS total_candidates, false AS compared, CASE WHEN r IS NULL THEN 'nothing_matched' ELSE 'grounded' END AS guidance_code FROM benchmark q LEFT JOIN (SELECT query_id, count(*) AS r FROM tp GROUP BY 1) a ON a.query_id = q.item_id::VARCHAR LEFT JOIN (SELECT query_id, count(*) AS c FROM kw GROUP BY 1) b ON b.query_id = q.item_id::VARCHAR"))
def ret17_responses(spark, d):
    """Keyword-only: no similarity, and no moderate verdict."""
    c, q = corpus(spark, d), questions(spark, d)
    found = J.responses(q, J.search(c, q), R.keyword_search(c.postings, R.query_terms(q)), semantic=c.semantic(q))
    return found.withColumn("compared", F.col("best_similarity").isNotNull()).drop("best_similarity")


# both lists: a chunk's vector, and a question's, is the embedding of its number
HYBRID = """hd AS (SELECT query_id, chunk_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM (SELECT q.vec_id::VARCHAR AS query_id, v.vec_id::VARCHAR AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS sim FROM embeddings q JOIN benchmark ON item_id = vec_id, embeddings v JOIN documents ON doc_id = v.vec_id)) WHERE rank <= 40),
hy AS (SELECT coalesce(kw.query_id, hd.query_id) AS query_id, coalesce(kw.chunk_id, hd.chunk_id) AS chunk_id, hd.rank AS dense_rank, kw.rank AS keyword_rank, sim, coalesce(1.0::DOUBLE / (60 + hd.rank), 0) + coalesce(1.0::DOUBLE / (60 + kw.rank), 0) AS score FROM kw FULL JOIN hd ON kw.query_id = hd.query_id AND kw.chunk_id = hd.chunk_id),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(dense_rank, keyword_rank), chunk_id) AS rank, round(score / max(score) OVER (PARTITION BY query_id), 4) AS relevance FROM hy),
ht AS (SELECT * FROM hr WHERE rank <= 6)"""


def hybrid_corpus(spark, d):
    c = corpus(spark, d)
    c.vectors = vectors(spark, d).drop("document_id").join(c.chunks.select("chunk_id", "document_id"), "chunk_id")
    return c


def hybrid_questions(spark, d):
    return questions(spark, d).join(vectors(spark, d).select(F.col("chunk_id").alias("query_id"), "vector"), "query_id")


def both_lists(c, q):
    keyword = R.keyword_search(c.postings, R.query_terms(q)).select("query_id", "chunk_id", "document_id")
    return keyword.unionByName(R.dense_search(c.vectors, q).select("query_id", "chunk_id", "document_id"))


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, KEYWORD, HYBRID, select="SELECT a.query_id, r AS result_count, n AS documents_searched, n AS total_candidates, round(best, 6) AS best_similarity, CASE WHEN best < 0.30 THEN 'weak' WHEN twice = 0 THEN 'moderate' ELSE 'grounded' END AS guidance_code FROM (SELECT query_id, count(*) AS r, max(sim) AS best, count_if(dense_rank IS NOT NULL AND keyword_rank IS NOT NULL) AS twice FROM ht GROUP BY 1) a JOIN (SELECT query_id, count(*) AS n FROM hy GROUP BY 1) b ON a.query_id = b.query_id"))
def ret17_hybrid_responses(spark, d):
    c, q = hybrid_corpus(spark, d), hybrid_questions(spark, d)
    return J.responses(q, J.search(c, q), both_lists(c, q), semantic=c.semantic(q)).withColumn("best_similarity", F.round("best_similarity", 6))


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, KEYWORD, TOP, select="SELECT query_id, rank, chunk_id, relevance FROM tp"))
def ret18_keyword_only(spark, d):
    return J.search(corpus(spark, d), questions(spark, d)).select("query_id", "rank", "chunk_id", "relevance")


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, KEYWORD, TOP, select="SELECT query_id, rank, chunk_id, relevance, CASE WHEN length(text) > 300 THEN regexp_replace(text[1:300], ' [^ ]*$', '') || ' ...' ELSE text END AS text, 'keyword' AS matched_by, list_sort([lang, source])[1] || ',' || list_sort([lang, source])[2] AS tags FROM tp JOIN documents ON doc_id::VARCHAR = chunk_id"))
def ret19_search(spark, d):
    return J.search(corpus(spark, d), questions(spark, d), max_chars=300).select("query_id", "rank", "chunk_id", "relevance", "text", "matched_by", "tags")


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, DOCS, LINKS, ASKED, SCOPE, select="SELECT query_id, chunk_id, rank FROM (SELECT sc.query_id, chunk_id, row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, chunk_id) AS rank FROM sc JOIN scope ON scope.query_id = sc.query_id AND scope.document_id = sc.document_id) WHERE rank <= 6"))
def ret20_search_by_tag(spark, d):
    tags = links(spark, d).select("tag").distinct()
    return J.search_by_tag(corpus(spark, d), questions(spark, d), asked(spark, d), tags).select("query_id", "chunk_id", "rank")


KNOWN_SCOPE = "ks AS (SELECT DISTINCT query_id, document_id FROM na JOIN links USING (tag) JOIN docs USING (document_id) WHERE known AND status = 'ready'), kh AS (SELECT * FROM (SELECT sc.query_id, chunk_id, row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, chunk_id) AS rank FROM sc JOIN ks ON ks.query_id = sc.query_id AND ks.document_id = sc.document_id) WHERE rank <= 40)"
ALL_SCOPE = KNOWN_SCOPE.replace("SELECT DISTINCT query_id, document_id FROM na", "SELECT query_id, document_id FROM na JOIN rep USING (query_id)").replace("status = 'ready')", "status = 'ready' GROUP BY query_id, document_id, known_tags HAVING count(DISTINCT tag) = known_tags)")
TAG_RESPONSES = """SELECT q.item_id::VARCHAR AS query_id, coalesce(r, 0)::BIGINT AS result_count, coalesce(n, 0) AS documents_searched, coalesce(c, 0) AS total_candidates, coalesce(unknown_tags, '') AS unknown_tags, CASE WHEN coalesce(known_tags, 0) = 0 THEN 'unknown_tags' WHEN r > 0 THEN 'grounded' WHEN n IS NULL THEN 'no_document_in_scope' ELSE 'nothing_matched' END AS guidance_code FROM benchmark q LEFT JOIN rep ON rep.query_id = q.item_id::VARCHAR
LEFT JOIN (SELECT query_id, count(*) AS c, count_if(rank <= 6) AS r FROM kh GROUP BY 1) a ON a.query_id = q.item_id::VARCHAR LEFT JOIN (SELECT query_id, count(*) AS n FROM ks GROUP BY 1) b ON b.query_id = q.item_id::VARCHAR"""
PLAIN_LINKS = LINKS.replace("links AS (SELECT", "links AS (SELECT DISTINCT")


def tag_responses(spark, d, match_all):
    c, tags = corpus(spark, d), links(spark, d).select("tag").distinct()
    return J.search_by_tag_responses(c, questions(spark, d), raw_asked(spark, d), tags, match_all, state=K.corpus_state(c.documents)).drop("best_similarity")


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, DOCS, PLAIN_LINKS, RAW_ASKED, REPORT, KNOWN_SCOPE, select=TAG_RESPONSES))
def ret20_tag_responses(spark, d):
    """Questions with known tags, some and none: what was asked in vain is told, and comes before other verdicts."""
    return tag_responses(spark, d, False)


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, DOCS, PLAIN_LINKS, RAW_ASKED, REPORT, ALL_SCOPE, select=TAG_RESPONSES))
def ret23_tag_responses_of_all(spark, d):
    """The same where documents need all of a question's known tags."""
    return tag_responses(spark, d, True)


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, DOCS, PLAIN_LINKS, RAW_ASKED, REPORT, KNOWN_SCOPE, select="SELECT query_id, chunk_id, rank, unknown_tags FROM kh JOIN rep USING (query_id) WHERE rank <= 6"))
def ret20_unknown_tags(spark, d):
    tags = links(spark, d).select("tag").distinct()
    return J.search_by_tag(corpus(spark, d), questions(spark, d), raw_asked(spark, d), tags).select("query_id", "chunk_id", "rank", "unknown_tags")


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, select="SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE document_id = query_id OR document_id = (query_id::BIGINT + 1)::VARCHAR"))
def ret21_search_by_document(spark, d):
    """Each question within two documents: one by id, one by filename."""
    i = F.col("item_id")
    by_id = read(spark, d, "benchmark").select(i.cast("string").alias("query_id"), F.lit(0).alias("position"), i.cast("string").alias("reference"))
    names = documents(spark, d).select((F.col("doc_id") - 1).cast("string").alias("query_id"), F.lit(1).alias("position"), F.col("filename").alias("reference"))
    refs = by_id.unionByName(names.join(by_id.select("query_id"), "query_id", "left_semi"))
    return J.search_by_document(corpus(spark, d), questions(spark, d), refs).select("query_id", "chunk_id", "rank")


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, KEYWORD, HYBRID, select="SELECT query_id, CASE WHEN max(sim) < 0.30 THEN 'weak' WHEN count_if(dense_rank IS NOT NULL AND keyword_rank IS NOT NULL) = 0 THEN 'moderate' ELSE 'grounded' END AS verdict FROM ht GROUP BY 1"))
def ret22_search_quality(spark, d):
    """Of hybrid search results."""
    return R.quality(J.search(hybrid_corpus(spark, d), hybrid_questions(spark, d)))


@query("SELECT query_id, CASE WHEN best < 0.30 THEN 'weak' WHEN both_lists = 0 THEN 'moderate' ELSE 'grounded' END AS verdict FROM (SELECT user_id::VARCHAR AS query_id, max(value / 100) AS best, count_if(event_type = 'purchase') AS both_lists FROM events GROUP BY 1)")
def ret22_quality(spark, d):
    both = F.when(F.col("event_type") == "purchase", F.array(F.lit("semantic"), F.lit("keyword"))).otherwise(F.array(F.lit("semantic")))
    return R.quality(read(spark, d, "events").select(F.col("user_id").cast("string").alias("query_id"), (F.col("value") / 100).alias("similarity"), both.alias("matched_by")))


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, DOCS, LINKS, ASKED, "narrow AS (SELECT query_id, document_id FROM asked JOIN links USING (tag) JOIN docs USING (document_id) WHERE status = 'ready' GROUP BY ALL HAVING count(DISTINCT tag) = 2)", select="SELECT q.item_id::VARCHAR AS query_id, coalesce(n, 0) AS documents_searched, CASE WHEN n IS NULL THEN 'no_document_in_scope' WHEN h IS NULL THEN 'nothing_matched' ELSE 'grounded' END AS guidance_code FROM benchmark q LEFT JOIN (SELECT query_id, count(*) AS n FROM narrow GROUP BY 1) a ON a.query_id = q.item_id::VARCHAR LEFT JOIN (SELECT sc.query_id, count(*) AS h FROM sc JOIN narrow ON narrow.query_id = sc.query_id AND narrow.document_id = sc.document_id GROUP BY 1) b ON b.query_id = q.item_id::VARCHAR"))
def ret23_empty_results(spark, d):
    """Questions scoped to documents with both of their tags; keyword-only, so what is found is grounded."""
    c, q = corpus(spark, d), questions(spark, d)
    ready = c.documents.filter("status = 'ready'").select("document_id")
    narrow = K.tagged(asked(spark, d), c.document_tags, match_all=True).join(ready, "document_id", "left_semi")
    ranked_ = R.keyword_search(c.postings, R.query_terms(q), narrow)
    return J.responses(q, J.search(c, q, narrow), ranked_, narrow, K.corpus_state(c.documents), semantic=c.semantic(q)).select("query_id", "documents_searched", "guidance_code")


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN length(text) < 2 THEN 'too_short' WHEN length(text) > 1000 THEN 'too_long' END AS reason FROM documents")
def ret24_query_admission(spark, d):
    return R.admit_queries(read(spark, d, "documents").withColumnRenamed("text", "query")).select("doc_id", "reason")


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, KEYWORD, HYBRID, select="SELECT query_id, rank, chunk_id, relevance, coalesce(round(sim, 6), -9.0::DOUBLE) AS similarity, concat_ws(',', CASE WHEN dense_rank IS NOT NULL THEN 'semantic' END, CASE WHEN keyword_rank IS NOT NULL THEN 'keyword' END) AS matched_by FROM ht"))
def ret19_hybrid_search(spark, d):
    """Both lists, fused."""
    found = J.search(hybrid_corpus(spark, d), hybrid_questions(spark, d))
    return found.select("query_id", "rank", "chunk_id", "relevance", F.coalesce(F.round("similarity", 6), F.lit(-9.0)).alias("similarity"), "matched_by")


@query(with_sql(CHUNKS, POSTINGS, TERMS, STEMS.replace("{0}", "(SELECT term FROM post UNION SELECT term FROM qt)"), STEMMED, "sq AS (SELECT DISTINCT query_id, stem AS term FROM qt JOIN st USING (term))", SCORED.replace("FROM post JOIN qt", "FROM sp JOIN sq"), KEYWORD, TOP, select="SELECT query_id, rank, chunk_id, relevance FROM tp"))
def ret19_stemmed_search(spark, d):
    """The default: words and questions by their stems."""
    c = chunks(spark, d)
    corpus = J.Corpus(documents(spark, d), c, R.postings(c, stemmed=True), links(spark, d))
    return J.search(corpus, questions(spark, d)).select("query_id", "rank", "chunk_id", "relevance")


@query(with_sql(CHUNKS, POSTINGS, TERMS, SCORED, KEYWORD, TOP, select="SELECT query_id, rank, chunk_id, 'keyword' AS matched_by FROM tp"))
def udf1_hash_embedder(spark, d):
    """Vectors of an embedder that isn't semantic are stored, but not searched by."""
    import numpy as np

    c = corpus(spark, d)
    c.embedder = R.Embedder(lambda texts: np.array([[len(t), 1.0] for t in texts]), 2, is_semantic=False)
    c.vectors = R.embed(c.chunks.select("chunk_id", "document_id", "text"), c.embedder)
    return J.search(c, questions(spark, d)).select("query_id", "rank", "chunk_id", "matched_by")


# event logs made of conversations: a user's text is a tool call, its result and text; then done
def logs(spark, d):
    return as_logs(read(spark, d, "conversations"))


def as_logs(talks):
    frame = lambda *pairs: F.concat(F.lit("data: "), F.to_json(F.struct(*pairs)))
    hit = F.struct(F.lit("f.txt").alias("filename"), F.col("role").alias("heading_path"), F.col("turn").cast("int").alias("page"), F.col("conv_id").cast("string").alias("document_id"), F.concat_ws("-", F.col("conv_id") % 3, F.col("turn") % 2).alias("chunk_id"), F.lit(0.5).alias("relevance"))
    structured = F.struct(F.array(hit).alias("results"), F.lit("ok").alias("guidance"))
    t = lambda name: F.lit(name).alias("type")
    parts = [
        frame(t("tool_call"), F.lit("search").alias("name")), F.lit("data: {broken"), frame(t("tool_result"), F.lit("search").alias("name"), structured.alias("structured")), frame(t("text"), F.col("text")),
        frame(t("tool_result"), F.lit("list_tags").alias("name")), frame(t("text"), F.col("role").alias("text")), frame(t("done")),
    ]
    return talks.select("conv_id", F.col("turn").cast("int").alias("turn"), F.concat_ws("\n\n", *parts).alias("body"))


@query("SELECT conv_id, turn, unnest([0, 2, 3, 4, 5, 6])::BIGINT AS seq, unnest(['tool_call', 'tool_result', 'text', 'tool_result', 'text', 'done']) AS type FROM conversations")
def log1_frames(spark, d):
    return L.frames(logs(spark, d)).select("conv_id", "turn", "seq", "type")


@query("SELECT conv_id, turn, 2::BIGINT AS seq, 0::BIGINT AS place, role AS heading_path, turn AS page, conv_id::VARCHAR AS document_id, (conv_id % 3) || '-' || (turn % 2) AS chunk_id FROM conversations")
def log2_citations(spark, d):
    return L.citations(L.frames(logs(spark, d))).select("conv_id", "turn", "seq", "place", "heading_path", "page", "document_id", "chunk_id")


@query("SELECT conv_id, turn, seq, CASE seq WHEN 2 THEN 1::BIGINT END AS result_count, CASE seq WHEN 2 THEN 'ok' END AS guidance FROM (SELECT conv_id, turn, unnest([2, 4])::BIGINT AS seq FROM conversations)")
def log2_result_sizes(spark, d):
    return L.result_sizes(L.frames(logs(spark, d)))


@query("SELECT conv_id, turn, text || role AS text FROM conversations")
def log3_turn_texts(spark, d):
    return L.turn_texts(L.frames(logs(spark, d))).select("conv_id", "turn", "text")


@query("SELECT conv_id, seq, chunk_id FROM (SELECT conv_id, turn AS seq, (conv_id % 3) || '-' || (turn % 2) AS chunk_id FROM conversations) WHERE (conv_id, chunk_id, seq) IN (SELECT (conv_id, (conv_id % 3) || '-' || (turn % 2), min(turn)) FROM conversations GROUP BY conv_id, (conv_id % 3) || '-' || (turn % 2))")
def log3_turn_citations(spark, d):
    """All turns of a conversation taken as one: a chunk is cited where it came first."""
    cited = L.citations(L.frames(logs(spark, d))).withColumn("seq", F.col("turn")).withColumn("turn", F.lit(0))
    return L.turn_citations(cited).select("conv_id", "seq", "chunk_id")


@query("SELECT conv_id, turn, 0::BIGINT AS seq, 'search' AS name, 2::BIGINT AS result_seq FROM conversations")
def log3_paired_calls(spark, d):
    return L.pair_calls(L.frames(logs(spark, d)))


@query("SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN length(text) = 0 THEN 'empty' WHEN length(text) > 8000 THEN 'too_long' WHEN count(*) OVER (PARTITION BY conv_id) > 50 THEN 'too_many' END AS reason FROM conversations")
def log4_message_admission(spark, d):
    return L.admit_messages(read(spark, d, "conversations").withColumnRenamed("text", "content")).select("conv_id", "turn", "reason")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'connection' WHEN 1 THEN 'authentication' WHEN 2 THEN 'quota' WHEN 3 THEN 'rate_limit' ELSE 'other' END AS kind FROM events")
def log5_failure_kinds(spark, d):
    said = ["Connection refused", "HTTP 401", "429: quota exceeded", "Rate limit hit", "MCP connect failed", "boom"]
    message = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("event_id") % 6 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", X.failure_kind(message).alias("kind"))


def entry(spark, d):
    """The flagship: best passages for each question."""
    return J.search(corpus(spark, d), questions(spark, d))
