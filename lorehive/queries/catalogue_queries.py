"""Catalogue questions: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorehive.functions import text as X
from lorehive.operators import catalog as K
from lorehive.queries.base import DOCS, LINE_CHUNKS, LINKS, documents, line_chunks, links, query, read, with_sql
from lorehive.sources import files as S
from lorehive.stage import new_path

# two tags asked for each benchmark item: a language and a source, one of four of them unknown
ASKED = "asked AS (SELECT item_id::VARCHAR AS query_id, ['en', 'fr', 'de', 'xx'][item_id % 4 + 1] AS tag FROM benchmark UNION ALL SELECT item_id::VARCHAR, 'src' || item_id % 25 FROM benchmark)"


def asked(spark, d):
    i = F.col("item_id")
    rows = read(spark, d, "benchmark")
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "xx")]), (i % 4 + 1).cast("int"))
    return rows.select(i.cast("string").alias("query_id"), lang.alias("tag")).unionByName(rows.select(i.cast("string").alias("query_id"), F.concat(F.lit("src"), i % 25).alias("tag")))


RAW_TAG = "'  ' || upper(source) || ' ' || chr(9) || lang || ' -'"


@query(rf"SELECT doc_id, trim(replace(lower(trim(regexp_replace({RAW_TAG}, '\s+', ' ', 'g'))), ' ', '-'), '-')[1:64] AS tag FROM documents")
def cat1_normalize_tag(spark, d):
    return read(spark, d, "documents").select("doc_id", X.normalize_tag(F.concat(F.lit("  "), F.upper("source"), F.lit(" \t"), "lang", F.lit(" -"))).alias("tag"))


@query("SELECT DISTINCT tag FROM (SELECT source AS tag FROM documents UNION ALL SELECT DISTINCT lower(event_type) FROM events UNION ALL SELECT lang FROM documents)")
def cat2_add_tags(spark, d):
    tags = read(spark, d, "documents").select(F.col("source").alias("tag")).distinct()
    names = read(spark, d, "events").select(F.upper("event_type").alias("tag")).unionByName(read(spark, d, "documents").select(F.concat(F.lit(" "), "lang").alias("tag")))
    return K.add_tags(tags, names)


@query(with_sql(DOCS, LINKS, select="SELECT tag, count(*) AS documents FROM links JOIN docs USING (document_id) WHERE status = 'ready' GROUP BY tag"))
def cat3_ready_tag_counts(spark, d):
    return K.tag_counts(links(spark, d), documents(spark, d), ready_only=True)


@query(with_sql(LINKS, select="SELECT tag, count(*) AS documents FROM links GROUP BY tag"))
def cat3_tag_counts(spark, d):
    return K.tag_counts(links(spark, d), documents(spark, d))


@query(with_sql(ASKED, LINKS, select="SELECT query_id, tag, tag IN (SELECT tag FROM links) AS known FROM asked"))
def cat4_known_tags(spark, d):
    return K.known_tags(asked(spark, d), links(spark, d).select("tag").distinct())


# questions whose tags are all known, some, or none; and some that ask no tag at all
RAW_ASKED = "raw AS (SELECT item_id::VARCHAR AS query_id, unnest(CASE item_id % 5 WHEN 0 THEN ['en', 'src' || item_id % 20] WHEN 1 THEN [' FR ', 'No  Such', 'no-such', NULL] WHEN 2 THEN ['Missing_' || item_id, 'XX y'] WHEN 3 THEN ['--', ' '] ELSE ['de', 'src' || (item_id % 7 + 15), 'Zz'] END) AS tag FROM benchmark WHERE item_id % 11 <> 10), rt AS (SELECT DISTINCT query_id, trim(lower(regexp_replace(trim(tag), '\\s+', '-', 'g')), '-') AS tag FROM raw WHERE tag IS NOT NULL), na AS (SELECT query_id, tag, tag IN (SELECT tag FROM links) AS known FROM rt WHERE tag <> '')"
REPORT = "rep AS (SELECT query_id, coalesce(count_if(known), 0)::BIGINT AS known_tags, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (WHERE NOT known), '') AS unknown_tags FROM (SELECT DISTINCT query_id FROM raw) LEFT JOIN na USING (query_id) GROUP BY 1)"


def raw_asked(spark, d):
    i, text = F.col("item_id"), lambda *x: F.array(*[F.lit(v) if isinstance(v, str) or v is None else v for v in x])
    tags = (
        F.when(i % 5 == 0, text("en", F.concat(F.lit("src"), i % 20))).when(i % 5 == 1, text(" FR ", "No  Such", "no-such", None)).when(i % 5 == 2, text(F.concat(F.lit("Missing_"), i), "XX y"))
        .when(i % 5 == 3, text("--", " ")).otherwise(text("de", F.concat(F.lit("src"), i % 7 + 15), "Zz"))
    )
    return read(spark, d, "benchmark").filter("item_id % 11 <> 10").select(i.cast("string").alias("query_id"), F.explode(tags).alias("tag"))


@query(with_sql(LINKS.replace("links AS (SELECT", "links AS (SELECT DISTINCT"), RAW_ASKED, REPORT, select="SELECT * FROM rep"))
def cat4_tag_report(spark, d):
    """Tags as users write them: how many of a question's exist, and which don't."""
    return K.tag_report(raw_asked(spark, d), links(spark, d).select("tag").distinct())


@query(with_sql(ASKED, LINKS, select="SELECT DISTINCT query_id, document_id FROM asked JOIN links USING (tag)"))
def cat5_any_tag(spark, d):
    return K.tagged(asked(spark, d), links(spark, d), match_all=False)


@query(with_sql(ASKED, LINKS, select="SELECT query_id, document_id FROM asked JOIN links USING (tag) GROUP BY ALL HAVING count(DISTINCT tag) = 2"))
def cat6_all_tags(spark, d):
    return K.tagged(asked(spark, d), links(spark, d), match_all=True)


@query(with_sql(DOCS, select="SELECT document_id, filename FROM docs WHERE lower(filename) LIKE '%c1_2%' OR lower(title) LIKE '%c1_2%'"))
def cat7_name_contains(spark, d):
    return documents(spark, d).filter(K.name_contains("C1_2")).select("document_id", "filename")


@query(with_sql(DOCS, select="SELECT status, count(*) AS documents FROM docs WHERE status IN ('ready', 'failed') GROUP BY status"))
def cat8_status_filter(spark, d):
    return documents(spark, d).filter(F.col("status").isin("ready", "failed")).groupBy("status").agg(F.count("*").alias("documents"))


@query(with_sql(DOCS, select="SELECT document_id, filename, (SELECT count(*) FROM docs WHERE status = 'ready') AS total FROM docs WHERE status = 'ready' ORDER BY made DESC, document_id LIMIT 20 OFFSET 40"))
def cat9_recent_page(spark, d):
    return K.page(documents(spark, d).filter("status = 'ready'"), "recent", 20, 40).select("document_id", "filename", "total")


@query(with_sql(DOCS, select="SELECT document_id, filename, (SELECT count(*) FROM docs) AS total FROM docs ORDER BY lower(filename), document_id LIMIT 50"))
def cat9_page_by_name(spark, d):
    return K.page(documents(spark, d), "name", 50, 0).select("document_id", "filename", "total")


@query(with_sql(DOCS, LINKS, select="SELECT document_id, (SELECT string_agg(tag, ',' ORDER BY tag) FROM links WHERE links.document_id = docs.document_id) AS tags FROM docs"))
def cat10_tags_of_documents(spark, d):
    return K.with_tags(documents(spark, d).select("document_id"), links(spark, d)).select("document_id", "tags")


@query("SELECT source, CASE WHEN n <= 20 THEN 'complete' ELSE 'more' END AS note FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def cat11_paging_notes(spark, d):
    """For the first page of 20 of each source."""
    total = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return total.select("source", K.paging_note(F.least("n", F.lit(20)), F.col("n"), F.lit(0), F.col("n")).alias("note"))


@query(with_sql(DOCS, select="SELECT CASE WHEN count_if(status = 'ready') > 0 THEN 'ready' WHEN count_if(status = 'pending') > 0 THEN 'pending' ELSE 'empty' END AS state FROM docs"))
def cat12_corpus_state(spark, d):
    return K.corpus_state(documents(spark, d))


# references: ids, file names, fragments that fit one, several or no document, blanks
REFS = """refs AS (SELECT item_id::VARCHAR AS ref_id, CASE item_id % 5 WHEN 0 THEN item_id::VARCHAR WHEN 1 THEN ' SRC' || item_id % 20 || '_' || item_id || '.TXT' WHEN 2 THEN 'src1_' || item_id % 9 WHEN 3 THEN 'none' || item_id ELSE ' ' END AS reference FROM benchmark),
nd AS (SELECT ref_id, trim(reference) AS needle FROM refs), idm AS (SELECT ref_id, document_id FROM nd JOIN docs ON needle = document_id),
nm AS (SELECT ref_id, count(*) AS n, min(document_id) AS document_id, string_agg(document_id, ',' ORDER BY document_id) AS c FROM nd JOIN docs ON lower(needle) = lower(filename) WHERE ref_id NOT IN (SELECT ref_id FROM idm) GROUP BY 1),
pt AS (SELECT ref_id, needle, document_id, title, row_number() OVER (PARTITION BY ref_id ORDER BY made DESC, document_id) AS k FROM nd JOIN docs ON lower(filename) LIKE '%' || lower(needle) || '%' OR lower(title) LIKE '%' || lower(needle) || '%' WHERE needle <> '' AND ref_id NOT IN (SELECT ref_id FROM idm) AND ref_id NOT IN (SELECT ref_id FROM nm)),
pg AS (SELECT ref_id, count(*) AS n, min(document_id) AS document_id, string_agg(document_id, ',' ORDER BY k) AS c, count_if(lower(title) = lower(needle)) AS tn, min(CASE WHEN lower(title) = lower(needle) THEN document_id END) AS td FROM pt WHERE k <= 8 GROUP BY 1)"""


RESOLVED = with_sql(DOCS, REFS, select="""SELECT nd.ref_id, CASE WHEN idm.ref_id IS NOT NULL THEN idm.document_id WHEN nm.n = 1 THEN nm.document_id WHEN nm.n IS NULL AND tn = 1 THEN td WHEN nm.n IS NULL AND pg.n = 1 THEN pg.document_id END AS document_id,
CASE WHEN needle = '' THEN 'empty' WHEN idm.ref_id IS NOT NULL THEN 'id' WHEN nm.n = 1 THEN 'filename' WHEN nm.n > 1 THEN 'ambiguous' WHEN tn = 1 THEN 'title' WHEN pg.n = 1 THEN 'partial-name' WHEN pg.n > 1 THEN 'ambiguous' ELSE 'none' END AS matched_on,
CASE WHEN idm.ref_id IS NOT NULL OR nm.n = 1 THEN '' WHEN nm.n > 1 THEN nm.c WHEN tn = 1 OR pg.n = 1 OR pg.n IS NULL THEN '' ELSE pg.c END AS candidates
FROM nd LEFT JOIN idm ON idm.ref_id = nd.ref_id LEFT JOIN nm ON nm.ref_id = nd.ref_id LEFT JOIN pg ON pg.ref_id = nd.ref_id""")


@query(RESOLVED)
def cat13_resolve(spark, d):
    return K.resolve(references(spark, d), documents(spark, d))


@query(RESOLVED)
def cat13_stored_names(spark, d):
    """The same by a stored index of names, of which only the asked runs of characters are read."""
    path, docs = new_path(spark, "names"), documents(spark, d)
    S.write_catalogue({"name_grams": K.name_grams(docs)}, path)
    return K.resolve(references(spark, d), docs, grams=S.stored_grams(spark, f"{path}/name_grams"))


def references(spark, d):
    i = F.col("item_id")
    said = (
        F.when(i % 5 == 0, i.cast("string")).when(i % 5 == 1, F.concat(F.lit(" SRC"), i % 20, F.lit("_"), i, F.lit(".TXT"))).when(i % 5 == 2, F.concat(F.lit("src1_"), i % 9)).when(i % 5 == 3, F.concat(F.lit("none"), i)).otherwise(" ")
    )
    return read(spark, d, "benchmark").select(i.cast("string").alias("ref_id"), said.alias("reference"))


@query("SELECT user_id::VARCHAR AS query_id, props->>'$.k' AS document_id, min(event_id) AS position FROM events GROUP BY 1, 2")
def cat14_distinct_documents(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("query_id"), F.get_json_object("props", "$.k").alias("document_id"), F.col("event_id").alias("position"))
    return K.distinct_documents(rows)


@query(with_sql(DOCS, LINKS, select="SELECT document_id, filename, CASE WHEN doc_id % 3 > 0 THEN text[1:50] ELSE '(no summary)' END AS summary, (SELECT string_agg(tag, ',' ORDER BY tag) FROM links WHERE links.document_id = docs.document_id) AS tags, CASE status WHEN 'ready' THEN NULL WHEN 'failed' THEN 'processing failed' ELSE 'not searchable yet' END AS note FROM docs"))
def cat15_document_view(spark, d):
    docs = documents(spark, d).withColumn("summary", F.when(F.col("doc_id") % 3 > 0, F.substring("text", 1, 50)))
    return K.document_view(docs, links(spark, d)).select("document_id", "filename", "summary", "tags", "note")


@query(with_sql(LINE_CHUNKS, "b AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR heading_path IS DISTINCT FROM lag(heading_path) OVER w THEN 1 ELSE 0 END AS begins FROM lc WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)), i AS (SELECT *, sum(begins) OVER (PARTITION BY document_id ORDER BY chunk_index) AS island FROM b)", select="SELECT document_id, any_value(heading_path) AS heading_path, min(chunk_index) AS first_chunk_index, max(chunk_index) AS last_chunk_index, arg_min(page, chunk_index) AS page FROM i GROUP BY document_id, island"))
def out1_outline(spark, d):
    return K.outline(line_chunks(spark, d))


@query(with_sql(LINE_CHUNKS, select="SELECT chunk_id, document_id, chunk_index, min(chunk_index) OVER w AS first_index, max(chunk_index) OVER w AS last_index, array_to_string(list(text) OVER w, chr(10) || chr(10)) AS context FROM lc WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING)"))
def ctx1_context(spark, d):
    return K.context(line_chunks(spark, d), 2, 1)


@query(with_sql(LINE_CHUNKS, "rq AS (SELECT document_id AS request_id, document_id, chunk_index AS spot FROM lc WHERE chunk_index = document_id::BIGINT % 4)", select="SELECT request_id, min(chunk_index) AS first_index, max(chunk_index) AS last_index, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS context FROM rq JOIN lc ON rq.document_id = lc.document_id AND chunk_index BETWEEN spot - 1 AND spot + 2 GROUP BY 1"))
def ctx1_requested_context(spark, d):
    rows = line_chunks(spark, d)
    asked = rows.filter("chunk_index = cast(document_id as long) % 4").select(F.col("document_id").alias("request_id"), "chunk_id", F.lit(1).alias("before"), F.lit(2).alias("after"))
    return K.context_of(asked, rows)
