"""The queries of this subpackage in SQL, where SQL can express them."""

from __future__ import annotations

from lorehive.llm import secret_scan

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP3 = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, coalesce(url, '') AS u FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, lower(array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1), ':[0-9]+$', ''), '.')), ',') || ')' || coalesce(nullif(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || CASE WHEN regexp_extract(u, '\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(u, '\?([^#]*)', 1) ELSE '' END) AS url_key FROM p),
b AS (SELECT page_id, payload_bytes, url_key, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) % 32 + 1, 1)), '') AS payload_digest FROM d),
o AS (SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to,
strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured, url_key FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM b))
SELECT *, row_number() OVER (ORDER BY url_key, captured, page_id NULLS FIRST) - 1 AS place FROM o"""

OP9 = f"""WITH s AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key, {WORDS} AS size FROM documents),
z AS (SELECT *, CASE WHEN size > 0 THEN 1::BIGINT << (length(bin(size)) - 1) ELSE 0 END AS cls, (('0x' || substr(md5('mix' || chr(1) || coalesce(doc_id::VARCHAR, chr(2))), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM s),
src AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM s GROUP BY key),
w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight, source_size::DOUBLE * 2 AS cap FROM src),
f AS (SELECT *, cap / weight AS fills, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget, sum(weight) OVER () AS allw FROM w),
g AS (SELECT *, (budget - coalesce(sum(cap) OVER o, 0)) / (allw - coalesce(sum(weight) OVER o, 0)) AS level FROM f WINDOW o AS (ORDER BY fills, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT key, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, (fills, key)) FROM g WHERE level <= fills), cap)) AS target FROM g),
c AS (SELECT key, cls, sum(size)::BIGINT AS words, sqrt(cls::DOUBLE) AS tilt FROM z WHERE cls > 0 GROUP BY 1, 2),
l AS (SELECT c.*, target, (target - coalesce(sum(words) OVER (PARTITION BY key ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2) / sum(words * tilt) OVER (PARTITION BY key ORDER BY cls DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c JOIN t USING (key)),
r AS (SELECT key, cls, words, least(2.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(max_by(level, CASE WHEN level * tilt <= 2 THEN cls END) OVER (PARTITION BY key) * tilt, 2.0))) AS rate FROM l),
k AS (SELECT key, sum(floor(rate) * words) AS certain FROM r GROUP BY 1),
q AS (SELECT z.*, t.source_size, t.target, t.target - coalesce(certain, 0) AS rest, coalesce(floor(rate), 0) AS whole, CASE WHEN rate - floor(rate) > 0 THEN (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS q FROM z JOIN t USING (key) LEFT JOIN r USING (key, cls) LEFT JOIN k USING (key)),
a AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY key ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS ahead FROM q),
e AS (SELECT *, (whole + CASE WHEN q IS NOT NULL AND rest > 0 AND ahead <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM a)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM e"""

CONTROL = r"(\\*)(<s>|</s>|\[INST\]|\[/INST\])"
ESCAPED = "regexp_replace({}, '" + CONTROL + r"', '\\\1\2', 'g')"

OP10 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, CASE WHEN r = 'assistant' THEN 9 + length({ESCAPED.format('t')}) ELSE 15 + length({ESCAPED.format("replace(replace(r, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + length({ESCAPED.format('t')}) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256, coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM x GROUP BY conv_id"""


def _spans(name: str, pattern: str, kind: int, group: int) -> str:
    """Matches of a kind, one row each: row number, start, kind, end, value."""
    p = pattern.replace("'", "''")
    found = f"SELECT n, string_split_regex(t, '{p}') AS gap, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}')"
    size = "list_sum(list_transform({}, lambda x: length(x)))"
    start = f"({size.format('gap[1:i]')} + coalesce({size.format('m[1:i - 1]')}, 0))::BIGINT"
    return f"{name} AS (SELECT n, {start} AS a, {kind} AS kind, {start} + length(m[i]) AS b, v[i] AS val FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({found})))"


VARIED = "len(list_distinct(regexp_extract_all(val, '.')))"
OP1 = f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, coalesce(text, '') AS t, source, coalesce(source, chr(2)) || chr(1) || coalesce(lang, chr(2)) AS repo FROM documents),
{_spans('s0', secret_scan.ASSIGN, 0, 2)}, {_spans('s1', secret_scan.ACCESS, 1, 0)}, {_spans('s2', secret_scan.HEX, 2, 0)}, {_spans('s3', secret_scan.RUN, 3, 0)},
base AS (SELECT * FROM s0 WHERE length(val) >= 8 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
runs AS (SELECT * FROM s3 r WHERE regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9]') AND {VARIED} >= 10 AND NOT EXISTS (SELECT 1 FROM base x WHERE x.n = r.n AND x.a < r.b AND r.a < x.b)),
every AS (SELECT *, kind = 3 OR (regexp_matches(val, '[0-9]') AND {VARIED} >= 8) AS varied FROM (SELECT * FROM base UNION ALL SELECT * FROM runs)),
own AS (SELECT val, count(DISTINCT coalesce(source, chr(2))) AS owners, count(DISTINCT repo) AS repos, bool_or(varied) AS varied FROM every JOIN d USING (n) GROUP BY 1),
cls AS (SELECT e.n, e.a, e.kind, e.b, NOT (owners >= 3 OR repos >= 4) AND own.varied AS live, owners >= 3 OR repos >= 4 AS copied FROM every e JOIN own USING (val)),
per AS (SELECT n, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR live) AS spans, count_if(live) AS n_live, count_if(copied) AS n_copied FROM cls GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied FROM d LEFT JOIN per USING (n)"""

#: crc32 with the reversed polynomial, a byte at a time over its table.
OP11 = r"""WITH t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM d, t),
w AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
gap AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
part AS (SELECT word, n, substr(word, 1, i - 1) AS x, substr(word, i + 1) AS y FROM gap),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM part a JOIN part b ON a.x = b.x AND a.y = b.y WHERE a.word <> b.word
UNION SELECT a.word, b.word, b.n FROM part a JOIN v b ON b.word = a.x || a.y UNION SELECT b.word, a.word, a.n FROM part a JOIN v b ON b.word = a.x || a.y),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM near GROUP BY 1),
f AS (SELECT v.word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (WITH RECURSIVE up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, up.next, f.form FROM up JOIN f ON f.word = up.next) SELECT word, root FROM up WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)"""

OP12 = r"""WITH x AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
y AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS again FROM x),
m AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(again, false)] AS fails FROM y),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
s AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
g AS (SELECT part, filter_order, fails, n, good, toxic, list_position(list_transform(range(1, 6), lambda k: fails[ascii(substr(filter_order, k, 1)) - 64]), true) AS gone FROM s, o),
k AS (SELECT part, filter_order, unnest(range(1, 6))::INTEGER AS step FROM (SELECT DISTINCT part, filter_order FROM g)),
z AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS c, count_if(false) AS zero, coalesce(sum(n) FILTER (WHERE gone IS NULL OR gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE gone = step), 0)::BIGINT AS removed,
coalesce(sum(n) FILTER (WHERE gone < step AND fails[ascii(substr(filter_order, step, 1)) - 64]), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails[ascii(substr(filter_order, step, 1)) - 64] AND len(list_filter(fails, lambda b: b)) = 1), 0)::BIGINT AS unique_fails,
coalesce(sum(good) FILTER (WHERE gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE gone = step), 0)::BIGINT AS toxic_lost FROM k JOIN g USING (part, filter_order) GROUP BY 1, 2, 3)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, c)::BIGINT AS shapley FROM z"""

OP13 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT r, doc_id, i, word, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS key, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n FROM p),
a AS (SELECT r, i, word, n = 50 AND doc_id > min(doc_id) OVER (PARTITION BY key, n) AS again FROM s),
c AS (SELECT r, i, word, coalesce(bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM a),
e AS (SELECT r, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN e USING (r)"""

SQL = {"op1_secret_scan": OP1, "op3_warc_index": OP3, "op9_pareto_mix": OP9, "op10_chat_format": OP10, "op11_permuterm_variants": OP11, "op12_lehmer_filter_audit": OP12, "op13_block_anchors": OP13}
