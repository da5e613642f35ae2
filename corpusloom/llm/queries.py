"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, table

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=1, forget=False)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.katz import score

    return score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1, order=3)


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    out = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.bytebpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES, default="allow", keep=("page_id",))


def op6_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.quality_rules import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("anomaly")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.winnowing import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


def op11_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.private_spans import find

    return find(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# What SQL can say of operators whose whole results it can't: the same rows, by the same calls, fewer columns.


def bpe_decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_forest(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def winnowing_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_winnowing(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def private_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_private_spans(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUERIES = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_katz_backoff": op2_katz_backoff,
    "op3_weak_toxicity": op3_weak_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_byte_bpe": op5_byte_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op6_quality_forest": op6_quality_forest,
    "op7_html_text": op7_html_text,
    "op10_winnowing": op10_winnowing,
    "op11_private_spans": op11_private_spans,
    "op12_filter_audit": op12_filter_audit,
    "bpe_decoded_text": bpe_decoded_text,
    "quality_statistics": quality_statistics,
    "winnowing_edits": winnowing_edits,
    "private_base_spans": private_base_spans,
}

OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS h FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, list(h) AS hs, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT s.doc_id, s.h, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.df, s.h) AS r FROM s JOIN (SELECT h, count(*) AS df FROM s GROUP BY h) f ON s.h = f.h),
prefix AS (SELECT rare.doc_id, h FROM rare JOIN n ON rare.doc_id = n.doc_id WHERE r <= n - ceil(0.9 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.h = b.h AND a.doc_id < b.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN sets x ON c.a = x.doc_id JOIN sets y ON c.b = y.doc_id
  WHERE 190 * len(list_intersect(x.hs, y.hs)) >= 90 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.t FROM r JOIN e ON r.v = e.a WHERE r.t < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.t) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON r.v = d.doc_id GROUP BY d.doc_id, n.n
"""

# What the made pages' articles hold: the general operator does more than SQL can say.
OP7_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&amp;?', '&', 'g') AS t FROM a),
s AS (SELECT page_id, url, trim(regexp_replace(t, '[\s\x0B\p{Z}]+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars FROM s
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot h ON k.key = h.key GROUP BY doc_id
"""

OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""

OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(min(w.doc_id) OVER (PARTITION BY text) < w.doc_id, false) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT *, unnest([{'f': 'A', 'fails': a}, {'f': 'B', 'fails': b}, {'f': 'C', 'fails': c}, {'f': 'D', 'fails': d}, {'f': 'E', 'fails': e}]) AS u,
  (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM f),
n AS (SELECT part, failed, count(*) // 5 AS n, count(*) FILTER (WHERE good) // 5 AS n_good, count(*) FILTER (WHERE toxic) // 5 AS n_toxic FROM x GROUP BY part, failed),
k(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM k p, k q, k r, k s, k t WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
st AS (SELECT filter_order, i::INT AS step, filter_order[i] AS f, left(filter_order, (i - 1)::BIGINT) AS earlier FROM o, range(1, 6) t(i)),
j AS (SELECT n.*, filter_order, step, f, contains(failed, f) AS fails, regexp_matches(failed, '[' || earlier || '0]') AS gone FROM n, st),
y AS (SELECT part, filter_order, step, any_value(f) AS f, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failed = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM j GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM y
"""

DECODED_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"

STATISTICS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS pos, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS words FROM w),
c AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS spot FROM c WHERE n >= 2) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""

EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT doc_id, t, n, coalesce(lead(t) OVER o, first_value(t) OVER o) AS following FROM d WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 4) || substr(following, 1, n // 4)) AS edited_sha256 FROM x
"""

# A match begins after the matches before it and the texts between them.
SPANS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, 1 AS rank, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS ms, regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gaps FROM d UNION ALL
  SELECT doc_id, 2 AS rank, 'ip' AS kind, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ms, regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS gaps FROM d UNION ALL
  SELECT doc_id, 3 AS rank, 'card' AS kind, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') AS ms, regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+') AS gaps FROM d UNION ALL
  SELECT doc_id, 4 AS rank, 'phone' AS kind, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS ms, regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') AS gaps FROM d),
m AS (SELECT doc_id, rank, kind, unnest(ms) AS x, unnest(gaps[:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM f WHERE len(ms) > 0),
s AS (SELECT doc_id, rank, kind, x, regexp_replace(x, '[^0-9]', '', 'g') AS digits, (sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, rank ORDER BY i))::BIGINT AS stop FROM m),
ok AS (SELECT doc_id, rank, kind, stop - length(x) AS start, stop FROM s WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN list_max(list_transform(string_split(x, '.'), lambda p: p::DOUBLE)) <= 255
  WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN j % 2 = 1 THEN reverse(digits)[j]::INT
    ELSE 2 * reverse(digits)[j]::INT // 10 + 2 * reverse(digits)[j]::INT % 10 END)) % 10 = 0
  ELSE length(digits) BETWEEN 8 AND 15 END)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card,
  count(*) FILTER (WHERE kind = 'phone') AS n_phone, sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start), '')) AS base_sha256
FROM d LEFT JOIN ok ON d.doc_id = ok.doc_id GROUP BY d.doc_id
"""

ORACLES = {
    "op4_ngram_join": OP4_SQL,
    "op7_html_text": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op12_filter_audit": OP12_SQL,
    "bpe_decoded_text": DECODED_SQL,
    "quality_statistics": STATISTICS_SQL,
    "winnowing_edits": EDITS_SQL,
    "private_base_spans": SPANS_SQL,
}
