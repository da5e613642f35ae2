"""The jobs as queries over the given tables: each runs twice into a new folder and gives what is there after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.catalog import DENSE_SQL, _chunk_sql, _hash64_sql, _scratch
from jobs import known_items, refresh_index


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _scratch(spark)
    for _ in range(2):
        refresh_index.refresh(spark, f"{sf_dir}/documents.parquet", out)
    signs = [F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"), F.size(F.filter("embedding", lambda x: x < 0)).alias("n_negative")]
    return refresh_index.current(spark, out).select("lang", "doc_id", "chunk_id", "n", "start", "end", "text_hash", *signs)


def job2_known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _scratch(spark)
    for _ in range(2):
        known_items.evaluate(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    rounded = [F.round(c, 9).alias(c) for c in ("recall", "mrr", "ndcg")]
    return spark.read.parquet(f"{out}/scores").select("query_id", "n_relevant", *rounded, "best", "best_lang", "run")


JOB1_SQL = f"""WITH {_chunk_sql()}, {_hash64_sql('c', 'chunk_id', 'e')},
s AS (SELECT chunk_id, count(*) FILTER (WHERE value > 0)::INT AS n_positive, count(*) FILTER (WHERE value < 0)::INT AS n_negative FROM e GROUP BY chunk_id)
SELECT coalesce(nullif(trim(lang), ''), 'und') AS lang, c.doc_id, c.chunk_id, n, "start", "end", sha256(c.text) AS text_hash, coalesce(n_positive, 0) AS n_positive, coalesce(n_negative, 0) AS n_negative
FROM c JOIN documents d ON c.doc_id = d.doc_id::VARCHAR LEFT JOIN s ON c.chunk_id = s.chunk_id"""

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_WINDOWS = "unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i : i + 7], ' ')))"
JOB2_SQL = f"""WITH {DENSE_SQL}, qw AS (SELECT DISTINCT item_id, {_WINDOWS} AS x FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
cw AS (SELECT chunk_id, {_WINDOWS} AS x FROM (SELECT chunk_id, {_WORDS} AS w FROM c)), t AS (SELECT DISTINCT item_id, chunk_id FROM qw JOIN cw ON qw.x = cw.x),
n AS (SELECT b.item_id, count(t.chunk_id) AS n FROM benchmark b LEFT JOIN t ON b.item_id = t.item_id GROUP BY b.item_id),
m AS (SELECT r.item_id, count(t.chunk_id) AS hits, coalesce(max(CASE WHEN t.chunk_id IS NOT NULL THEN 1.0::DOUBLE / rank END), 0) AS rr, coalesce(sum(CASE WHEN t.chunk_id IS NOT NULL THEN 1 / log2(rank + 1) END), 0) AS gain,
  min_by(r.chunk_id, rank) AS best FROM r LEFT JOIN t ON t.item_id = r.item_id AND t.chunk_id = r.chunk_id WHERE rank <= 5 GROUP BY r.item_id)
SELECT n.item_id AS query_id, n.n AS n_relevant, CASE WHEN n.n > 0 THEN round(hits / n.n, 9) END AS recall, CASE WHEN n.n > 0 THEN round(rr, 9) END AS mrr,
  CASE WHEN n.n > 0 THEN round(gain / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n.n, 5) + 1) g(i)), 9) END AS ndcg, best, coalesce(nullif(trim(lang), ''), 'und') AS best_lang, 'baseline' AS run
FROM n LEFT JOIN m ON n.item_id = m.item_id LEFT JOIN documents d ON d.doc_id::VARCHAR = split_part(best, '#', 1)"""

QUERIES = {"job1_refresh_index": job1_refresh_index, "job2_known_items": job2_known_items}
ORACLES = {"job1_refresh_index": JOB1_SQL, "job2_known_items": JOB2_SQL}
