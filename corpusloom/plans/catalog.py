"""The query catalogue: each operator applied to the driver's tables, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import vector as vc
from corpusloom.functions.html import extract_text, strip_tags
from corpusloom.operators import balls, chunk, embed, fulltext, golden, index, metrics, prompt, search, traces
from corpusloom.sources.files import regroup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def _chunks(spark, d, how="fixed512") -> DataFrame:
    return chunk.chunks(_docs(spark, d), how)


# --- SQL that several queries share -----------------------------------------------------------------------------



def _chunk_sql(size: int = 512, overlap: int = 64) -> str:
    stride = size - overlap
    return (
        f"c AS (SELECT doc_id::VARCHAR AS doc_id, doc_id::VARCHAR || '#c' || n AS chunk_id, n::INT AS n, (n * {stride})::INT AS \"start\", "
        f"least(n * {stride} + {size}, length(text))::INT AS \"end\", substr(text, n * {stride} + 1, {size}) AS text FROM "
        f"(SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) > 0 THEN greatest(ceil((length(text) - {overlap}) / {stride}.0), 1)::BIGINT ELSE 0 END)) AS n FROM documents))"
    )


def _hash64_sql(source: str, key: str, out: str) -> str:
    digit = lambda at: f"(strpos('0123456789abcdef', substr(h, {at}, 1)) - 1)"
    return (
        f"{out} AS (SELECT k AS {key}, ({digit(8)} + 16 * ({digit(7)} % 4))::INT AS bucket, sum(CASE WHEN {digit(10)} % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS value FROM "
        f"(SELECT {key} AS k, sha256(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS h FROM {source}) GROUP BY ALL)"
    )


STRIP = r"regexp_replace({}, '^[\s\x0B\p{{Z}}]+|[\s\x0B\p{{Z}}]+$', '', 'g')"
SQUEEZE = r"trim(regexp_replace({}, '[\s\x0B\p{{Z}}]+', ' ', 'g'))"

# --- B: text ----------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, length(t)::INT AS n, sha256(t) AS h FROM (SELECT doc_id,
  {STRIP.format("replace(replace(chr(13) || chr(10) || ' ' || replace(text, chr(10), chr(13)) || '  ' || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS t FROM documents)""")
def normalize_text(spark, d):
    t = tx.normalize(F.concat(F.lit("\r\n "), F.translate("text", "\n", "\r"), F.lit("  \n")))
    return _t(spark, d, "documents").select("doc_id", F.length(t).alias("n"), F.sha2(t, 256).alias("h"))


@query(r"SELECT doc_id, sha256(regexp_replace(replace(text, chr(10), repeat(chr(10), 4)), '\n{3,}', chr(10) || chr(10), 'g')) AS h FROM documents")
def blank_run_collapse(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(tx.collapse_blank_runs(F.replace("text", F.lit("\n"), F.lit("\n\n\n\n"))), 256).alias("h"))


@query(f"SELECT doc_id, sha256({SQUEEZE.format('text')}) AS h FROM documents")
def whitespace_squeeze(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(tx.squeeze(F.col("text")), 256).alias("h"))


@query(f"""SELECT doc_id, sha256(array_to_string(list_transform(string_split(replace(text, '. ', ' ' || chr(10) || chr(9)), chr(10)),
  lambda x: {STRIP.format("x")}), chr(10))) AS h FROM documents""")
def strip_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(tx.strip_lines(F.replace("text", F.lit(". "), F.lit(" \n\t"))), 256).alias("h"))


@query(r"SELECT page_id, regexp_replace(p, '([^/])\.[^./]+$', '\1') AS doc FROM (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS p FROM pages)")
def doc_id_from_path(spark, d):
    return _t(spark, d, "pages").select("page_id", tx.doc_id_from_path(F.regexp_extract("url", "://([^?#]*)", 1)).alias("doc"))


# Without the scripts, styles and comments, then without tags; the seven entities, "&amp;" last; one space for white space.
_BARE_SQL = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_DECODED_SQL = f"replace(replace(replace(replace(replace(replace(replace({_BARE_SQL}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query(f"SELECT page_id, trim(regexp_replace({_DECODED_SQL}, '[ \t\r\n\f]+', ' ', 'g'), ' ') AS text FROM pages")
def html_strip_sql(spark, d):
    return _t(spark, d, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))


@query()
def html_to_text(spark, d):
    return _t(spark, d, "pages").select("page_id", extract_text(F.col("html")).alias("text"))


@query("SELECT doc_id, length(text)::INT AS n, sha256(text) AS h FROM documents")
def utf8_text(spark, d):
    t = tx.utf8(F.col("text").cast("binary"))
    return _t(spark, d, "documents").select("doc_id", F.length(t).alias("n"), F.sha2(t, 256).alias("h"))


# Every document as a page with chrome around it, its text escaped in a paragraph.
_PAGE = [
    "<html><head><title>t</title><style>p {}</style></head><body><div class=\"navheader\"><table><tr><td>", "lang", "</td></tr></table></div><script>if (1 < 2) x()</script><p>", "text",
    "</p><div>in <b>", "lang", "</b><a class=\"id_link\" href=\"#x\">#</a></div><div class=\"wide navfooter\"><p>", "source", "</p></div></body></html>",
]


@query(f"""SELECT doc_id, sha256({STRIP.format("regexp_replace(t || chr(10) || chr(10) || 'in ' || lang, '\n{{3,}}', chr(10) || chr(10), 'g')")}) AS h FROM (SELECT doc_id, lang,
  array_to_string(list_transform(string_split(replace(text, chr(160), ' '), chr(10)), lambda x: {STRIP.format("x")}), chr(10)) AS t FROM documents)""")
def html_of_known_text(spark, d):
    escaped = {"text": F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))}
    parts = [escaped.get(x, F.col(x) if x in ("lang", "source") else F.lit(x)) for x in _PAGE]
    return _t(spark, d, "documents").select("doc_id", F.sha2(extract_text(F.concat(*parts)), 256).alias("h"))


@query(f"SELECT conv_id::VARCHAR AS path, {STRIP.format('string_agg(text, chr(10) || chr(10) ORDER BY turn, text)')} AS text FROM conversations GROUP BY conv_id")
def regroup_parts(spark, d):
    return regroup(_t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("pos"), "text"))


# --- C: chunks --------------------------------------------------------------------------------------------------


@query(f"WITH {_chunk_sql()} SELECT * FROM c")
def chunk_fixed512(spark, d):
    return _chunks(spark, d)


@query(f"WITH {_chunk_sql(100, 0)} SELECT chunk_id, n, \"start\", \"end\", text FROM c")
def chunk_small_overlap0(spark, d):
    return _chunks(spark, d, chunk.FixedSize(100, 0)).select("chunk_id", "n", "start", "end", "text")


@query(f"WITH {_chunk_sql()} SELECT chunk_id, sha256(text) AS text_hash FROM c")
def chunk_hash(spark, d):
    return chunk.with_hash(_chunks(spark, d)).select("chunk_id", "text_hash")


@query(f"WITH {_chunk_sql()} SELECT d.doc_id::VARCHAR AS doc_id, length(d.text)::INT AS chars, count(c.doc_id)::INT AS n_chunks FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id::VARCHAR GROUP BY d.doc_id, d.text")
def chunk_counts(spark, d):
    return chunk.list_docs(_docs(spark, d))


@query(f"""WITH {_chunk_sql()}, p AS (SELECT chunk_id, text, lead(text) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM c)
SELECT chunk_id, right(text, 64) = left(next, 64) AS overlaps FROM p WHERE next IS NOT NULL""")
def chunk_overlap_check(spark, d):
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("doc_id").orderBy("n"))
    return _chunks(spark, d).withColumn("next", nxt).where("next IS NOT NULL").select("chunk_id", (F.right("text", F.lit(64)) == F.left("next", F.lit(64))).alias("overlaps"))




@query(rf"""WITH {_chunk_sql()}, m AS (SELECT chunk_id, text, regexp_extract(text, '(?i)licen[sc]e\w*|token') AS f FROM c WHERE regexp_matches(text, '(?i)licen[sc]e\w*|token')),
p AS (SELECT *, strpos(text, f) - 1 AS pos FROM m)
SELECT chunk_id, {SQUEEZE.format("substr(text, (greatest(pos - 60, 0) + 1)::BIGINT, (pos + length(f) + 60 - greatest(pos - 60, 0))::BIGINT)")} AS snippet FROM p""")
def grep_chunks(spark, d):
    return chunk.grep(_chunks(spark, d), r"licen[sc]e\w*|token")


@query(f"""WITH {_chunk_sql()} SELECT chunk_id, chunk_id || ' [' || "start" || ':' || "end" || ') ' || substr(sha256(text), 1, 12) AS header, {SQUEEZE.format("text")} AS body FROM c""")
def show_doc(spark, d):
    return chunk.show(_chunks(spark, d))


# --- D: embedding -----------------------------------------------------------------------------------------------


@query(f"WITH {_chunk_sql()}, {_hash64_sql('c', 'chunk_id', 'e')} SELECT * FROM e")
def hash64_cells(spark, d):
    return embed.hash64_cells(_chunks(spark, d), "chunk_id")


@query(f"""WITH {_hash64_sql('benchmark', 'item_id', 'e')}, n AS (SELECT item_id, sqrt(sum(value * value)::DOUBLE) AS norm FROM e GROUP BY item_id)
SELECT item_id, bucket, round(CASE WHEN norm > 0 THEN value / norm ELSE 0 END, 6) AS x FROM e JOIN n USING (item_id) WHERE value <> 0""")
def hash64_unit_norm(spark, d):
    v = embed.embed(_t(spark, d, "benchmark"), embed.embedder("hash64"), "item_id", counts=True)
    return v.select("item_id", F.posexplode(vc.unit(F.col("embedding"))).alias("bucket", "x")).where("x <> 0").select("item_id", "bucket", F.round("x", 6).alias("x"))


@query(f"""WITH {_hash64_sql('benchmark', 'item_id', 'e')}, n AS (SELECT item_id, sqrt(sum(value * value)::DOUBLE) AS norm FROM e GROUP BY item_id)
SELECT item_id, bucket, (value / norm)::FLOAT::DOUBLE AS x FROM e JOIN n USING (item_id) WHERE value <> 0""")
def float32_vectors(spark, d):
    v = embed.embed(_t(spark, d, "benchmark"), embed.embedder("hash64"), "item_id")
    return v.select("item_id", F.posexplode("embedding").alias("bucket", "x")).where("x <> 0").select("item_id", "bucket", F.col("x").cast("double").alias("x"))


@query(f"WITH {_chunk_sql()} SELECT DISTINCT sha256(text) AS key, text FROM c")
def embed_unique_keys(spark, d):
    return embed.unique_keys(_chunks(spark, d))


def _cache(spark, d) -> DataFrame:
    """A cache that holds the vectors of first chunks, under one model, and of others under another."""
    c = chunk.with_hash(_chunks(spark, d))
    return c.select(F.when(F.col("n") == 0, "hash64").otherwise("other").alias("model"), F.col("text_hash").alias("key")).distinct()


CACHE_SQL = "k AS (SELECT DISTINCT CASE WHEN n = 0 THEN 'hash64' ELSE 'other' END AS model, sha256(text) AS key FROM c)"


@query(f"WITH {_chunk_sql()}, {CACHE_SQL} SELECT DISTINCT sha256(text) AS key, text FROM c WHERE sha256(text) NOT IN (SELECT key FROM k WHERE model = 'hash64')")
def cache_misses(spark, d):
    return embed.misses(_chunks(spark, d), _cache(spark, d), "hash64")


@query(f"""WITH {_chunk_sql()}, {CACHE_SQL}, u AS (SELECT DISTINCT sha256(text) AS key FROM c)
SELECT count(*) FILTER (WHERE h) AS hits, count(*) FILTER (WHERE NOT h) AS misses FROM (SELECT key IN (SELECT key FROM k WHERE model = 'hash64') AS h FROM u)""")
def cache_stats(spark, d):
    return embed.cache_stats(_chunks(spark, d), _cache(spark, d), "hash64")


# --- E: index ---------------------------------------------------------------------------------------------------

# The stored corpus is the documents before an edit: longer texts in one language, shorter and other ones in others.
STORED = "CASE lang WHEN 'de' THEN text || text WHEN 'fr' THEN substr(text, 1, CAST(length(text) * 0.6 AS INT)) WHEN 'es' THEN replace(text, 'a', 'A') ELSE text END"


def _old_new(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, d, "documents")

    def chunked(rows):
        c = chunk.with_hash(chunk.chunks(rows))
        return c.select(F.lit("fixed512").alias("strategy"), "chunk_id", "doc_id", "n", "text", "text_hash")

    return chunked(docs.select("doc_id", F.expr(STORED).alias("text"))), chunked(docs.select("doc_id", "text"))


def _old_new_sql() -> str:
    old = _chunk_sql().replace("c AS (", "o AS (SELECT *, sha256(text) AS text_hash FROM (", 1).replace("FROM documents", f"FROM (SELECT doc_id, {STORED.replace('length(text) * 0.6 AS', 'floor(length(text) * 0.6) AS')} AS text FROM documents)") + ")"
    new = _chunk_sql().replace("c AS (", "n AS (SELECT *, sha256(text) AS text_hash FROM (", 1) + ")"
    return f"{old}, {new}, a AS (SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN n.chunk_id IS NULL THEN 'delete' WHEN o.text_hash <> n.text_hash THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.chunk_id = n.chunk_id)"


@query(f"WITH {_old_new_sql()} SELECT 'fixed512' AS strategy, chunk_id, action FROM a")
def index_change_set(spark, d):
    return index.change_set(*_old_new(spark, d))


@query(f"WITH {_old_new_sql()} SELECT chunk_id, text_hash FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n)")
def index_stale_delete(spark, d):
    return index.stale(*_old_new(spark, d), "fixed512").select("chunk_id", "text_hash")


def _vectors(old: DataFrame) -> DataFrame:
    """Vectors of two models for the stored chunks, of the second for even chunks only."""
    return old.withColumn("model", F.explode(F.when(F.col("n") % 2 == 0, F.array(F.lit("m1"), F.lit("m2"))).otherwise(F.array(F.lit("m1"))))).select("strategy", "chunk_id", "model", "text_hash")


VECTORS_SQL = "v AS (SELECT chunk_id, 'm1' AS model, text_hash FROM o UNION ALL SELECT chunk_id, 'm2', text_hash FROM o WHERE n % 2 = 0)"


@query(f"WITH {_old_new_sql()}, {VECTORS_SQL} SELECT chunk_id, model FROM v WHERE chunk_id IN (SELECT chunk_id FROM n)")
def index_cascade(spark, d):
    old, new = _old_new(spark, d)
    return index.cascade(_vectors(old), new).select("chunk_id", "model")


@query(f"WITH {_old_new_sql()}, {VECTORS_SQL} SELECT n.chunk_id, n.text_hash FROM n LEFT JOIN v ON v.model = 'm2' AND v.chunk_id = n.chunk_id WHERE v.text_hash IS NULL OR v.text_hash <> n.text_hash")
def index_todo_embed(spark, d):
    old, new = _old_new(spark, d)
    return index.to_embed(new, _vectors(old), "m2").select("chunk_id", "text_hash")


@query(f"WITH {_old_new_sql()} SELECT action, count(*) AS n FROM a GROUP BY action")
def index_stats(spark, d):
    return index.change_set(*_old_new(spark, d)).groupBy("action").agg(F.count("*").alias("n"))


@query(f"""WITH {_old_new_sql()}, {VECTORS_SQL}, k AS (SELECT * FROM v WHERE chunk_id IN (SELECT chunk_id FROM n)),
f AS (SELECT n.chunk_id, 'm2' AS model, n.text_hash FROM n LEFT JOIN v ON v.model = 'm2' AND v.chunk_id = n.chunk_id WHERE v.text_hash IS NULL OR v.text_hash <> n.text_hash)
SELECT chunk_id, model, text_hash FROM k WHERE (chunk_id, model) NOT IN (SELECT chunk_id, model FROM f) UNION ALL SELECT * FROM f""")
def index_upserted_vectors(spark, d):
    old, new = _old_new(spark, d)
    kept = index.cascade(_vectors(old), new)
    fresh = index.to_embed(new, kept, "m2").select("strategy", "chunk_id", F.lit("m2").alias("model"), "text_hash")
    return index.upsert_vectors(kept, fresh).select("chunk_id", "model", "text_hash")


def _scratch(spark) -> str:
    """A new folder where driver and executors share one; a temporary one where they are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{root or tempfile.mkdtemp(prefix='index-')}/store-{uuid.uuid4().hex}"


@query(f"""WITH {_old_new_sql()} SELECT chunk_id, text_hash, text_hash AS embedded_hash, 64 AS dimensions FROM n""")
def index_corpus_run(spark, d):
    """The index after a run over the stored corpus and a run over the present one."""
    root, docs = _scratch(spark), _t(spark, d, "documents")
    for text, buckets in ((F.expr(STORED), 8), (F.col("text"), 64)):  # opened anew; its bucket count stays the first one
        store = index.Store(spark, root, buckets)
        index.index_corpus(store, docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text")))
    chunked, vectors = store.read()
    v = vectors.select("strategy", "chunk_id", F.col("text_hash").alias("embedded_hash"), F.size("embedding").alias("dimensions"))
    return chunked.select("strategy", "chunk_id", "text_hash").join(v, ["strategy", "chunk_id"], "full").drop("strategy")


# --- F: search --------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS score FROM embeddings, q)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10""")
def dense_topk_single(spark, d):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id = 0").first().embedding
    return e.select("vec_id", F.round(1 - vc.cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def dense_topk_batch(spark, d):
    e = _t(spark, d, "embeddings")
    return search.top_k(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, id_col="vec_id", digits=6)


@query(SQL["dense_topk_batch"])
def dense_topk_balls(spark, d):
    """The same from vectors stored in balls, of which a query meets those that may hold a better one."""
    e = _t(spark, d, "embeddings")
    stored = balls.build(e, _scratch(spark), id_col="vec_id")
    hits, _ = stored.search(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, digits=6)
    return hits.withColumnRenamed("id", "vec_id")


DENSE_SQL = f"""{_chunk_sql()}, {_hash64_sql('c', 'chunk_id', 'e')}, {_hash64_sql('benchmark', 'item_id', 'q')},
en AS (SELECT c.chunk_id, sqrt(coalesce(sum(e.value * e.value), 0)::DOUBLE) AS norm FROM c LEFT JOIN e USING (chunk_id) GROUP BY c.chunk_id),
qn AS (SELECT item_id, sqrt(sum(value * value)::DOUBLE) AS norm FROM q GROUP BY item_id),
dots AS (SELECT q.item_id, e.chunk_id, sum(q.value * e.value) AS dot FROM q JOIN e ON q.bucket = e.bucket GROUP BY ALL),
s AS (SELECT qn.item_id, en.chunk_id, CASE WHEN en.norm * qn.norm > 0 THEN round(coalesce(dots.dot, 0) / (en.norm * qn.norm), 6) END AS score
  FROM qn CROSS JOIN en LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.chunk_id = en.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC NULLS LAST, chunk_id)::INT AS rank FROM s)"""


def _hits(spark, d, k: int = 5) -> DataFrame:
    """The k nearest chunks of every benchmark question, by whole-number hash64 vectors."""
    model = embed.embedder("hash64")
    return search.nearest(_chunks(spark, d), _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), model, k, counts=True, digits=6)


@query(f"WITH {DENSE_SQL} SELECT r.item_id AS query_id, rank, r.chunk_id, c.doc_id, score, text FROM r JOIN c ON r.chunk_id = c.chunk_id WHERE rank <= 5")
def dense_with_text(spark, d):
    hits = _hits(spark, d)
    return hits.join(_chunks(spark, d).select("chunk_id", "doc_id", "text"), "chunk_id").select("query_id", "rank", "chunk_id", "doc_id", "score", "text")


@query(f"""WITH {DENSE_SQL} SELECT r.item_id AS query_id, rank, r.chunk_id || '  ' || substr({SQUEEZE.format("text")}, 1, 160) AS line FROM r JOIN c ON r.chunk_id = c.chunk_id WHERE rank <= 5""")
def dense_rendered(spark, d):
    hits = dense_with_text(spark, d)
    return search.render(hits).select("query_id", "rank", F.regexp_replace("line", r"^\d+  -?[\d.]+  ", "").alias("line"))


@query(f"""WITH {_old_new_sql()}, v AS (SELECT chunk_id, CASE WHEN n % 3 = 0 THEN 'm1' ELSE 'm2' END AS model, ((n % 7) + 1)::DOUBLE AS x, ((n % 5) - 2)::DOUBLE AS y FROM o),
s AS (SELECT model, chunk_id, round(x / sqrt(x * x + y * y), 6) AS score FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, chunk_id) AS i FROM s)
SELECT m.model, r.chunk_id, r.score FROM (VALUES ('m1'), ('m2'), ('no such model')) m(model) JOIN r ON m.model = r.model WHERE i <= 5""")
def dense_search_by_model(spark, d):
    """Each model's own vectors are searched; a model that nothing was embedded with has no hits."""
    old, _ = _old_new(spark, d)
    vec = F.array(((F.col("n") % 7) + 1).cast("float"), ((F.col("n") % 5) - 2).cast("float"))
    v = old.select("strategy", "chunk_id", F.when(F.col("n") % 3 == 0, "m1").otherwise("m2").alias("model"), "text_hash", vec.alias("embedding"))
    found = [search.search_vector(old, v, [1.0, 0.0], "fixed512", m, 5, digits=6).select(F.lit(m).alias("model"), "chunk_id", F.round("score", 6).alias("score")) for m in ("m1", "m2", "no such model")]
    return found[0].unionAll(found[1]).unionAll(found[2])


STOP_SQL = "['" + "', '".join(search.STOP_WORDS) + "']"
TERMS_SQL = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: NOT list_contains({STOP_SQL}, t))"


@query(f"WITH {_chunk_sql()} SELECT chunk_id FROM c WHERE list_contains({TERMS_SQL}, 'license') AND list_contains({TERMS_SQL}, 'apache')")
def fulltext_contains(spark, d):
    return search.contains_all(_chunks(spark, d), ["Apache", "license"]).select("chunk_id")


@query(f"WITH {_chunk_sql()} SELECT chunk_id, len(list_distinct({TERMS_SQL}))::INT AS n_terms FROM c")
def fulltext_terms(spark, d):
    return _chunks(spark, d).select("chunk_id", F.size(search.terms(F.col("text"))).alias("n_terms"))


BM25_SQL = f"""p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({TERMS_SQL}) AS term FROM c) GROUP BY ALL),
ln AS (SELECT chunk_id, len({TERMS_SQL}) AS length FROM c), av AS (SELECT count(*) AS n, avg(length) AS mean FROM ln), bt AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark),
fq AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bs AS (SELECT item_id, p.chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
  FROM bt JOIN p ON bt.term = p.term JOIN fq ON fq.term = p.term JOIN ln ON ln.chunk_id = p.chunk_id CROSS JOIN av GROUP BY item_id, p.chunk_id),
br AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)::INT AS rank FROM bs)"""


def _bm25_hits(spark, d, k: int) -> DataFrame:
    """The k chunks of greatest BM25 for every benchmark question, by words that aren't stemmed."""
    c = _chunks(spark, d)
    questions = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return fulltext.bm25(fulltext.bags(c, "plain"), None, questions, k, "plain", digits=6)


@query(f"WITH {_chunk_sql()}, p AS (SELECT DISTINCT chunk_id, unnest({TERMS_SQL}) AS term FROM c) SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, sum(length)::BIGINT AS length FROM "
       f"(SELECT chunk_id, term, count(*) AS tf, any_value(l) AS length FROM (SELECT chunk_id, len({TERMS_SQL}) AS l, unnest({TERMS_SQL}) AS term FROM c) GROUP BY chunk_id, term) GROUP BY term")
def fulltext_postings(spark, d):
    p = fulltext.postings(_chunks(spark, d), "plain")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.sum("length").alias("length"))


@query(f"WITH {_chunk_sql()}, {BM25_SQL} SELECT item_id AS query_id, chunk_id, score, rank FROM br WHERE rank <= 10")
def bm25_topk(spark, d):
    return _bm25_hits(spark, d, 10)


@query(f"""WITH {DENSE_SQL}, {BM25_SQL}, h AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score
  FROM (SELECT * FROM r WHERE rank <= 30) a FULL JOIN (SELECT * FROM br WHERE rank <= 30) b ON a.item_id = b.item_id AND a.chunk_id = b.chunk_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)::INT AS rank FROM h) SELECT item_id AS query_id, chunk_id, score, rank FROM o WHERE rank <= 10""")
def hybrid_rank_fusion(spark, d):
    """Dense and sparse lists of 30 hits a question, fused."""
    return fulltext.fuse([_hits(spark, d, 30), _bm25_hits(spark, d, 30)], 10, digits=9)


@query(f"""WITH {_chunk_sql()}, p AS (SELECT DISTINCT chunk_id, unnest({TERMS_SQL}) AS term FROM c), q AS (SELECT DISTINCT item_id, unnest({TERMS_SQL.replace('text', 'substr(text, 1, 40)')}) AS term FROM benchmark),
w AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id) SELECT q.item_id AS query_id, chunk_id FROM q JOIN p ON q.term = p.term JOIN w ON w.item_id = q.item_id GROUP BY q.item_id, chunk_id, n HAVING count(*) = n""")
def fulltext_with_all(spark, d):
    """Chunks that have all terms of the beginning of a benchmark question."""
    questions = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 40).alias("text"))
    return fulltext.with_all(fulltext.bags(_chunks(spark, d), "plain"), questions, "plain")


# --- G: generation ----------------------------------------------------------------------------------------------


@query(f"""WITH {DENSE_SQL}, h AS (SELECT r.item_id, rank, '<chunk id="' || r.chunk_id || '">' || chr(10) || text || chr(10) || '</chunk>' AS b FROM r JOIN c ON r.chunk_id = c.chunk_id WHERE rank <= 3),
x AS (SELECT item_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY item_id)
SELECT b.item_id AS query_id, '<context>' || chr(10) || context || chr(10) || '</context>' || chr(10) || chr(10) || '<question>' || chr(10) || b.text || chr(10) || '</question>' AS message FROM benchmark b JOIN x ON b.item_id = x.item_id""")
def prompt_context(spark, d):
    hits = _hits(spark, d, 3).join(_chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return prompt.user_message(_t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), hits)


CITING = "substr(text, 1, 30) || ' [' || conv_id || '#c' || turn || '] and [a/b#c' || (turn % 3) || '], [a/b#c' || (turn % 3) || '] [x #c1] [#c1]'"


@query(rf"""WITH x AS (SELECT conv_id, turn, regexp_extract_all({CITING}, '\[([^\[\]\s]+#c\d+)\]', 1) AS c FROM conversations),
u AS (SELECT conv_id, turn, unnest(c) AS id, generate_subscripts(c, 1) AS i FROM x), f AS (SELECT conv_id, turn, id, min(i) AS i FROM u GROUP BY ALL)
SELECT conv_id, turn, string_agg(id, ' ' ORDER BY i) AS cited FROM f GROUP BY conv_id, turn""")
def parse_citations(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.citations(F.expr(CITING)), " ").alias("cited"))


ANSWERED = f"CASE WHEN turn % 4 = 1 THEN '  ' || '{tx.ABSTAIN_PREFIX.replace(chr(39), chr(39) * 2)}' || '.' ELSE text END"


@query(f"SELECT conv_id, turn, starts_with({STRIP.format('t')}, '{tx.ABSTAIN_PREFIX.replace(chr(39), chr(39) * 2)}') AS abstained FROM (SELECT conv_id, turn, {ANSWERED} AS t FROM conversations)")
def abstain_flag(spark, d):
    text = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("  "), F.lit(tx.ABSTAIN_PREFIX), F.lit("."))).otherwise(F.col("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", tx.abstained(text).alias("abstained"))


# --- H: golden set ----------------------------------------------------------------------------------------------

# Entries made from benchmark rows, with every kind of defect.
GOLD = {
    "id": "CASE WHEN item_id % 13 = 5 THEN 'q' || (item_id - 1) ELSE 'q' || item_id END",
    "question": "CASE WHEN item_id % 17 = 3 THEN '  Same   QUESTION? ' WHEN item_id % 17 = 4 THEN 'same question?' WHEN item_id % 19 = 2 THEN '   ' ELSE text END",
    "answer": "CASE WHEN item_id % 23 = 1 THEN '' ELSE substr(text, 1, 40) END",
    "difficulty": "CASE WHEN item_id % 29 = 7 THEN 'hard' WHEN item_id % 4 = 1 THEN 'multi-hop' WHEN item_id % 4 = 2 THEN 'unanswerable' ELSE 'single-hop' END",
    "relevant_chunk_ids": "CASE WHEN item_id % 4 = 2 AND item_id % 10 <> 2 OR item_id % 21 = 8 THEN {none} WHEN item_id % 15 = 0 THEN {array}((item_id * 3) || '#c0', (item_id * 3) || '#c0') "
    "WHEN item_id % 4 = 1 THEN {array}((item_id * 3) || '#c0', (item_id * 2) || '#c1') ELSE {array}((item_id % 7) || '#c0') END",
}


def _gold(spark, d) -> DataFrame:
    fill = {"none": "CAST(array() AS array<string>)", "array": "array"}
    return _t(spark, d, "benchmark").select(*[F.expr(x.format(**fill)).alias(k) for k, x in GOLD.items()])


_GOLD_SQL = "g AS (SELECT " + ", ".join(f"{x.format(none='[]::VARCHAR[]', array='list_value')} AS {k}" for k, x in GOLD.items()) + " FROM benchmark)"
_KEY_SQL = f"lower({SQUEEZE.format('question')})"
_QRELS_SQL = "qr AS (SELECT id, unnest(relevant_chunk_ids) AS chunk_id FROM g)"


@query("""SELECT item_id, CASE WHEN item_id % 7 = 1 THEN 'no JSON' WHEN item_id % 7 = 2 THEN 'no object' WHEN item_id % 7 = 3 THEN 'lacks answer; has no place for more, other'
  WHEN item_id % 7 = 4 THEN 'wrong types: id, relevant_chunk_ids' WHEN item_id % 7 = 5 THEN 'lacks difficulty' END AS problem, CASE WHEN item_id % 7 IN (0, 6) THEN sha256(text) END AS question_hash,
  CASE item_id % 7 WHEN 0 THEN 1 WHEN 6 THEN 0 END AS refs FROM benchmark""")
def golden_jsonl_scan(spark, d):
    """Entries written as JSON lines, with every kind of defect and blank lines between, and read back."""
    from corpusloom.sources.jsonl import numbered_lines, strict
    from corpusloom.sources.records import LISTS, STRINGS

    m, path = F.col("item_id") % 7, f"{_scratch(spark)}.jsonl"
    ident = F.concat(F.lit("q"), F.col("item_id"))
    whole = F.to_json(F.struct(ident.alias("id"), F.col("text").alias("question"), F.lit("a").alias("answer"), F.when(m == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit("1#c0"))).alias("relevant_chunk_ids"), F.lit("single-hop").alias("difficulty")))
    other = F.to_json(F.struct(ident.alias("id"), F.col("text").alias("question"), F.lit(1).alias("other"), F.lit(2).alias("more"), F.array(F.lit("1#c0")).alias("relevant_chunk_ids"), F.lit("x").alias("difficulty")))
    typed = F.to_json(F.struct(F.lit(3).alias("id"), F.col("text").alias("question"), F.lit("a").alias("answer"), F.array(F.lit(1)).alias("relevant_chunk_ids"), F.lit("x").alias("difficulty")))
    short = F.to_json(F.struct(ident.alias("id"), F.col("text").alias("question"), F.lit("a").alias("answer"), F.array(F.lit("1#c0")).alias("relevant_chunk_ids")))
    line = F.when(m == 1, F.concat(F.lit("{"), whole)).when(m == 2, F.lit("[1, 2]")).when(m == 3, other).when(m == 4, typed).when(m == 5, short).otherwise(whole)
    rows = _t(spark, d, "benchmark").repartition(4, "item_id").sortWithinPartitions("item_id")
    rows.select("item_id", F.explode(F.array(line, F.lit("  "))).alias("value")).select(F.concat_ws("\t", F.col("item_id"), "value")).write.text(path)
    lines = numbered_lines(spark, path).select("file", "line", F.split("value", "\t", 2).alias("v"))
    read = strict(lines.select(F.col("v")[0].cast("bigint").alias("item_id"), F.col("v")[1].alias("value")), STRINGS, LISTS)
    return read.select("item_id", "problem", F.sha2("question", 256).alias("question_hash"), F.size("relevant_chunk_ids").alias("refs")).withColumn("refs", F.when(F.col("problem").isNull(), F.col("refs")))


@query(f"WITH {_GOLD_SQL} SELECT id, count(*) AS n FROM g GROUP BY id HAVING count(*) > 1")
def golden_dup_ids(spark, d):
    return golden.duplicate_ids(_gold(spark, d))


@query(f"WITH {_GOLD_SQL} SELECT {_KEY_SQL} AS question_key, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 1")
def golden_dup_questions(spark, d):
    return golden.duplicate_questions(_gold(spark, d))


@query(f"""WITH {_GOLD_SQL}, {_QRELS_SQL}, {_chunk_sql()}, k AS (SELECT *, {_KEY_SQL} AS key FROM g)
SELECT id, 'duplicate id' AS rule FROM g GROUP BY id HAVING count(*) > 1
UNION SELECT id, 'duplicate question' FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)
UNION SELECT id, 'empty question' FROM g WHERE {SQUEEZE.format('question')} = ''
UNION SELECT id, 'empty answer' FROM g WHERE {SQUEEZE.format('answer')} = ''
UNION SELECT id, 'unknown difficulty' FROM g WHERE difficulty NOT IN ('single-hop', 'multi-hop', 'unanswerable')
UNION SELECT id, 'unanswerable with chunks' FROM g WHERE difficulty = 'unanswerable' AND len(relevant_chunk_ids) > 0
UNION SELECT id, 'no chunks' FROM g WHERE difficulty <> 'unanswerable' AND len(relevant_chunk_ids) = 0
UNION SELECT id, 'repeated chunk' FROM g WHERE len(list_distinct(relevant_chunk_ids)) <> len(relevant_chunk_ids)
UNION SELECT id, 'unknown chunk' FROM qr WHERE chunk_id NOT IN (SELECT chunk_id FROM c)""")
def golden_rule_violations(spark, d):
    return golden.violations(_gold(spark, d), _chunks(spark, d))


@query(f"WITH {_GOLD_SQL}, {_QRELS_SQL}, {_chunk_sql()} SELECT DISTINCT id, chunk_id FROM qr WHERE chunk_id NOT IN (SELECT chunk_id FROM c)")
def golden_unknown_ids(spark, d):
    return golden.unknown_ids(_gold(spark, d), _chunks(spark, d))


@query(f"WITH {_GOLD_SQL}, {_QRELS_SQL} SELECT DISTINCT chunk_id FROM qr")
def golden_cited_ids(spark, d):
    return golden.cited(_gold(spark, d))


def _lock(spark, d) -> DataFrame:
    """Frozen before the French texts came, and before those of every fifth document changed."""
    c = chunk.with_hash(chunk.chunks(_t(spark, d, "documents").where("lang <> 'fr'").select("doc_id", "text")))
    return c.select("chunk_id", F.expr("CASE WHEN CAST(doc_id AS INT) % 5 = 0 THEN 'x' || substr(text_hash, 2) ELSE text_hash END").alias("frozen_hash"))


_LOCK_SQL = "lk AS (SELECT chunk_id, CASE WHEN doc_id::INT % 5 = 0 THEN 'x' || substr(sha256(text), 2) ELSE sha256(text) END AS frozen_hash FROM c WHERE doc_id IN (SELECT doc_id::VARCHAR FROM documents WHERE lang <> 'fr'))"
_CITED_SQL = "ci AS (SELECT DISTINCT q.chunk_id, sha256(c.text) AS text_hash FROM qr q JOIN c ON q.chunk_id = c.chunk_id)"


@query(f"""WITH {_GOLD_SQL}, {_QRELS_SQL}, {_chunk_sql()}, {_LOCK_SQL}, {_CITED_SQL}
SELECT ci.chunk_id, CASE WHEN frozen_hash IS NULL THEN 'unfrozen' ELSE 'drifted' END AS state FROM ci LEFT JOIN lk ON ci.chunk_id = lk.chunk_id WHERE frozen_hash IS NULL OR frozen_hash <> text_hash""")
def golden_drift(spark, d):
    return golden.drift(_gold(spark, d), chunk.with_hash(_chunks(spark, d)), _lock(spark, d))


@query(f"""WITH {_GOLD_SQL}, {_QRELS_SQL}, {_chunk_sql()}, {_LOCK_SQL}, {_CITED_SQL}, a AS (SELECT coalesce(lk.chunk_id, ci.chunk_id) AS chunk_id,
  CASE WHEN lk.chunk_id IS NULL THEN 'added' WHEN ci.chunk_id IS NULL THEN 'removed' WHEN frozen_hash <> text_hash THEN 'updated' ELSE 'same' END AS action FROM lk FULL JOIN ci ON lk.chunk_id = ci.chunk_id)
SELECT action, count(*) AS n FROM a GROUP BY action""")
def freeze_diff(spark, d):
    c = chunk.with_hash(_chunks(spark, d))
    return golden.freeze_diff(_lock(spark, d), golden.freeze(_gold(spark, d), c)).groupBy("action").agg(F.count("*").alias("n"))


@query(f"""WITH {_GOLD_SQL}, {_chunk_sql()}, {_LOCK_SQL}, s AS (SELECT id, (generate_subscripts(relevant_chunk_ids, 1) - 1)::INT AS position, unnest(relevant_chunk_ids) AS chunk_id FROM g)
SELECT s.id, position, s.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'missing' WHEN lk.chunk_id IS NULL THEN 'not frozen' WHEN frozen_hash <> sha256(c.text) THEN 'drifted' ELSE 'ok' END AS mark
FROM s LEFT JOIN c ON s.chunk_id = c.chunk_id LEFT JOIN lk ON s.chunk_id = lk.chunk_id""")
def golden_show(spark, d):
    return golden.show(_gold(spark, d), chunk.with_hash(_chunks(spark, d)), _lock(spark, d))


@query(f"""WITH {_GOLD_SQL} SELECT k.difficulty, count(g.id) AS entries, coalesce(sum(len(relevant_chunk_ids)), 0)::BIGINT AS refs
FROM (VALUES ('single-hop'), ('multi-hop'), ('unanswerable')) k(difficulty) LEFT JOIN g ON g.difficulty = k.difficulty GROUP BY k.difficulty""")
def golden_stats(spark, d):
    return golden.stats(_gold(spark, d))


@query(f"WITH {_GOLD_SQL}, {_QRELS_SQL} SELECT split_part(chunk_id, '#', 1) AS doc_id, count(*) AS refs FROM qr GROUP BY 1 ORDER BY refs DESC, doc_id LIMIT 10")
def golden_top_docs(spark, d):
    return golden.top_docs(_gold(spark, d))


# --- I: metrics -------------------------------------------------------------------------------------------------

K = 10
RANKED_SQL = """s AS (SELECT q.vec_id AS query_id, q.label AS ql, e.label AS el, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE vec_id <> query_id),
rel AS (SELECT query_id, count(*) AS n FROM s WHERE el = ql AND vec_id <> query_id AND query_id % 300 <> 0 GROUP BY query_id),
m AS (SELECT query_id, sum(CASE WHEN el = ql THEN 1 ELSE 0 END)::DOUBLE AS hits, coalesce(max(CASE WHEN el = ql THEN 1.0 / rank END), 0) AS rr,
  sum(CASE WHEN el = ql THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM r WHERE rank <= 10 GROUP BY query_id),
ideal AS (SELECT query_id, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)) AS best, n FROM rel),
sc AS (SELECT m.query_id, round(hits / n, 9) AS recall, CASE WHEN n IS NOT NULL THEN round(rr, 9) END AS mrr, round(gain / best, 9) AS ndcg FROM m LEFT JOIN ideal USING (query_id))"""


def _scored(spark, d) -> DataFrame:
    """Every fiftieth vector as a query: the others of its label are relevant, for some queries nothing is."""
    from pyspark.sql import Window

    e = _t(spark, d, "embeddings")
    label = e.select("vec_id", "label")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    near = search.top_k(e, q, K + 1, id_col="vec_id", digits=6).where("vec_id <> query_id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    hits = near.join(label, "vec_id").join(q.select("query_id", F.col("label").alias("wanted")), "query_id").select("query_id", "rank", (F.col("label") == F.col("wanted")).alias("relevant"))
    totals = q.join(label.groupBy("label").count(), "label").select("query_id", F.when(F.col("query_id") % 300 == 0, 0).otherwise(F.col("count") - 1).alias("n_relevant"))
    return metrics.score_ranked(hits, totals, K)


@query(f"WITH {RANKED_SQL} SELECT query_id, recall FROM sc")
def recall_at_k(spark, d):
    return _scored(spark, d).select("query_id", F.round("recall", 9).alias("recall"))


@query(f"WITH {RANKED_SQL} SELECT query_id, mrr FROM sc")
def mrr_at_k(spark, d):
    return _scored(spark, d).select("query_id", F.round("mrr", 9).alias("mrr"))


@query(f"WITH {RANKED_SQL} SELECT query_id, ndcg FROM sc")
def ndcg_at_k(spark, d):
    return _scored(spark, d).select("query_id", F.round("ndcg", 9).alias("ndcg"))


@query(f"WITH {RANKED_SQL} SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(recall) AS scored, count(*) - count(recall) AS skipped FROM sc")
def metrics_aggregate(spark, d):
    return metrics.aggregate(_scored(spark, d)).withColumns({c: F.round(c, 6) for c in ("recall", "mrr", "ndcg")})


@query(f"WITH {RANKED_SQL} SELECT query_id, metric, value, 'eval' AS source FROM (SELECT query_id, 'recall' AS metric, recall AS value FROM sc UNION ALL SELECT query_id, 'mrr', mrr FROM sc UNION ALL SELECT query_id, 'ndcg', ndcg FROM sc) WHERE value IS NOT NULL")
def metrics_unpivot(spark, d):
    return metrics.unpivot(_scored(spark, d), "eval").withColumn("value", F.round("value", 9))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(median(value), 6) AS p50, round(max(CASE WHEN i = round_even(0.95 * (n - 1), 0)::INT THEN value END), 6) AS p95 FROM r GROUP BY event_type""")
def latency_p50_p95(spark, d):
    return metrics.latency(_t(spark, d, "events"), "value", ["event_type"]).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


# Answers made from conversations: some abstain, some are refused, of some nothing is known.
_ANSWERS = {
    "difficulty": "CASE WHEN conv_id % 3 = 0 THEN 'unanswerable' ELSE 'single-hop' END",
    "abstained": "CASE WHEN turn % 5 = 4 THEN NULL ELSE (conv_id + turn) % 3 = 0 END",
    "refused": "turn % 7 = 2",
    "faithfulness": "CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL ELSE (turn % 4) / 4.0 END",
    "input_tokens": "CAST(length(text) AS INT)",
    "output_tokens": "CAST(turn + 1 AS INT)",
}
_ANSWERS_SQL = "an AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _ANSWERS.items()) + " FROM conversations)"


def _answers(spark, d) -> DataFrame:
    return _t(spark, d, "conversations").select(*[F.expr(v).alias(k) for k, v in _ANSWERS.items()])


@query(f"WITH {_ANSWERS_SQL} SELECT round(avg((abstained = (difficulty = 'unanswerable'))::INT), 6) AS abstain_accuracy, count(*) AS n FROM an WHERE NOT refused AND abstained IS NOT NULL")
def abstain_accuracy(spark, d):
    return metrics.abstain_accuracy(_answers(spark, d)).withColumn("abstain_accuracy", F.round("abstain_accuracy", 6))


@query(f"WITH {_ANSWERS_SQL} SELECT round(avg(faithfulness)::DOUBLE, 6) AS faithfulness, count(faithfulness) AS n FROM an")
def faithfulness_mean(spark, d):
    return metrics.faithfulness(_answers(spark, d)).withColumn("faithfulness", F.round(F.col("faithfulness").cast("double"), 6))


@query(f"WITH {_ANSWERS_SQL} SELECT count(*) AS answers, count(*) FILTER (WHERE refused) AS refusals, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM an")
def token_totals(spark, d):
    return metrics.tokens_used(_answers(spark, d))


@query(f"WITH {RANKED_SQL}, a AS (SELECT avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg, count(*) AS n FROM sc) SELECT printf('%.3f', round(recall, 3)) AS recall, printf('%.3f', round(mrr, 3)) AS mrr, printf('%.3f', round(ndcg, 3)) AS ndcg, '—' AS faithfulness, n AS queries FROM a")
def results_row(spark, d):
    a = metrics.aggregate(_scored(spark, d))
    return a.select(*[metrics.shown(F.col(c), 3).alias(c) for c in ("recall", "mrr", "ndcg")], metrics.shown(F.lit(None).cast("double"), 2).alias("faithfulness"), (F.col("scored") + F.col("skipped")).alias("queries"))


_CELLS = ["date", "config", "chunking", "embedding", "retrieval", "k", "queries", "recall", "mrr", "ndcg", "faithfulness", "abstain", "latency", "cost", "revision", "run"]


@query(f"""WITH {RANKED_SQL}, {_ANSWERS_SQL}, a AS (SELECT avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg, count(recall) AS scored, count(*) - count(recall) AS skipped FROM sc),
f AS (SELECT avg(faithfulness)::DOUBLE AS faithful FROM an), b AS (SELECT avg((abstained = (difficulty = 'unanswerable'))::INT) AS abst FROM an WHERE NOT refused AND abstained IS NOT NULL)
SELECT '2024-01-02' AS date, 'base' AS config, 'fixed512' AS chunking, 'hash64' AS embedding, 'dense' AS retrieval, '10' AS k, (scored + skipped) || ' (' || scored || '/' || skipped || ')' AS queries,
printf('%.3f', recall) AS recall, printf('%.3f', mrr) AS mrr, printf('%.3f', ndcg) AS ndcg, printf('%.2f', faithful) AS faithfulness, printf('%.2f', abst) AS abstain, '12/35' AS latency, '—' AS cost, 'abc1234' AS revision, '—' AS run FROM a, f, b""")
def report_cells(spark, d):
    """All sixteen cells of a report row."""
    from corpusloom.config import RunConfig
    from corpusloom.plans.evaluate import report_row

    answers = _answers(spark, d)
    faithful, abstain = metrics.faithfulness(answers).first()[0], metrics.abstain_accuracy(answers).first()[0]
    row = report_row(RunConfig("base", embedding="hash64", top_k=K), metrics.aggregate(_scored(spark, d)), "2024-01-02T03:04:05Z", "abc1234", faithful, abstain, 12.2, 34.9)
    return spark.createDataFrame([tuple(row)], ", ".join(f"{c} string" for c in _CELLS))


@query(f"""WITH {DENSE_SQL}, t AS (SELECT item_id, chunk_id, rank FROM r WHERE rank <= 5), rel AS (SELECT item_id, (item_id * 3)::VARCHAR || '#c0' AS x FROM benchmark)
SELECT rel.item_id::VARCHAR AS query_id, string_agg(t.chunk_id, ' ' ORDER BY rank) AS retrieved, max(CASE WHEN t.chunk_id = x THEN 1 ELSE 0 END)::DOUBLE AS recall, round(max(CASE WHEN t.chunk_id = x THEN 1.0 / rank ELSE 0 END)::DOUBLE, 9) AS mrr
FROM rel JOIN t ON rel.item_id = t.item_id GROUP BY ALL""")
def eval_run(spark, d):
    """The whole run: embed, search, score."""
    from corpusloom.plans.evaluate import retrieved

    entries = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("single-hop").alias("difficulty"), F.array(F.concat((F.col("item_id") * 3).cast("string"), F.lit("#c0"))).alias("relevant_chunk_ids"))
    scored = metrics.score_queries(retrieved(entries, _hits(spark, d).withColumn("query_id", F.col("query_id").cast("string"))), 5)
    return scored.select("query_id", F.array_join("retrieved", " ").alias("retrieved"), "recall", F.round("mrr", 9).alias("mrr"))


# Assistants' turns as answers and the two turns before each as its hits; the judge scores those that have both.
_JUDGED = {"query_id": "concat(conv_id, ':', turn)", "text": "coalesce(text, '')", "abstained": "conv_id % 5 = 0", "refused": "turn % 4 = 3"}


def _shorter(text: str, contexts: list[str]) -> float | None:
    return sum(len(c) < len(text) for c in contexts) / 2 if len(contexts) == 2 else None


@query("WITH an AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _JUDGED.items()) + """ FROM conversations WHERE role = 'assistant'),
h AS (SELECT concat(conv_id, ':', turn + k.rank) AS query_id, length(coalesce(text, '')) AS n FROM conversations, (VALUES (1), (2)) AS k(rank))
SELECT an.query_id, CASE WHEN NOT abstained AND NOT refused AND count(h.n) = 2 THEN count(*) FILTER (WHERE h.n < length(an.text)) / 2 END AS faithfulness
FROM an LEFT JOIN h ON an.query_id = h.query_id GROUP BY an.query_id, an.text, abstained, refused""")
def judge_gating(spark, d):
    """Only answers that neither abstain nor are refused are judged; what the judge doesn't score stays without a score."""
    turns = _t(spark, d, "conversations")
    answers = turns.where("role = 'assistant'").select(*[F.expr(v).alias(k) for k, v in _JUDGED.items()])
    ranked = turns.select("conv_id", "turn", F.expr(_JUDGED["text"]).alias("text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    return prompt.judge(answers, ranked.select(F.expr("concat(conv_id, ':', turn + rank)").alias("query_id"), "rank", "text"), lambda: _shorter)


# --- K: traces --------------------------------------------------------------------------------------------------

# Each turn of a conversation as a question with up to three hits, of which the second is relevant if it can be answered.
_TRACED = {**_ANSWERS, "query_id": "concat(conv_id, ':', turn)", "n_hits": "CAST(turn % 4 AS INT)", "model": "concat('m', conv_id % 3)", "latency_ms": "CAST(length(text) AS DOUBLE)"}
_TRACED_SQL = "q AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _TRACED.items()) + """, sha256('["r1","' || concat(conv_id, ':', turn) || '"]')[1:32] AS trace_id FROM conversations)"""
_SPANS_SQL = f"""{_TRACED_SQL}, sp AS (SELECT 'r1' AS run, trace_id, sha256(trace_id || ':' || name)[1:16] AS span_id, CASE WHEN name <> 'query' THEN sha256(trace_id || ':query')[1:16] END AS parent_id, query_id, name,
  CASE WHEN name = 'generation' THEN model END AS model, CASE WHEN name = 'generation' THEN input_tokens END AS input_tokens, CASE WHEN name = 'generation' THEN output_tokens END AS output_tokens,
  CASE WHEN name = 'generation' THEN latency_ms END AS latency_ms, CASE WHEN name = 'retrieval' THEN n_hits END AS n_hits
  FROM q, (VALUES ('query'), ('retrieval'), ('generation')) AS k(name) WHERE name <> 'generation' OR difficulty <> 'unanswerable')"""


def _traced(spark, d) -> tuple[DataFrame, DataFrame]:
    """(results, answers); questions that can't be answered went to no model."""
    rows = _t(spark, d, "conversations").select(*[F.expr(v).alias(k) for k, v in _TRACED.items()])
    hits = F.slice(F.array(*map(F.lit, ("a#c0", "b#c0", "c#c0"))), F.lit(1), F.col("n_hits"))
    wanted = F.when(F.col("difficulty") == "unanswerable", F.array().cast("array<string>")).otherwise(F.array(F.lit("b#c0")))
    results = metrics.score_queries(rows.select("query_id", hits.alias("retrieved"), wanted.alias("relevant")), 3)
    return results, rows.where("difficulty <> 'unanswerable'")


@query(f"WITH {_SPANS_SQL} SELECT * FROM sp")
def trace_spans(spark, d):
    return traces.spans("r1", *_traced(spark, d)).drop("tags")


@query(f"""WITH {_TRACED_SQL}, s AS (SELECT trace_id, query_id, unnest(['recall', 'mrr', 'ndcg']) AS name, unnest([1.0, 0.5, 1 / log2(3)]) * (n_hits >= 2)::INT AS value, 'heuristic' AS source FROM q WHERE difficulty <> 'unanswerable'
UNION ALL SELECT trace_id, query_id, 'abstained', abstained::INT::DOUBLE, 'heuristic' FROM q WHERE difficulty <> 'unanswerable' AND abstained IS NOT NULL
UNION ALL SELECT trace_id, query_id, 'faithfulness', faithfulness, 'llm_judge' FROM q WHERE difficulty <> 'unanswerable' AND faithfulness IS NOT NULL)
SELECT 'r1' AS run, trace_id, query_id, name, round(value, 9) AS value, source FROM s""")
def trace_scores(spark, d):
    results, answers = _traced(spark, d)
    return traces.scores("r1", results, answers, answers.select("query_id", "faithfulness")).withColumn("value", F.round("value", 9))


@query(f"""WITH {_SPANS_SQL}, r AS (SELECT CASE WHEN model = 'm2' THEN 'half' ELSE 'whole' END AS run, query_id FROM q), p AS (SELECT 'm1' AS model, 3.0 AS i, 15.0 AS o),
t AS (SELECT r.run, sp.name, (sp.input_tokens * p.i + sp.output_tokens * p.o) / 1e6 AS spent FROM sp JOIN r USING (query_id) LEFT JOIN p ON p.model = sp.model),
a AS (SELECT run, count(*) FILTER (WHERE name = 'query') AS queries, sum(spent) AS cost, count(*) FILTER (WHERE name = 'generation' AND spent IS NULL) AS unpriced FROM t GROUP BY run)
SELECT run, queries, CASE WHEN unpriced = 0 THEN round(cost, 6) END AS cost, unpriced, CASE WHEN unpriced = 0 THEN round(cost / queries, 9) END AS per_query FROM a""")
def trace_cost(spark, d):
    """Two runs, of which one also asked a model without a price."""
    results, answers = _traced(spark, d)
    runs = answers.where("model = 'm2'").select("query_id", F.lit("half").alias("of"))
    spanned = traces.spans("r1", results, answers).join(runs, "query_id", "left").withColumn("run", F.coalesce("of", F.lit("whole")))
    prices = spark.range(1).select(F.lit("m1").alias("model"), F.lit(3.0).alias("input_price"), F.lit(15.0).alias("output_price"))
    return traces.cost(spanned, prices).withColumns({"cost": F.round("cost", 6), "per_query": F.round("per_query", 9)})


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10")
def head_limit(spark, d):
    return _t(spark, d, "benchmark").orderBy("item_id").limit(10)
