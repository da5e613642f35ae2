"""Traces of a run as rows: a tree of spans and some scores for each question, and what its tokens cost.

Ids are hashes of the run and the question, so that a run that is traced again has the same ids and replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.metrics import unpivot

#: Who gives a score (fixed values).
HEURISTIC, JUDGE = "heuristic", "llm_judge"


def trace_id(run: str, query: Column) -> Column:
    """32 hexadecimal digits for a question of a run."""
    return F.substring(F.sha2(F.to_json(F.array(F.lit(run), query.cast("string"))), 256), 1, 32)


def span_id(trace: Column, name: str) -> Column:
    return F.substring(F.sha2(F.concat(trace, F.lit(f":{name}")), 256), 1, 16)


def spans(run: str, results: DataFrame, answers: DataFrame | None = None, timings: DataFrame | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    """(run, trace_id, span_id, parent_id, query_id, name, model, input_tokens, output_tokens, latency_ms, n_hits, tags): for each row of
    results (query_id, retrieved) a root, its retrieval, and a generation if answers (query_id, model, input_tokens, output_tokens,
    latency_ms) hold the question. timings (query_id, latency_ms) are of retrievals. A question that is answered or timed twice is an
    error when it is read, so no span id comes twice; results have a row a question."""
    q = results.select(F.col("query_id").cast("string").alias("query_id"), F.size("retrieved").alias("n_hits"))
    for df, name, fields in ((timings, "timed", ["latency_ms"]), (answers, "generated", ["model", "input_tokens", "output_tokens", "latency_ms"])):
        if df is None:
            q = q.withColumn(name, F.lit(None).cast("struct<model: string, input_tokens: bigint, output_tokens: bigint, latency_ms: double>"))
            continue
        of = {"model": F.lit(None).cast("string"), "input_tokens": F.lit(None), "output_tokens": F.lit(None)} | {c: F.col(c) for c in fields}
        kinds = {"model": "string", "input_tokens": "bigint", "output_tokens": "bigint", "latency_ms": "double"}
        one = df.select(F.col("query_id").cast("string").alias("query_id"), F.struct(*[of[c].cast(kinds[c]).alias(c) for c in kinds]).alias(name))
        said = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("twice: "), F.col("query_id"))).cast(one.schema[name].dataType)).otherwise(F.first(name))
        q = q.join(one.groupBy("query_id").agg(said.alias(name)), "query_id", "left")
    trace = trace_id(run, F.col("query_id"))
    nothing = lambda kind: F.lit(None).cast(kind)

    def span(name: str, source: str | None) -> Column:
        value = lambda c, kind: F.col(source)[c] if source else nothing(kind)
        return F.struct(
            span_id(trace, name).alias("span_id"), (span_id(trace, "query") if source else nothing("string")).alias("parent_id"), F.lit(name).alias("name"), value("model", "string").alias("model"),
            value("input_tokens", "bigint").alias("input_tokens"), value("output_tokens", "bigint").alias("output_tokens"), value("latency_ms", "double").alias("latency_ms"),
            (F.col("n_hits") if name == "retrieval" else nothing("int")).alias("n_hits"),
        )

    tree = F.array(span("query", None), span("retrieval", "timed"), F.when(F.col("generated").isNotNull(), span("generation", "generated")))
    each = q.select(F.lit(run).alias("run"), trace.alias("trace_id"), "query_id", F.explode(F.array_compact(tree)).alias("s"))
    return each.select("run", "trace_id", "s.span_id", "s.parent_id", "query_id", *[f"s.{c}" for c in ("name", "model", "input_tokens", "output_tokens", "latency_ms", "n_hits")], F.lit(list(tags)).cast("array<string>").alias("tags"))


def scores(run: str, results: DataFrame, answers: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """(run, trace_id, query_id, name, value, source): recall, mrr and ndcg of results; abstained (0 or 1) of answers; faithfulness of
    judgements. What is null, or NaN, isn't a score."""
    kept = ["query_id", "name", "value", "source"]
    every = unpivot(results.withColumn("query_id", F.col("query_id").cast("string")), HEURISTIC).withColumnRenamed("metric", "name").select(*kept)
    for df, column, source in ((answers, "abstained", HEURISTIC), (judged, "faithfulness", JUDGE)):
        if df is not None:
            every = every.unionByName(df.select(F.col("query_id").cast("string").alias("query_id"), F.lit(column).alias("name"), F.col(column).cast("double").alias("value"), F.lit(source).alias("source")))
    return every.where(F.col("value").isNotNull() & ~F.isnan("value")).select(F.lit(run).alias("run"), trace_id(run, F.col("query_id")).alias("trace_id"), *kept)


def write(path: str, spanned: DataFrame, scored: DataFrame) -> None:
    """Both as tables below path, in a folder a run; a run that is written again replaces its own."""
    for name, rows in (("spans", spanned), ("scores", scored)):
        rows.write.partitionBy("run").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(spans, scores) of all runs."""
    return tuple(spark.read.option("basePath", f"{path}/{n}").parquet(f"{path}/{n}").withColumn("run", F.col("run").cast("string")) for n in ("spans", "scores"))


def cost(spanned: DataFrame, prices: DataFrame) -> DataFrame:
    """(run, queries, cost, unpriced, per_query): prices (model, input_price, output_price) are for a million tokens, a row a model. Generations
    of models without a price are counted as unpriced, and a run that has some has no cost."""
    has_price = F.col("input_price").isNotNull() & F.col("output_price").isNotNull()
    generation = F.col("name") == "generation"
    spent = F.when(generation & has_price, (F.coalesce("input_tokens", F.lit(0)) * F.col("input_price") + F.coalesce("output_tokens", F.lit(0)) * F.col("output_price")) / 1e6)
    sums = spanned.join(prices, "model", "left").groupBy("run").agg(
        F.count_if(F.col("name") == "query").alias("queries"), F.coalesce(F.sum(spent), F.lit(0.0)).alias("cost"), F.count_if(generation & ~has_price).alias("unpriced")
    )
    known = F.when(F.col("unpriced") == 0, F.col("cost"))
    return sums.select("run", "queries", known.alias("cost"), "unpriced", (known / F.nullif("queries", F.lit(0))).alias("per_query"))
