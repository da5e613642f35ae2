"""Ranking metrics, their aggregation, and the other columns of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top(retrieved: Column, k: int) -> Column:
    """The first k distinct ids."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return F.slice(F.array_distinct(retrieved), 1, k)


def _or_null(relevant: Column, value: Column) -> Column:
    return F.when(F.size(relevant) > 0, value)


def recall(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; null without relevant ids."""
    return _or_null(relevant, F.size(F.array_intersect(relevant, top(retrieved, k))) / F.nullif(F.size(F.array_distinct(relevant)), F.lit(0)))


def mrr(retrieved: Column, relevant: Column, k: int) -> Column:
    """1 / rank of the first relevant id among the first k; 0 if there is none."""
    ranks = F.transform(top(retrieved, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / (i + 1)))
    return _or_null(relevant, F.coalesce(F.array_max(ranks), F.lit(0.0)))


def ndcg(retrieved: Column, relevant: Column, k: int) -> Column:
    """Discounted gain of the relevant ids among the first k over the best possible."""
    gain = lambda ids: F.aggregate(ids, F.lit(0.0), lambda s, x: s + x)
    got = gain(F.transform(top(retrieved, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2)).otherwise(0.0)))
    best = gain(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(F.array_distinct(relevant)), F.lit(k)), F.lit(1))), lambda r: 1.0 / F.log2(r + 1)))
    return _or_null(relevant, got / best)


def score_queries(results: DataFrame, k: int) -> DataFrame:
    """results (query_id, retrieved, relevant) with recall, mrr and ndcg."""
    r, q = F.col("retrieved"), F.col("relevant")
    return results.withColumns({"recall": recall(r, q, k), "mrr": mrr(r, q, k), "ndcg": ndcg(r, q, k)})


def aggregate(scored: DataFrame) -> DataFrame:
    """One row of means over queries that have a score, and how many have and haven't one."""
    return scored.agg(F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.count("recall").alias("scored"), F.count_if(F.col("recall").isNull()).alias("skipped"))


def checked_aggregate(scored: DataFrame) -> DataFrame:
    """aggregate(), which raises if no query has a score."""
    out = aggregate(scored)
    return out.withColumn("scored", F.when(F.col("scored") == 0, F.raise_error(F.lit("no query has a score")).cast("bigint")).otherwise(F.col("scored")))


def unpivot(scored: DataFrame, source: str) -> DataFrame:
    """(query_id, metric, value, source) of the scores that aren't null."""
    return scored.select("query_id", F.expr("stack(3, 'recall', recall, 'mrr', mrr, 'ndcg', ndcg) AS (metric, value)")).where("value IS NOT NULL").withColumn("source", F.lit(source))


def score_ranked(hits: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """The same metrics from rows instead of arrays, for relevant sets of any size: hits (query_id, rank, relevant),
    ranks from 1 over distinct ids; totals (query_id, n_relevant). No set is gathered into a row."""
    if k < 1:
        raise ValueError("k must be at least 1")
    on = lambda value: F.when(F.col("relevant"), value)
    got = hits.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.count_if("relevant").alias("found"), F.max(on(1.0 / F.col("rank"))).alias("rr"), F.sum(on(1.0 / F.log2(F.col("rank") + 1))).alias("gain")
    )
    n = F.col("n_relevant")
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1))
    some = lambda value: F.when(n > 0, F.coalesce(value, F.lit(0.0)))
    return totals.join(got, "query_id", "left").select("query_id", some(F.col("found") / F.nullif(n, F.lit(0))).alias("recall"), some(F.col("rr")).alias("mrr"), some(F.col("gain") / best).alias("ndcg"))


#: Rows of a group up to which its bracket is its whole range; half the width of a bracket otherwise; the sketch's accuracy.
BRACKET_ROWS, BRACKET, ACCURACY = 20_000, 5e-4, 10_000


def latency(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """p50, the exact median, and p95, the element at the half-even rounded index 0.95 (n - 1); 0 without rows.

    No group is sorted as a whole: a quantile sketch brackets each rank, then the few distinct values in the
    brackets are ranked, counting what lies below.
    """
    from pyspark.sql import Window

    by = by or []
    key = [F.col(c) for c in by] or [F.lit(0).alias("__one")]
    names = by or ["__one"]
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("v"))
    points = [p for q in (0.5, 0.95) for p in (q - BRACKET, min(1.0, q + BRACKET))]
    stats = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", points, ACCURACY).alias("q"))
    last = F.col("n") - 1
    whole = F.col("n") <= BRACKET_ROWS
    bracket = lambda at: (F.when(whole, F.col("least")).otherwise(F.col("q")[at]), F.when(whole, F.col("most")).otherwise(F.col("q")[at + 1]))
    wanted = ((F.floor(last / 2), 0, "m1"), (F.ceil(last / 2), 0, "m2"), (F.bround(F.lit(0.95) * last, 0), 2, "p95"))
    targets = F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank"), bracket(at)[0].alias("lo"), bracket(at)[1].alias("hi")) for r, at, name in wanted])
    ranges = stats.select(*names, F.inline(targets))
    joined = rows.join(ranges, names).where(F.col("v") <= F.col("hi"))
    below = F.col("v") < F.col("lo")
    # all values below a bracket count as one, so that little is left to shuffle after the map side's sums
    few = joined.groupBy(*names, "name", "rank", F.when(~below, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*names, "name").orderBy(F.col("v").asc_nulls_first()))
    at = few.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    one = lambda name: F.max(F.when(F.col("name") == name, F.col("v")))
    picked = at.groupBy(*by).agg(((one("m1") + one("m2")) / 2).alias("p50"), one("p95").alias("p95"))
    return picked.select(*by, F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"))


def abstain_accuracy(answers: DataFrame) -> DataFrame:
    """Share of answers, refusals left out, that abstain exactly if the question is unanswerable; null without any."""
    right = (F.col("abstained") == (F.col("difficulty") == "unanswerable")).cast("int")
    return answers.where(~F.coalesce("refused", F.lit(False)) & F.col("abstained").isNotNull()).agg(F.avg(right).alias("abstain_accuracy"), F.count("*").alias("n"))


def faithfulness(judged: DataFrame) -> DataFrame:
    return judged.agg(F.avg("faithfulness").alias("faithfulness"), F.count("faithfulness").alias("n"))


def tokens_used(answers: DataFrame) -> DataFrame:
    return answers.agg(F.count("*").alias("answers"), F.count_if("refused").alias("refusals"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def shown(value: Column, decimals: int) -> Column:
    """A number with so many decimals, rounded half to even as Python shows exact ties; a dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.format_string(f"%.{decimals}f", F.bround(value, decimals)))
