"""Measures retrieval without hand-made labels: questions whose passages stand in the corpus should find the chunks that hold them.

    python -m jobs.known_items --documents hdfs:///documents --questions hdfs:///benchmark --out hdfs:///reports [--config jobs/known_items.json]

A chunk is relevant for a question if they share `window` words in a row; that is found by a join on hashes of word windows, of
which only those that questions have travel. Every question is then searched among all chunks, and three tables are written for
the run that the settings name:

    hits/run=R/lang=..  the k nearest chunks of each question, in the folder of their language
    scores/run=R        recall, MRR and nDCG of each question; null where no chunk is relevant
    report/run=R        means by the language of the best hit and over all questions

A run writes only folders of its own name and replaces them, so running it again leaves the same result.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import windows
from corpusloom.operators import chunk, embed, metrics, search
from jobs.common import language, main, settings, write

log = logging.getLogger("jobs.known_items")

DEFAULTS = {"run": "baseline", "chunking": "fixed512", "embedding": "hash64", "top_k": 5, "window": 8}
#: Rows of question windows that may be broadcast, at 24 bytes each; more are joined by a shuffle.
FEW_WINDOWS = 1_000_000


def relevant(questions: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """(query_id, chunk_id) pairs that share a window."""
    asked = questions.select("query_id", F.explode(F.array_distinct(windows(F.col("text"), size))).alias("w")).select("query_id", F.xxhash64("w").alias("h"), "w")
    here = chunks.select("chunk_id", F.explode(F.array_distinct(windows(F.col("text"), size))).alias("w")).select("chunk_id", F.xxhash64("w").alias("h"), "w")
    if asked.limit(FEW_WINDOWS + 1).count() <= FEW_WINDOWS:
        asked = F.broadcast(asked)
    return here.join(asked, ["h", "w"]).select("query_id", "chunk_id").distinct()


def evaluate(spark: SparkSession, documents: str, questions: str, out: str, how: dict | None = None) -> dict[str, int]:
    """Runs the whole evaluation and gives the rows written."""
    out, how = out.rstrip("/"), DEFAULTS | (how or {})
    run, k = f"run={how['run']}", how["top_k"]
    docs = spark.read.parquet(documents).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "text", language().alias("lang"))
    asked = spark.read.parquet(questions).where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").alias("query_id"), "text")
    pieces = chunk.chunks(docs, how["chunking"])
    model = embed.embedder(how["embedding"])
    whole = hasattr(model, "counts")  # whole numbers, where the model has them, make scores that don't hang on the order of a sum
    near = search.nearest(pieces, asked, model, k, counts=whole, digits=6)
    truth = relevant(asked, pieces, how["window"]).persist()  # found once for the hits and for the totals
    try:
        return _written(docs, asked, near, truth, out, run, k, documents, questions)
    finally:
        truth.unpersist()


def _written(docs: DataFrame, asked: DataFrame, near: DataFrame, truth: DataFrame, out: str, run: str, k: int, documents: str, questions: str) -> dict[str, int]:
    """Writes hits, scores and report, and gives the rows of each."""
    spark = docs.sparkSession
    own = F.substring_index("chunk_id", "#", 1)
    hits = near.withColumn("doc_id", own).join(truth.withColumn("relevant", F.lit(True)), ["query_id", "chunk_id"], "left").join(docs.select("doc_id", "lang").distinct(), "doc_id")
    rows = {"hits": write(hits.select("query_id", "rank", "chunk_id", "doc_id", "score", F.coalesce("relevant", F.lit(False)).alias("relevant"), "lang"), f"{out}/hits/{run}", ["lang"])}
    hits = spark.read.parquet(f"{out}/hits/{run}")  # from here on from what was written
    totals = asked.select("query_id").distinct().join(truth.groupBy("query_id").agg(F.count("*").alias("n_relevant")), "query_id", "left").fillna(0, ["n_relevant"])
    best = hits.groupBy("query_id").agg(F.min_by("chunk_id", "rank").alias("best"), F.min_by("lang", "rank").alias("best_lang"))
    rows["scores"] = write(metrics.score_ranked(hits, totals, k).join(totals, "query_id").join(best, "query_id", "left"), f"{out}/scores/{run}")
    scores = spark.read.parquet(f"{out}/scores/{run}")
    means = [F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg")]
    report = scores.groupBy("best_lang").agg(*means, F.count("recall").alias("scored"), F.count_if(F.col("recall").isNull()).alias("skipped"))
    rows["report"] = write(report.unionByName(metrics.aggregate(scores).withColumn("best_lang", F.lit("all"))), f"{out}/report/{run}")
    log.info("read %s and %s; wrote %s to %s, %s", documents, questions, rows, out, run)
    for r in spark.read.parquet(f"{out}/report/{run}").orderBy("best_lang").collect():  # a row a language
        log.info("%s: %s", run, r.asDict())
    return rows


if __name__ == "__main__":
    main(
        lambda spark, args: evaluate(spark, args.documents, args.questions, args.out, settings(spark, args.config, DEFAULTS)),
        "known_items: retrieval scores from passages that stand in the corpus",
        {"documents": "table of documents", "questions": "table of questions", "out": "folder of the reports", "config": "JSON file of settings"},
    )
