"""The evaluation run: questions to vectors to hits to scores, all questions in one job."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import RunConfig
from corpusloom.operators import metrics, prompt, traces
from corpusloom.operators.search import DenseRetriever

#: Columns of a report (fixed values).
HEADER = ["date (UTC)", "config", "chunking", "embedding", "retrieval", "k", "queries (scored/skipped)", "recall@k", "MRR", "nDCG@k", "faithfulness", "abstain acc", "retrieval p50/p95 ms", "$/query", "commit", "run"]


def retrieved(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Entries with the retrieved ids and scores in rank order; empty arrays without hits."""
    ranked = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("h"))
    joined = entries.select(F.col("id").alias("query_id"), "difficulty", F.col("relevant_chunk_ids").alias("relevant")).join(ranked, "query_id", "left")
    return joined.select("query_id", "difficulty", "relevant", F.coalesce(F.col("h.chunk_id"), F.array().cast("array<string>")).alias("retrieved"), F.transform(F.coalesce(F.col("h.score"), F.array().cast("array<double>")), lambda x: F.round(x, 6)).alias("scores"))


def evaluate(config: RunConfig, entries: DataFrame, retriever: DenseRetriever, limit: int = 0) -> DataFrame:
    """A row a question: retrieved, scores, recall, mrr, ndcg. limit: the first entries in file order; 0 means all."""
    if limit and "line" in entries.columns:
        entries = entries.orderBy("line").limit(limit)
    hits = retriever.search(entries.select(F.col("id").alias("query_id"), F.col("question").alias("text")), config.top_k)
    return metrics.score_queries(retrieved(entries, hits), config.top_k)


@dataclass
class Answered:
    results: DataFrame
    answers: DataFrame | None = None
    judged: DataFrame | None = None


def run(config: RunConfig, entries: DataFrame, retriever: DenseRetriever, make_client=None, make_judge=None, limit: int = 0) -> Answered:
    """evaluate(), then answers if there is a generator, then judgements if there is a judge as well."""
    if make_judge and not make_client:
        raise ValueError("a judge needs a generator")
    results = evaluate(config, entries, retriever, limit)
    if not make_client:
        return Answered(results)
    questions = entries.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    hits = retriever.search(questions, config.top_k)
    answers = prompt.answer(prompt.user_message(questions, hits), make_client, config.generation, config.prompt)
    judged = prompt.judge(answers, hits, make_judge) if make_judge else None
    return Answered(results, answers.join(entries.select(F.col("id").alias("query_id"), "difficulty"), "query_id"), judged)


def measured(entries: DataFrame, retriever: DenseRetriever, k: int) -> list[tuple[str, float]]:
    """Wall-clock milliseconds of embedding and searching each question on its own, as a service would see it."""
    out = []
    for r in entries.select("id", "question").toLocalIterator():
        began = time.perf_counter()
        q = entries.sparkSession.createDataFrame([(r.id, r.question)], "query_id string, text string")
        retriever.search(q, k).collect()
        out.append((r.id, round((time.perf_counter() - began) * 1000, 2)))
    return out


def traced(run: str, config: RunConfig, got: Answered, timings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, scores) of a run; see operators.traces."""
    tags = (config.chunking, config.embedding, config.retrieval)
    return traces.spans(run, got.results, got.answers, timings, tags), traces.scores(run, got.results, got.answers, got.judged)


def report_row(config: RunConfig, means: DataFrame, stamp: str, commit: str | None, faithful: float | None = None, abstain: float | None = None, p50: float = 0.0, p95: float = 0.0, run_file: str | None = None, cost: float | None = None) -> list[str]:
    """The cells of one report row; a dash for what wasn't measured."""
    m = means.first()
    show = lambda x, d: "—" if x is None else f"{x:.{d}f}"
    return [
        stamp[:10], config.name, config.chunking, config.embedding, config.retrieval, str(config.top_k), f"{m.scored + m.skipped} ({m.scored}/{m.skipped})", show(m.recall, 3), show(m.mrr, 3), show(m.ndcg, 3),
        show(faithful, 2), show(abstain, 2), f"{show(p50, 0)}/{show(p95, 0)}", show(cost, 4), commit or "—", run_file or "—",
    ]


def observed(scored: DataFrame, name: str):
    """(scored, observation): the run's means as they pass, without another job; an Observation's get after an action."""
    from pyspark.sql import Observation

    o = Observation(name)
    return scored.observe(o, F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg")), o
