"""Prompts, answers and judges: rendering in SQL, models behind injected clients."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import MappingProxyType

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import ABSTAIN_PREFIX, abstained, citations


@dataclass(frozen=True)
class Prompt:
    version: str
    system: str


#: Prompts by version; a published version never changes.
PROMPTS = MappingProxyType({
    "v1": Prompt("v1", f"Use only the documents given. Cite the chunks that you use as [chunk id]. If they don't hold the answer, begin with: {ABSTAIN_PREFIX}"),
})


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): a block for each hit, best first, blank lines between."""
    block = lambda h: F.concat(F.lit("<chunk id=\""), h["chunk_id"], F.lit("\">\n"), h["text"], F.lit("\n</chunk>"))
    gathered = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("hits"))
    return gathered.select("query_id", F.array_join(F.transform("hits", block), "\n\n").alias("context"))


def user_message(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, message): the context, empty without hits, then the question."""
    joined = questions.select("query_id", F.col("text").alias("question")).join(context(hits), "query_id", "left")
    return joined.select("query_id", F.concat(F.lit("<context>\n"), F.coalesce("context", F.lit("")), F.lit("\n</context>\n\n<question>\n"), F.col("question"), F.lit("\n</question>")).alias("message"))


ANSWER = "query_id string, text string, refused boolean, model string, prompt_version string, input_tokens int, output_tokens int, latency_ms double"


def answer(messages: DataFrame, make_client: Callable[[], Callable[[str, str], dict]], model: str, prompt: str = "v1") -> DataFrame:
    """Answers to messages (query_id, message). make_client() runs on the worker and returns a function of system
    and user text to a dict of text, refused, input_tokens and output_tokens."""
    chosen = PROMPTS[prompt]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for f in frames:
            rows = []
            for q, m in zip(f["query_id"], f["message"], strict=True):
                began = time.perf_counter()
                got = client(chosen.system, m)
                rows.append((q, got["text"], bool(got.get("refused")), model, chosen.version, got.get("input_tokens", 0), got.get("output_tokens", 0), (time.perf_counter() - began) * 1000))
            yield pd.DataFrame(rows, columns=["query_id", "text", "refused", "model", "prompt_version", "input_tokens", "output_tokens", "latency_ms"])

    out = messages.select(F.col("query_id").cast("string").alias("query_id"), "message").mapInPandas(run, ANSWER)
    return out.withColumns({"cited_chunk_ids": citations(F.col("text")), "abstained": abstained(F.col("text"))})


def judge(answers: DataFrame, hits: DataFrame, make_judge: Callable[[], Callable[[str, list[str]], float | None]]) -> DataFrame:
    """(query_id, faithfulness): null unless the answer neither abstains nor is refused and has hits; NaN is null."""
    texts = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("h")).select(F.col("query_id").cast("string").alias("query_id"), F.col("h.text").alias("contexts"))
    ready = answers.where(~F.col("abstained") & ~F.col("refused")).join(texts, "query_id").select("query_id", "text", "contexts")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_judge()
        for f in frames:
            got = [score(t, list(c)) for t, c in zip(f["text"], f["contexts"], strict=True)]
            yield pd.DataFrame({"query_id": f["query_id"], "faithfulness": pd.Series([float("nan") if x is None else x for x in got], dtype=float)})

    scored = ready.mapInPandas(run, "query_id string, faithfulness double")
    return answers.select("query_id").join(scored, "query_id", "left").withColumn("faithfulness", F.when(~F.isnan("faithfulness"), F.col("faithfulness")))


def judge_arguments(model: str, repeatable: tuple[str, ...] = ()) -> dict:
    """Sampling arguments for a judge: temperature 0 for model families (name prefixes) whose interface takes it."""
    return {"temperature": 0.0} if model.startswith(repeatable) and repeatable else {}
