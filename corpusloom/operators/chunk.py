"""Chunking: fixed windows with overlap, positional ids, content hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import first_match, squeeze


@dataclass(frozen=True)
class FixedSize:
    """Windows of `size` code points, each `overlap` into the one before; the first to reach the end is the last."""

    size: int
    overlap: int = 0

    def __post_init__(self):
        if not 0 <= self.overlap < self.size:
            raise ValueError(f"overlap must be at least 0 and less than size, not {self.overlap} of {self.size}")

    @property
    def stride(self) -> int:
        return self.size - self.overlap

    def count(self, length: Column) -> Column:
        """Number of windows of a text of this length; 0 if it is empty."""
        return F.when(length > 0, F.greatest(F.ceil((length - self.overlap) / self.stride), F.lit(1))).otherwise(0).cast("int")


#: Registered strategies by name.
STRATEGIES: dict[str, FixedSize] = {"fixed512": FixedSize(512, 64)}


def strategy(name: str) -> FixedSize:
    if name not in STRATEGIES:
        raise ValueError(f"unknown chunking {name!r}; known: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]


def chunks(docs: DataFrame, how: FixedSize | str = "fixed512", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, chunk_id, n, start, end, text of every window of docs (doc_id, text), and the columns to keep of their
    documents. No shuffle: a generator."""
    how = strategy(how) if isinstance(how, str) else how
    length = F.length("text")
    spans = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *keep, length.alias("__len"), how.count(length).alias("__count")).where("__count > 0")
    spans = spans.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
    start = F.col("n") * how.stride
    return spans.select(
        "doc_id", F.concat("doc_id", F.lit("#c"), F.col("n").cast("string")).alias("chunk_id"), "n",
        start.alias("start"), F.least(start + how.size, F.col("__len")).alias("end"), F.substring("text", start + 1, F.lit(how.size)).alias("text"), *keep,
    )


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("text_hash", F.sha2("text", 256))


def list_docs(docs: DataFrame, how: FixedSize | str = "fixed512") -> DataFrame:
    """doc_id, characters and number of chunks of every document, empty ones too."""
    how = strategy(how) if isinstance(how, str) else how
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.length("text").alias("chars"), how.count(F.length("text")).alias("n_chunks"))


def show(chunked: DataFrame) -> DataFrame:
    """chunk_id and a header line with span and hash prefix."""
    head = F.concat(F.col("chunk_id"), F.lit(" ["), F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"), F.lit(") "), F.substring(F.sha2("text", 256), 1, 12))
    return chunked.select("chunk_id", head.alias("header"), squeeze(F.col("text")).alias("body"))


def grep(chunked: DataFrame, pattern: str, context: int = 60) -> DataFrame:
    """chunk_id and snippet of the first match, for chunks where the pattern is found, whatever the case."""
    return chunked.where(F.rlike("text", F.lit(f"(?iu){pattern}"))).select("chunk_id", first_match(F.col("text"), pattern, context).alias("snippet"))
