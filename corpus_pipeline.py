"""A corpus cleaned and packed: toxicity, quality rules, line dedup, near duplicates, packing.

STAGES are applied in order; each takes what the one before kept. All but the last return the columns of
documents: the first two leave out the rows that they reject, the third rewrites texts (and n_chars with
them) and leaves out documents of which no word is left (each of their lines stays in another one), the fourth keeps one document of each group of near duplicates, the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, ngram_join, packing, quality_rules, toxicity
from corpusloom.llm.common import fresh, staged, table
from corpusloom.llm.queries import tokenizer_path
from corpusloom.ship import ship

#: Documents of at least this score are toxic.
TOXIC = 0.3
#: Lines that so many documents have stay only where they come first.
LINE_DOCS = 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labelled rows at hand, doesn't find toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    own = fresh(docs.columns, "toxicity")
    return toxicity.score(docs, model, keep=tuple(docs.columns), out=own).where(F.col(own) < TOXIC).drop(own)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    prefix = fresh([c.split("_")[0] for c in docs.columns], "quality") + "_"
    judged = quality_rules.judge(docs, model, keep=tuple(docs.columns), prefix=prefix)
    return judged.where(F.col(prefix + "kept")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that LINE_DOCS or more have, which stay only in the first of them; one that so
    loses its last word goes, since all its lines are in others. Documents that had no words before stay."""
    # columns of documents with the names of the operator's own step aside meanwhile
    names = docs.columns
    aside = {c: fresh(names, c) for c in names if c.lower() in ("n_lines", "n_dropped")}
    docs = docs.withColumnsRenamed(aside)
    out = line_dedup.dedup_lines(docs, min_docs=LINE_DOCS, keep_first=True)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(aside.get(c, c)).alias(c) for c in names))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, num=80, den=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 2048 ids."""
    out = packing.pack(docs, tokenizer_path(), capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Rows of whole texts that travel to a Python worker at once, where the session leaves Spark's default of 10,000.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH) == "10000":  # read when the result is, so it can't be set back here
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        return stage(ship(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _shipped(drop_toxic)),
    ("quality rules", _shipped(apply_quality_rules)),
    ("line dedup", _shipped(dedup_lines)),
    ("n-gram Jaccard join", _shipped(drop_near_duplicates)),
    ("packing", _shipped(pack)),
]

#: Trained models and components of near duplicates aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each one's result written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
