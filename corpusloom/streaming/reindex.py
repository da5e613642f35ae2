"""Re-indexing as files arrive: a file stream whose micro-batches bring the store up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.index import Store, index_corpus

DOCUMENTS = "doc_id string, text string"
#: When the file that a row came in was written.
WRITTEN = "file_written"


def stream_documents(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    found = spark.readStream.format(fmt).schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return found.select("doc_id", "text", F.col("_metadata.file_modification_time").alias(WRITTEN))


def latest(batch: DataFrame) -> DataFrame:
    """One version of each document: that of the newest file, of equally new ones the greatest text, so that a batch run
    again gives the same. No group is gathered: the maximum is pre-aggregated."""
    newest = F.max_by("text", F.struct(*([WRITTEN] if WRITTEN in batch.columns else []), "text"))
    return batch.groupBy("doc_id").agg(newest.alias("text"))


def start(stream: DataFrame, store: Store, checkpoint: str, strategy: str = "fixed512", model=None, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch replaces the documents that it holds: stored documents with other ids stay. A batch that is
    run again after a failure finds nothing changed, so the store ends up the same."""
    def apply(batch: DataFrame, _: int) -> None:
        index_corpus(store, latest(batch), strategy, model, partial=True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
