"""Keeps chunks and vectors of a growing folder of documents up to date, embedding no text twice.

    python -m jobs.refresh_index --source hdfs:///in/documents --out hdfs:///index [--config jobs/refresh_index.json]

A file stream with a checkpoint takes only files that it hasn't seen. Each of its batches writes three tables under out, in folders of its own number:

    documents/batch=N/lang=..  the newest version of every document of the batch
    chunks/batch=N/lang=..     its chunks with their content hashes
    vectors/batch=N            vectors of content hashes that no earlier batch has embedded

A batch that is run again after a failure replaces its own folders with the same rows, so nothing is doubled or lost; checkpoint and tables are one
thing and are kept or deleted together. current() is the present state: of each document the chunks of its last batch. A
document that comes again replaces its older version, with a null or empty text it has no chunks any more. Rows without an id can't be addressed
and are left out; the log says how many.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunk, embed
from jobs.common import NO_LANGUAGE, language, main, settings, write

log = logging.getLogger("jobs.refresh_index")

DEFAULTS = {"chunking": "fixed512", "embedding": "hash64", "format": "parquet", "schema": "doc_id bigint, text string, lang string", "files_per_batch": 1000}
DOCUMENTS = "doc_id string, text string, lang string, batch bigint"
CHUNKS = "chunk_id string, doc_id string, n int, start int, end int, text string, text_hash string, lang string, batch bigint"
VECTORS = "text_hash string, embedding array<float>, batch bigint"


def _table(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/{name}")


def _pattern(source: str) -> str:
    """source as a pattern that fits nothing else: a file stream takes a single file by a pattern only."""
    parent, _, name = source.rstrip("/").rpartition("/")
    return source if any(c in source for c in "*?[{") or not parent else f"{parent}/{{{name}}}"


def newest(batch: DataFrame) -> DataFrame:
    """One version a document: that of the newest file, of equally new ones the greatest text, so that a batch run again
    gives the same. The maximum is taken before rows are moved."""
    last = F.max_by(F.struct("text", "lang"), F.struct("written", "text", "lang"))
    return batch.groupBy("doc_id").agg(last.alias("v")).select("doc_id", "v.text", "v.lang")


def take(spark: SparkSession, batch: DataFrame, number: int, out: str, how: dict) -> dict[str, int]:
    """Writes one batch's folders and gives the rows of each. Each table is made from the one before as it was written."""
    model = embed.embedder(how["embedding"])
    here = f"batch={number}"
    rows = {"documents": write(newest(batch.where("doc_id IS NOT NULL")), f"{out}/documents/{here}", ["lang"])}
    docs = _table(spark, out, "documents", DOCUMENTS).where(F.col("batch") == number)
    made = chunk.with_hash(chunk.chunks(docs, how["chunking"], keep=("lang",)))
    rows["chunks"] = write(made, f"{out}/chunks/{here}", ["lang"])
    texts = _table(spark, out, "chunks", CHUNKS).where(F.col("batch") == number).select(F.col("text_hash").alias("key"), "text").dropDuplicates(["key"])
    known = _table(spark, out, "vectors", VECTORS).where(F.col("batch") < number).select(F.col("text_hash").alias("key"))  # keys alone are read
    fresh = embed.embed(texts.join(known, "key", "left_anti"), model, "key")
    rows["vectors"] = write(fresh.withColumnRenamed("key", "text_hash"), f"{out}/vectors/{here}")
    return rows


def refresh(spark: SparkSession, source: str, out: str, how: dict | None = None) -> dict[str, int]:
    """Takes all that is new in source and ends; gives the rows written."""
    out, how = out.rstrip("/"), DEFAULTS | (how or {})
    for name, schema, folder in (("documents", DOCUMENTS, f"batch=-1/lang={NO_LANGUAGE}"), ("chunks", CHUNKS, f"batch=-1/lang={NO_LANGUAGE}"), ("vectors", VECTORS, "batch=-1")):
        # an empty file each, so that there is a table before the first batch
        spark.createDataFrame([], schema).drop("batch", "lang").write.mode("ignore").parquet(f"{out}/{name}/{folder}")
    total: dict[str, int] = {"batches": 0, "documents": 0, "chunks": 0, "vectors": 0}

    def apply(batch: DataFrame, number: int) -> None:
        read, without_id = batch.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
        rows = take(batch.sparkSession, batch, number, out, how)
        log.info("batch %d: read %d rows of %s, %d of them without id; wrote %s to %s", number, read, source, without_id, rows, out)
        total["batches"] += 1
        for name, n in rows.items():
            total[name] += n

    found = spark.readStream.format(how["format"]).schema(how["schema"]).option("maxFilesPerTrigger", how["files_per_batch"]).load(_pattern(source))
    rows = found.select(F.col("doc_id").cast("string").alias("doc_id"), "text", language().alias("lang"), F.col("_metadata.file_modification_time").alias("written"))
    query = rows.writeStream.foreachBatch(apply).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("done: %s", total)
    return total


def current(spark: SparkSession, out: str) -> DataFrame:
    """(lang, doc_id, chunk_id, n, start, end, text, text_hash, embedding, batch): the chunks of the last batch of each document, with their vectors."""
    out = out.rstrip("/")
    last = _table(spark, out, "documents", DOCUMENTS).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    chunks = _table(spark, out, "chunks", CHUNKS).join(last, ["doc_id", "batch"])
    return chunks.join(_table(spark, out, "vectors", VECTORS).drop("batch"), "text_hash").select("lang", "doc_id", "chunk_id", "n", "start", "end", "text", "text_hash", "embedding", "batch")


if __name__ == "__main__":
    main(
        lambda spark, args: refresh(spark, args.source, args.out, settings(spark, args.config, DEFAULTS)),
        "refresh_index: brings chunks and vectors up to date with a folder of documents",
        {"source": "folder that document files arrive in, or a file", "out": "folder of the tables and the checkpoint", "config": "JSON file of settings"},
    )
