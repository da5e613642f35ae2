"""Corpus files: listing, parsing by suffix, documents; and a cache keyed by the listing."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.html import extract_text
from corpusloom.functions.text import doc_id_from_path, normalize, utf8

#: Suffixes that are read (fixed values).
SUFFIXES = ("txt", "md", "html", "htm", "pdf")
#: The reader that a suffix has; others are text in UTF-8.
READERS = {"html": extract_text, "htm": extract_text}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, rel, length, modificationTime, content of each corpus file below root; hidden parts left out.

    Spark's listing also leaves out names that begin with "_".
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    at = F.instr(F.col("path"), base) + len(base)
    rel = F.regexp_replace(F.col("path").substr(at + 1, F.length("path")), "^/+", "")
    kept = F.lower(rel).rlike(rf"\.({'|'.join(SUFFIXES)})$") & ~rel.rlike(r"(^|/)\.")
    return files.withColumn("rel", rel).where(kept)


def parse(files: DataFrame) -> DataFrame:
    """(doc_id, path, text) of a listing; PDF needs a library that isn't there and raises."""
    suffix = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    raw = utf8(F.col("content"))
    text = F.when(suffix == "pdf", F.raise_error(F.concat(F.lit("no PDF reader for "), F.col("rel"))).cast("string"))
    for s, reader in READERS.items():
        text = text.when(suffix == s, reader(raw))
    return files.select(doc_id_from_path(F.col("rel")).alias("doc_id"), F.col("rel").alias("path"), normalize(text.otherwise(raw)).alias("text"))


def regroup(parts: DataFrame) -> DataFrame:
    """(path, text) of readers that give several pieces a file: (path, pos, text) joined with a blank line."""
    gathered = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    return gathered.select("path", normalize(F.array_join(F.col("p.text"), "\n\n")).alias("text"))


def load_corpus(spark: SparkSession, root: str, cache: str | None = None) -> DataFrame:
    """Documents below root in order of id. Two files with one id are an error. cache: a folder where the parse is
    kept under a key made from the listing (names, sizes, times)."""
    files = listing(spark, root)
    if cache is None:
        return _unique(files)
    # sums of two hashes of each file's entry, in any order: no task holds the listing
    entry = [F.col("rel"), F.col("length"), F.col("modificationTime")]
    total = [F.sum(F.xxhash64(*entry, F.lit(i)).cast("decimal(38,0)")) for i in range(2)]
    key = files.select(*entry).agg(F.count("*"), *total).first()
    path = f"{cache.rstrip('/')}/{hashlib.sha256('|'.join(map(str, key)).encode()).hexdigest()}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")  # written last
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        _unique(files).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _unique(files: DataFrame) -> DataFrame:
    """The parsed files in order of id. That ids are unique is found from the names alone, before a text is read."""
    ids = files.select(doc_id_from_path(F.col("rel")).alias("doc_id"))
    twice = ids.groupBy("doc_id").count().where("count > 1").orderBy("doc_id").first()
    if twice:
        raise ValueError(f"several files for {twice.doc_id}")
    return parse(files).orderBy("doc_id")


def load_doc(docs: DataFrame, doc_id: str) -> str:
    """The text of one document."""
    found = docs.where(F.col("doc_id") == doc_id).select("text").take(2)
    if not found:
        raise FileNotFoundError(doc_id)
    if len(found) > 1:
        raise ValueError(f"several documents are called {doc_id}")
    return found[0].text
