"""What the training-data operators share: tables, the shared folder, checkpoints and size checks."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast, of a few numbers each; larger sides are joined by a shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one if driver and executors are one
    machine (tests); on a cluster an error, since executors wouldn't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(columns: list[str] | tuple[str, ...], name: str) -> str:
    """name with so many underscores before it, at least one, that no column is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    name = "_" + name
    while name.lower() in taken:
        name = "_" + name
    return name


def write_file(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """Writes a file by Hadoop's file system, whichever store it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Hadoop's file system, whichever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read again, and its path. It goes at exit, or by remove()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_quietly, spark, path)
    kinds = {f.name: f.dataType for f in df.schema}
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns]), path


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session is gone and its folder with it
        pass


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, so that a lost executor costs no more than a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of steps whose result has been checkpointed and whose frames are gone: its cleaner
    does that when the driver's collector has found them unused, which may else take until the end of the job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free() -> None:
    """Called in a worker at the end of a task that held much: gives unused memory of Arrow and of the C library back, since
    the worker stays for later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's own
    if trim:
        trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than one beyond that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its row count is checked to be within the bound; else Spark shuffles."""
    return F.broadcast(df) if small(df, rows) else df


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")
