"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of each window, rightmost on ties.

Any match of at least window + k - 1 code points between two texts leaves a common hash in both fingerprints, at
positions that tell where. Hashes of k code points are built by doubling (a hash of 2n is one of n shifted plus
another), minima of windows likewise, so that a text costs about ten passes of vector arithmetic.

Each document is also compared with its successor and with its edited text, whose last quarter comes from the
successor. The successor is found without a global sort in one task: the ids alone are range-partitioned, which gives cuts
of any type that has an order; each range is one partition, sorted and streamed, and the first row of each range (one a range) is sent
to the range before it as well.

Defined results: a null text is an empty one. An empty text has no hashes; two empty fingerprints are alike
(1.0), one empty one and another are not (0.0). A text shorter than k has the hash of the whole as its only
one. Null ids come first, equal ids are ordered by a hash of the text; repeated rows follow each other. The only
document of a table is its own successor. Of a very long text all code points count; memory holds two texts and their
hashes. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, WINDOW = 12, 20
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """The 32-bit hash of each k code points in a row."""
    h: dict[int, np.ndarray] = {1: (codes.astype(np.uint64) + np.uint64(1)) * MIX}
    power = {1: BASE}
    n = 1
    while n * 2 <= k:
        power[2 * n] = power[n] * power[n]
        h[2 * n] = h[n][:-n] * power[n] + h[n][n:]
        n *= 2
    out, at = h[n], n
    for size in sorted(h, reverse=True):
        while at + size <= k:
            m = len(codes) - at - size + 1
            out = out[:m] * power[size] + h[size][at : at + m]
            at += size
    out = out ^ (out >> np.uint64(29))
    return (out * MIX) >> np.uint64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The positions and hashes (uint32) that the windows select, in order of position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    with np.errstate(over="ignore"):
        hashes = _gram_hashes(codes, min(k, len(codes)))
    n = len(hashes)
    # the rightmost of equal hashes is the least: the position counts down in the low bits
    best = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    window = min(window, n)
    size = 1
    while size * 2 <= window:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < window:
        best = np.minimum(best[: n - window + 1], best[window - size : window - size + n - window + 1])
    best = best[np.concatenate([[True], best[1:] != best[:-1]])]
    return (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.uint32), (best >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hashes, given distinct and sorted."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def digest(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, positions and hashes (array<bigint>) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [winnow(t.as_py(), k, window) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i].astype(np.int64) for x in got], pa.list_(pa.int64())) for i in (0, 1))], [id_col, "positions", "hashes"])

    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, positions array<bigint>, hashes array<bigint>")


def _place(x: Column, cuts: list, lo: int = 0) -> Column:
    """How many of the sorted cuts are at most x, by bisection; lo is added."""
    if not cuts:
        return F.lit(lo)
    half = len(cuts) // 2
    return F.when(x < cuts[half], _place(x, cuts[:half], lo)).otherwise(_place(x, cuts[half + 1 :], lo + half + 1))


def by_range(rows: DataFrame, ranges: int) -> DataFrame:
    """rows (id, text, tie), dealt to as many partitions as ranges of ids, sorted in each; the last row of a range
    (extra 1) is the first of the next one, of the last range the first of all."""
    key = F.struct("id", "tie")  # in a struct a null comes before all else, so that rows without an id are dealt too
    part = F.spark_partition_id().alias("part")
    ranged = rows.select("id", "tie").repartitionByRange(ranges, F.col("id").asc_nulls_first(), "tie")
    firsts = [r.least for r in ranged.groupBy(part).agg(F.min(key).alias("least")).orderBy("least").collect()]  # one row a range
    if not firsts:
        return rows.select("id", "text", "tie", F.lit(0).alias("range"), F.lit(0).alias("extra"))
    kind = rows.schema["id"].dataType
    as_key = lambda r: F.struct(F.lit(r.id).cast(kind).alias("id"), F.lit(r.tie).alias("tie"))
    starts = [as_key(r) for r in firsts]
    own = _place(key, starts[1:])
    at = lambda r, e: F.struct(r.alias("r"), F.lit(e).alias("e"))
    before = F.when(F.col("own") == 0, F.lit(len(firsts) - 1)).otherwise(F.col("own") - 1)
    leads = F.element_at(F.array(*starts), F.col("own") + 1).eqNullSafe(key)
    places = F.when(leads, F.array(at(F.col("own"), 0), at(before, 1))).otherwise(F.array(at(F.col("own"), 0)))
    placed = rows.withColumn("own", own.cast("int")).withColumn("place", F.explode(places)).select("id", "text", "tie", F.col("place.r").alias("range"), F.col("place.e").alias("extra"))
    return placed.repartitionById(len(firsts), F.col("range")).sortWithinPartitions("extra", F.col("id").asc_nulls_first(), "tie")


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and positions (of the
    fingerprint's hashes) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
    schema = f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"
    text = F.coalesce(F.col(text_col), F.lit(""))
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = by_range(docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie")), ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor
        for b in batches:
            out: list[tuple] = []
            for doc, t, extra in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if extra and held is None:
                    continue  # a further row with the id of the next range's first
                t = t.as_py()
                at, h = winnow(t, k, window)
                distinct = np.unique(h)
                if held is not None:
                    d0, t0, p0, h0, s0 = held
                    n = len(t0) // 4
                    edited = t0[: len(t0) - n] + t[:n]
                    _, e = winnow(edited, k, window)
                    out.append((d0, len(t0), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(h0), digest(e), likeness(s0, np.unique(e)), likeness(s0, distinct), p0.astype(np.int32)))
                held = None if extra else (doc, t, at, h, distinct)
            c = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(c, kinds, strict=True)], names)

    return rows.select("id", "text", "extra").mapInArrow(run, schema)
