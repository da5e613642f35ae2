"""Line dedup: hashes range-partitioned and sorted by document and position, decisions as keep bitmaps.

Lines are reduced to 128-bit hashes of their keys. One range shuffle sorts (hash, document, position), a
stream over each sorted partition decides each run of one hash, and what comes back to the documents is a
zlib-compressed bitmap for each document that loses lines; texts are never moved for counting. A key that
very many documents hold spans several partitions, since the document is part of the range key; only the
first and last run of a partition meet at the driver (two rows a partition).

Defined results: a null or empty text is one empty line, which has no key and stays. Rows that agree in id
and text count as one document and all get the same decision; a null id is a document like others. Keys
shorter than min_chars are never dropped. A very long text is as many small rows as it has lines; only its own task holds
it whole. An empty table gives an empty result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def doc_key(doc_id, text):
    """Identity of a row: its id and two hashes of its text."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole batches with, for each row, whether it begins a run of one hash, another document of a run, and whether
    it is the row before again, as rows that a table repeats are."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.stack([batch.column("h1").to_numpy(zero_copy_only=False), batch.column("h2").to_numpy(zero_copy_only=False)], 1)
        d = batch.column("dh").to_numpy(zero_copy_only=False)
        p = batch.column("pos").to_numpy(zero_copy_only=False)
        new_run, new_doc, again = np.ones(len(d), bool), np.ones(len(d), bool), np.zeros(len(d), bool)
        new_run[1:] = (h[1:] != h[:-1]).any(1)
        new_doc[1:] = new_run[1:] | (d[1:] != d[:-1])
        again[1:] = ~new_doc[1:] & (p[1:] == p[:-1])
        if last is not None:
            new_run[0] = tuple(h[0]) != last[:2]
            new_doc[0] = new_run[0] or d[0] != last[2]
            again[0] = not new_doc[0] and p[0] == last[3]
        last = (*h[-1], d[-1], p[-1])
        yield batch, new_run, new_doc, again


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and documents of a partition's first and last run: what other partitions may share."""
    first = cur = None
    for batch, new_run, new_doc, _ in _runs(batches):
        starts = np.flatnonzero(new_run)
        docs = np.cumsum(new_doc)
        h1, h2 = batch.column("h1"), batch.column("h2")
        bounds = [0, *starts[starts > 0], batch.num_rows]
        # only the run carried on, the first and the last of a batch can matter
        if cur is not None and not new_run[0]:
            cur[2] += int(docs[bounds[1] - 1])
            if len(bounds) == 2:
                continue
        if cur is not None and first is None and (new_run[0] or len(bounds) > 2):
            first = cur
        if first is None and len(bounds) > 2:
            first = [h1[0].as_py(), h2[0].as_py(), int(docs[bounds[1] - 1])]
        at = bounds[-2]
        cur = [h1[at].as_py(), h2[at].as_py(), int(docs[-1] - (docs[at - 1] if at else 0))]
    got = [x for x in (first, cur) if x is not None]
    yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in got], pa.int64()) for i, k in enumerate(("h1", "h2", "n"))})


def _decide(batches: Iterator[pa.RecordBatch], min_docs: int, hot: set[tuple[int, int]], keep_first: bool, begun: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """Streams the sorted rows; yields document and position of each line that goes.

    hot: hashes that reach min_docs over several partitions. begun: the hash of a run that an earlier partition
    begins. Held back at any time: the rows of one run until min_docs documents have been seen, then none of it.
    """
    held: list[pa.RecordBatch] = []
    seen, going = 0, False  # documents of the run so far; whether the run is known to go
    start, stayed = True, False  # of the partition; whether the row before stays

    def out(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_key"), batch.column("pos")], ["doc_key", "pos"])

    for batch, new_run, new_doc, again in _runs(batches):
        h1, h2 = batch.column("h1").to_numpy(zero_copy_only=False), batch.column("h2").to_numpy(zero_copy_only=False)
        lo = np.unique(np.concatenate([[0], np.flatnonzero(new_run)]))
        hi = np.append(lo[1:], batch.num_rows)
        docs = np.concatenate([[0], np.cumsum(new_doc)])
        n = docs[hi] - docs[lo]
        go = n >= min_docs
        if hot:
            go |= np.fromiter(((a, b) in hot for a, b in zip(h1[lo].tolist(), h2[lo].tolist(), strict=True)), bool, len(lo))
        stays = new_run & keep_first  # the first row of a run, unless an earlier partition has it
        if start and begun == (h1[0], h2[0]):
            stays[0] = False
        start = False
        stays[0] |= again[0] and stayed  # and what repeats it
        stays = stays[np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))]
        stayed = bool(stays[-1])
        if not new_run[0]:  # the run goes on from the batch before
            seen += int(n[0])
            go[0] = going = going or go[0] or seen >= min_docs
            if going and held:
                yield from (out(x) for x in held)
                held = []
        if len(lo) > 1 or new_run[0]:  # another run is the last one now
            held = []
            seen, going = int(n[-1]), bool(go[-1])
        mask = np.repeat(go, hi - lo) & ~stays
        if mask.any():
            yield out(batch.filter(pa.array(mask)))
        if not going:
            at = int(lo[-1])
            held.append(batch.slice(at).filter(pa.array(~stays[at:])))


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """(doc_key, pos) of every line that goes: all lines of a key that at least min_docs documents have, or with
    keep_first all but its first occurrence, in order of document and position. min_docs 1 with keep_first leaves
    every key once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    positions = f"doc_key struct<id:{kind},a:bigint,b:bigint>, pos int"
    keyed = docs.select(doc_key(F.col(id_col), text).alias("doc_key"), text.alias("text"))  # a row's key is made before its lines are
    lines = cut(
        keyed.select("doc_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_key", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= max(1, min_chars))
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("b"), "key").alias("h2"), F.xxhash64("doc_key").alias("dh"), "doc_key", "pos")
    )  # written once, since the range shuffle reads its input twice
    order = ["h1", "h2", "doc_key"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(lines.repartitionByRange(n, *order).sortWithinPartitions(*order, "pos"))
    pid = F.spark_partition_id().alias("pid")
    edges = ranged.select("h1", "h2", "dh", "pos").mapInArrow(_edges, "h1 bigint, h2 bigint, n bigint").select(pid, "*").collect()  # two rows a partition
    total: dict[tuple[int, int], int] = {}
    parts: dict[tuple[int, int], set[int]] = {}
    for e in edges:
        total[e.h1, e.h2] = total.get((e.h1, e.h2), 0) + e.n
        parts.setdefault((e.h1, e.h2), set()).add(e.pid)
    hot = {k for k, v in total.items() if v >= min_docs and len(parts[k]) > 1}
    begun = {p: k for k, v in parts.items() for p in v if p != min(v)}  # only a partition's first run can be one

    def decide(batches):
        from pyspark import TaskContext

        return _decide(batches, min_docs, hot, keep_first, begun.get(TaskContext.get().partitionId()))

    return ranged.mapInArrow(decide, positions)


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_key, n_dropped, bitmap) for each document that loses a line: bit i of the zlib-compressed bitmap is 1
    if line i goes; bits beyond the last dropped line are left out."""
    kind = dropped.schema["doc_key"].dataType.simpleString()

    def pack(batches):
        for b in batches:
            maps, counts = [], []
            for pos in b.column("positions"):
                at = np.unique(pos.values.to_numpy(zero_copy_only=False))
                bits = np.zeros(int(at[-1]) + 1, np.uint8)
                bits[at] = 1
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
                counts.append(len(at))
            yield pa.RecordBatch.from_arrays([b.column("doc_key"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], ["doc_key", "n_dropped", "bitmap"])

    return dropped.groupBy("doc_key").agg(F.collect_list("pos").alias("positions")).mapInArrow(pack, f"doc_key {kind}, n_dropped bigint, bitmap binary")


def apply_bitmap(text: str, bitmap: bytes | None) -> str:
    if not isinstance(bitmap, bytes):
        return text
    lines = text.split("\n")
    goes = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    return "\n".join([x for x, g in zip(lines, goes.tolist() + [0] * (len(lines) - len(goes)), strict=True) if not g])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """docs with text_col rewritten, and n_lines and n_dropped added (columns of these names are replaced)."""
    maps = keep_bitmaps(dropped_lines(docs, min_docs, min_chars, id_col, text_col, keep_first))
    # the row is one column, so that no name of its columns meets one of ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    joined = rows.join(maps, F.col("key").eqNullSafe(F.col("doc_key")), "left")
    whole = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    kept = F.pandas_udf(lambda t, b: t.combine(b, apply_bitmap), "string")
    made = {
        text_col: F.when(F.col("bitmap").isNull(), F.col("row").getField(text_col)).otherwise(kept(whole, F.col("bitmap"))),
        "n_lines": F.size(F.split(whole, "\n", -1)).cast("long"),
        "n_dropped": F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long"),
    }
    have = {c.lower() for c in docs.columns}
    by_name = {c.lower(): x for c, x in made.items()}  # whatever the case, as Spark finds columns
    names = [*docs.columns, *(x for x in made if x.lower() not in have)]
    return joined.select(*((by_name[c.lower()] if c.lower() in by_name else F.col("row").getField(c)).alias(c) for c in names))
