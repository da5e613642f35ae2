"""URL filters: rules kept as a sorted array of 64-bit xxhash keys, probed by vectorised binary search.

Every (host suffix, path prefix) that a rule could be is hashed and looked up in the array; a hit counts only if the
stored string is the same, so collisions change nothing. The array is one file, written once to the shared folder
and sent to each executor, whose workers map it read-only: they share its pages, and a list of any length is bounded by the
executors' disks, not by memory. A list given as a DataFrame is sorted by Spark and streamed into the file.

Defined results: a null url, or one without "://", has empty host and path and gets the default verdict; so
does a url that no rule fits. Of several rules that fit, the longest wins; of equal length, the one with the
longer host. A rule listed as both allow and block blocks. Without rules, every url gets the default. Very long urls have as
many candidates as rules have lengths. Repeated rows are judged each; an empty table gives an empty result. Other columns are
ignored, and columns of the result's names are replaced.
"""

from __future__ import annotations

import atexit
import mmap
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, remove, shared_dir, write_file

#: The seed of Spark's own xxhash64.
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)


def key_of(rule: bytes) -> int:
    return xxhash.xxh64_intdigest(rule, SEED)


class SortedDigests:
    """A view of a block of bytes: n, number of lengths | lengths | keys | offsets | verdicts | strings."""

    def __init__(self, block):
        self.block = block
        self.n, m = (int(x) for x in np.frombuffer(block, np.uint64, 2))
        self.lengths = tuple(np.frombuffer(block, np.uint64, m, 16).tolist())
        at = 16 + 8 * m
        self.keys = np.frombuffer(block, np.uint64, self.n, at)
        self.offsets = np.frombuffer(block, np.uint64, self.n + 1, at + 8 * self.n)
        self.flags = at + 16 * self.n + 8
        self.base = self.flags + self.n

    @staticmethod
    def build(rules: Iterable[tuple[str, str]]) -> bytes:
        """The block of rules ("block" or "allow", host + path that begins with "/")."""
        best: dict[str, str] = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            rule = f"{host.translate(_LOWERED)}/{path}"  # A-Z alone, as in urls
            best[rule] = "block" if "block" in (verdict, best.get(rule)) else verdict
        raw = sorted((key_of(r.encode()), r.encode(), v == "block") for r, v in best.items())
        lengths = sorted({len(r.partition("/")[2]) for r in best})
        offsets = np.cumsum([0, *(len(r) for _, r, _ in raw)]).astype(np.uint64)
        head = np.array([len(raw), len(lengths), *lengths, *(k for k, _, _ in raw)], np.uint64)
        return head.tobytes() + offsets.tobytes() + bytes(b for _, _, b in raw) + b"".join(r for _, r, _ in raw)

    @staticmethod
    def stream(rules: DataFrame) -> Iterator[bytes]:
        """The same of a table (verdict, rule), part by part: the driver holds a partition of the sorted rules at a time."""
        rule = F.concat(F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER), F.expr("substring(rule, instr(rule, '/'))"))
        once = rules.where(F.col("rule").contains("/")).select(rule.alias("rule"), F.col("verdict")).groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("b"))
        key = F.xxhash64("rule")
        order = F.when(key >= 0, 0).otherwise(1)  # as unsigned numbers
        ranked = cut(once.select(F.col("rule").cast("binary").alias("rule"), "b", key.alias("key")).orderBy(order, key, "rule"))
        lengths = sorted(r.n for r in once.select((F.length("rule") - F.instr("rule", "/")).alias("n")).distinct().collect())  # as many as paths have lengths
        yield np.array([ranked.count(), len(lengths), *lengths], np.uint64).tobytes()
        yield from _pieces(np.int64(r.key).tobytes() for r in ranked.select("key").toLocalIterator())
        yield np.uint64(0).tobytes()
        at = 0
        ends = ((at := at + r.n) for r in ranked.select(F.octet_length("rule").alias("n")).toLocalIterator())
        yield from _pieces(np.uint64(x).tobytes() for x in ends)
        yield from _pieces(bytes([r.b]) for r in ranked.select("b").toLocalIterator())
        yield from _pieces(bytes(r.rule) for r in ranked.select("rule").toLocalIterator())

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """The index of each candidate among the rules, or -1."""
        found = np.full(len(candidates), -1, np.int64)
        if not self.n or not candidates:
            return found
        h = np.fromiter(map(key_of, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, h, "left")
        for i in np.flatnonzero(self.keys[np.minimum(at, self.n - 1)] == h):
            j = int(at[i])
            while j < self.n and self.keys[j] == h[i]:  # equal keys of different strings stand side by side
                if self.rule(j) == candidates[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def rule(self, j: int) -> bytes:
        return self.block[self.base + int(self.offsets[j]) : self.base + int(self.offsets[j + 1])]

    def blocks(self, j: int) -> bool:
        return bool(self.block[self.flags + j])


def _pieces(parts: Iterable[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """Small parts joined to pieces of some size."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x)
        if n >= size:
            yield b"".join(held)
            held, n = [], 0
    if held:
        yield b"".join(held)


def send(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> str:
    """Writes the rules' file and has Spark bring it to each executor; returns its name there."""
    name = f"url-rules-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    write_file(spark, path, SortedDigests.stream(rules) if isinstance(rules, DataFrame) else _pieces([SortedDigests.build(rules)]))
    spark.sparkContext.addFile(path)
    atexit.register(_quietly, spark, path)
    return name


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session is gone and its folder with it
        pass


@lru_cache(8)
def mapped(name: str) -> SortedDigests:
    """A sent file, mapped read-only: one a worker process, its pages shared by all of the machine."""
    with open(SparkFiles.get(name), "rb") as f:
        return SortedDigests(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def host_and_path(url):
    """Columns host (A-Z in lower case) and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, UPPER, LOWER), path


def candidates(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    """Every string that a fitting rule could be, longest first."""
    if not path.startswith("/"):
        return []
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    out = [s + "/" + path[1 : 1 + n] for s in suffixes for n in lengths if len(path) - 1 >= n]
    return sorted(out, key=len, reverse=True)


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = "allow", keep: tuple[str, ...] = ("page_id",), url_col: str = "url") -> DataFrame:
    """keep, host, path, rule (null if none fits) and verdict of every row of pages, by its url. rules: (verdict, rule)
    pairs, or a table of these columns."""
    name = send(pages.sparkSession, rules)
    keep = tuple(c for c in keep if c not in ("host", "path", "rule", "verdict"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "host string, path string, rule string, verdict string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = mapped(name)
        for b in batches:
            hosts, paths = b.column("host"), b.column("path")
            flat: list[bytes] = []
            ends = []
            for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
                flat += [x.encode() for x in candidates(h, p, d.lengths)]
                ends.append(len(flat))
            hit = d.probe(flat)
            rule, verdict, lo = [], [], 0
            for hi in ends:
                j = next((int(x) for x in hit[lo:hi] if x >= 0), -1)
                rule.append(d.rule(j).decode() if j >= 0 else None)
                verdict.append(default if j < 0 else "block" if d.blocks(j) else "allow")
                lo = hi
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), hosts, paths, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*keep, "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col(url_col))
    return pages.select(*keep, host.alias("host"), path.alias("path")).mapInArrow(run, schema)
