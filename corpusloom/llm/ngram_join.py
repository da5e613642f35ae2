"""N-gram Jaccard join with count vectors in an R-tree.

Sets. A document's set holds the hashes of its distinct n-word shingles. Equal sets are one vertex.

Where pairs can meet. Two sets within the threshold differ in at most t elements, t from their sizes. Hash the
elements into t + m groups: m of them at least have the same content in both. So each set is sent, for its size
band and the next one, under one key per group (band, group, hash of the content); sets that share fewer than m
keys can't link. Groups empty in a set count as content only where a set has more of them than the slack that
the number of groups allows for. Shingles of a thousandth of all documents or more are left out of the keys, which loses
no link, so that common passages bring no strangers together. They are found in the pass that measures the sets: each task
counts all its sets' shingles in a sketch of 2 ** SKETCH_BITS counters, Spark adds the sketches slice by slice, and the workers get
one bit a counter; a rare shingle that shares its counter with a frequent one is left out of all keys as well. In large corpora
FREQUENT_DOCS documents are enough to be frequent: what strangers share by chance would else grow with the corpus. Pairs are
counted for keys of up to FEW sets only, or FEW_SMALL where the content is of one or two shingles, which strangers often share; a key of more joins
its sets to the least one, counted or not. A map task that finds such a key sends one row for it and keeps the rest as edges; so a key that a third of all documents
hold is at most one row a task, and no key gives more than FEW_SMALL sets' pairs.

Which pairs link. Vertices that share keys enough form coarse groups (connected components). A task
takes one coarse group at a time, however small: its sets' group counts are points of an R-tree, the overlap of two sets is at
most the sum of the smaller coordinates, nodes and points below the needed overlap are passed over, surviving
pairs are verified on the sets. Only members outside the largest part found so far have to search. A coarse
group of more than MAX_SHINGLES, or of more rows than a fair share of the tasks' (and MIN_ROWS), is split by size, into the sets of each band and
the one below, since others can't link. A part still too large is split into blocks by hash, dealt to tasks in turn: each block meets the group's pivots in a task of its own, then what lies outside the largest part meets every
block. So a task's memory and time are bounded and no pair is lost. Texts are shingled twice, once to measure and once for
keys, and a third time if they are in a coarse group: sending shingles along would cost four times the texts' bytes.

Defined results: a null text is empty. A document without words has size 0, links with nothing and is its own
component; with fewer than n words the whole sequence is its one shingle. A component's id is its smallest
document id; null ids are passed over, and a component of null ids only has a null id. Repeated rows get a
row each. Of a very long text all shingles count; memory holds one text and its words. An empty table gives an empty result. Hashes have 64 bits. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, free, maybe_broadcast, release, staged
from corpusloom.llm.graph import components

DIMENSIONS = 32
LEAF = 16
PIVOTS = 12
MAX_SHINGLES = 6_000_000
MIN_ROWS = 128
FREQUENT_SHARE, FREQUENT_DOCS = 1000, 400
SKETCH_BITS, SLICES = 22, 64
KEYS_HELD = 500_000
FEW, FEW_SMALL = 8, 32
MOST_SHARED = 6

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(1)
def _word_hash() -> _WordHash:
    return _WordHash()


def _forget() -> None:
    """At a task's end: the worker stays, and the next stages need its memory."""
    _word_hash().clear()
    free()


def shingles(raw: bytes, n: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text in UTF-8; A-Z in lower case, ASCII white space."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hash().__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        k = min(n, len(h))
        s = np.full(len(h) - k + 1, k * 0x9E3779B9, np.uint64)
        for i in range(k):
            s = _mix(s * np.uint64(31) + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit id of a set; 0 for the empty one."""
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True) if len(s) else 0


class Rule:
    """Linked if den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.limits = [1]
        while self.limits[-1] < 1 << 40:
            self.limits.append(self.limits[-1] * den // num + 1)
        self._groups: dict[int, tuple[int, int, int]] = {}

    def needed(self, a, b):
        """The least intersection with which sets of these sizes link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.limits, n, "right")) - 1

    def groups(self, band: int) -> tuple[int, int, int]:
        """How many groups the sets of a band and the one below are cut into, the slack for empty ones, and how many
        groups that aren't empty two sets share at least if they link."""
        if band not in self._groups:
            most = self.limits[band + 1] - 1
            differ = 2 * most * (self.den - self.num) // (self.den + self.num)
            shared = min(MOST_SHARED, 1 + differ // 4)
            slack = 0
            while True:
                g = differ + shared + slack
                empty = g * np.exp(-self.limits[max(band - 1, 0)] / g)
                if slack >= empty + 4 * np.sqrt(empty) + 0.5 or slack > differ + 8:
                    break
                slack += 1
            self._groups[band] = g, slack, shared
        return self._groups[band]


#: Bits of a key: one of more sets than its pairs are counted for, and one whose content is small.
MANY, SMALL = np.uint64(8), np.uint64(16)


def few(k: np.ndarray) -> np.ndarray:
    """Of how many sets keys may be for their pairs to be counted."""
    return np.where(k & SMALL, FEW_SMALL, FEW)


def counter_of(s: np.ndarray) -> np.ndarray:
    """The counter of the sketch that a shingle falls into."""
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def keys(s: np.ndarray, rule: Rule, frequent: np.ndarray) -> np.ndarray:
    """frequent: bits of the counters whose shingles are left out. The keys under which a set meets every set that it may link with. Their low three bits say how many of them
    linked sets share; the fourth is for _key_rows, the fifth marks a content of one or two shingles."""
    n = len(s)
    if len(frequent):
        at = counter_of(s)
        s = s[(frequent[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0]
    band = rule.band(n)
    out = []
    with np.errstate(over="ignore"):
        mixed = _mix(s + np.uint64(77))
        for b in (band, band + 1):
            g, slack, shared = rule.groups(b)
            group = (s >> np.uint64(20)) % np.uint64(g)
            group = group.astype(np.int64)
            total = np.zeros(g, np.uint64)
            np.add.at(total, group, mixed)
            size = np.bincount(group, minlength=g)
            full = np.flatnonzero(size) if g - np.count_nonzero(size) <= slack else np.arange(g)
            small = (size[full] > 0) & (size[full] <= 2)
            out.append(_mix(total[full] + _mix(full.astype(np.uint64) + np.uint64(b << 32))) & ~np.uint64(31) | np.where(small, SMALL, np.uint64(0)) | np.uint64(shared))
    return np.concatenate(out)


class RTree:
    """Points packed into leaves of near ones; each node has the greatest coordinates and least size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rule: Rule):
        self.points, self.sizes, self.rule = points, sizes, rule
        order: list[np.ndarray] = []

        def split(rows: np.ndarray) -> None:
            if len(rows) <= LEAF:
                order.append(rows)
                return
            p = points[rows]
            widest = int((p.max(0) - p.min(0)).argmax())
            rows = rows[np.argsort(p[:, widest], kind="stable")]
            half = len(rows) // 2
            split(rows[:half])
            split(rows[half:])

        split(np.argsort(sizes, kind="stable"))
        self.leaves = order
        tops = np.array([points[r].max(0) for r in order])
        least = np.array([sizes[r].min() for r in order])
        self.levels = [(tops, least)]
        while len(tops) > LEAF:
            cuts = np.arange(0, len(tops), LEAF)
            tops, least = np.maximum.reduceat(tops, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((tops, least))

    def search(self, i: int) -> np.ndarray:
        """Points whose bound on the overlap with point i reaches what a link needs."""
        q, n = self.points[i], self.sizes[i]
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, least = self.levels[depth]
            nodes = nodes[np.minimum(tops[nodes], q).sum(1) >= self.rule.needed(least[nodes], n)]
            if depth:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        if not len(nodes):
            return nodes
        rows = np.concatenate([self.leaves[k] for k in nodes])
        return rows[np.minimum(self.points[rows], q).sum(1) >= self.rule.needed(self.sizes[rows], n)]


def count_vector(s: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.bincount(((s >> np.uint64(7)) % np.uint64(dimensions)).astype(np.int64), minlength=dimensions)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def overlaps(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The size of a's intersection with each other set, which aren't empty."""
    if not others:
        return np.empty(0, np.int64)
    every = np.concatenate(others)
    same = a[np.minimum(np.searchsorted(a, every), len(a) - 1)] == every
    return np.add.reduceat(same.astype(np.int64), np.cumsum([0, *(len(x) for x in others[:-1])]))


def linked_parts(sets: list[np.ndarray], rule: Rule, tally: Counter | None = None) -> np.ndarray:
    """The root (an index) of each set: the components of the links among them. tally counts searches of the tree, their
    survivors in other parts, and those that link."""
    m = len(sets)
    root = np.arange(m)
    sizes = np.array([len(s) for s in sets])
    if m < 2:
        return root

    tree = RTree(np.array([count_vector(s) for s in sets]), sizes, rule)
    searched = np.zeros(m, bool)
    while True:
        # two sets in different parts aren't both in the largest one: who is outside it has to search
        labels, count = np.unique(root, return_counts=True)
        todo = np.flatnonzero((root != labels[count.argmax()]) & ~searched)
        if not len(todo):
            return root
        i = int(todo[len(todo) // 2])
        searched[i] = True
        found = tree.search(i)
        found = found[root[found] != root[i]]
        near = found[overlaps(sets[i], [sets[j] for j in found]) >= rule.needed(sizes[found], sizes[i])]
        if tally is not None:
            tally.update(searches=1, survivors=len(found), linked=len(near))
        if len(near):
            root[np.isin(root, root[near])] = root[i]


def _raw(text_col: str):
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__raw")


class Sketch:
    """How many sets hold shingles of each counter, added up over a task."""

    def __init__(self):
        self.count = np.zeros(1 << SKETCH_BITS, np.uint32)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, s: np.ndarray) -> None:
        self.held.append(counter_of(s))
        self.n += len(s)
        if self.n >= 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.count += np.bincount(np.concatenate(self.held), minlength=len(self.count)).astype(np.uint32)
            self.held, self.n = [], 0

    def slices(self) -> list[bytes]:
        """Compressed parts of the counters, low bytes first."""
        self.flush()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return [squeeze(x.view(np.uint8).reshape(-1, 4).T.tobytes()) for x in np.split(self.count, SLICES)]


def _add_slices(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One slice: the sum of all tasks' counters, as 64-bit numbers."""
    width = (1 << SKETCH_BITS) // SLICES
    expand = zstandard.ZstdDecompressor().decompress
    total = np.zeros(width, np.uint64)
    for b in batches:
        for x in b.column("sketch"):
            total += np.frombuffer(np.frombuffer(expand(x.as_py()), np.uint8).reshape(4, width).T.tobytes(), np.uint32)
    yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([int(total.sum())], pa.int64()), "counters": pa.array([total.tobytes()], pa.binary())})


def least_frequent(documents: int, mean: float) -> float:
    """From which count on a counter is of a frequent shingle. mean: of all counters, which rare shingles fill by chance."""
    return max(20, min(documents // FREQUENT_SHARE, FREQUENT_DOCS)) + mean + 4 * mean**0.5


def frequent_counters(sketches: DataFrame, documents: int) -> np.ndarray:
    """Bits of the counters that at least 1 / FREQUENT_SHARE of all documents fill, or FREQUENT_DOCS where that is less, beyond what rare
    shingles fill on the average: half a megabyte, whatever the corpus. sketches: (slice, sketch) of each task."""
    added = cut(sketches.groupBy("slice").applyInArrow(_add_slices, "slice int, total bigint, counters binary"))
    total = added.agg(F.sum("total")).first()[0] or 0
    least = least_frequent(documents, total / (1 << SKETCH_BITS))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.packbits(np.frombuffer(x.as_py(), np.uint64) >= least, bitorder="little").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["slice", "bits"])

    found = added.select("slice", "counters").mapInArrow(bits, "slice int, bits binary").collect()  # SLICES rows
    out = np.zeros((1 << SKETCH_BITS) >> 3, np.uint8).reshape(SLICES, -1)
    for r in found:
        out[r.slice] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def _grouped(k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys and vertices sorted, each pair once, and where each key's run starts and how long it is."""
    order = np.lexsort((v, k))
    k, v = k[order], v[order]
    once = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
    k, v = k[once], v[once]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k, v, starts, np.diff(np.append(starts, len(k)))


def _key_rows(batches: Iterator[pa.RecordBatch], n: int, rule: Rule, frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, vertices, edges): keys dealt to buckets; of a key of many sets one row and edges."""
    ks: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        k, v, starts, size = _grouped(np.concatenate(ks), np.concatenate(vs))
        many = np.repeat(size > few(k[starts]), size)
        head = np.zeros(len(k), bool)
        head[starts] = True
        edges = np.unique(np.column_stack([np.repeat(v[starts], size)[many & ~head], v[many & ~head]]), axis=0)
        k = np.where(many, k | MANY, k)[~many | head]
        v = v[~many | head]
        bucket = ((k >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(b, k[o].tobytes(), v[o].tobytes(), b"") for b in range(buckets) if len(o := order[ends[b] : ends[b + 1]])]
        rows.append((len(ks) % buckets, b"", b"", edges.astype(np.int64).tobytes()))
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(c[0], pa.int32()), **{x: pa.array(c[i + 1], pa.binary()) for i, x in enumerate(("ks", "vs", "edges"))}})

    for b in batches:
        for r in b.column(0):
            s = shingles(r.as_py(), n)
            if not len(s):
                continue
            k = keys(s, rule, frequent)
            ks.append(k)
            vs.append(np.full(len(k), set_id(s), np.int64))
            held += len(k)
            if held >= KEYS_HELD:
                yield flush()
                ks, vs, held = [], [], 0
    if ks:
        yield flush()
        ks, vs = [], []
    _forget()


def _meet(table: pa.Table) -> pa.Table:
    """(a, b, n, need) of one bucket: pairs that share n keys and need so many to link; need 0 joins them anyway."""
    k = np.frombuffer(b"".join(table.column("ks").to_pylist()), np.uint64)
    v = np.frombuffer(b"".join(table.column("vs").to_pylist()), np.int64)
    sure = [np.frombuffer(b"".join(table.column("edges").to_pylist()), np.int64).reshape(-1, 2)]
    pairs, need = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
    if len(k):
        flagged = np.unique(k[(k & MANY) > 0] & ~MANY)
        k, v, starts, size = _grouped(k & ~MANY, v)
        many = size > few(k[starts])
        if len(flagged):
            at = np.minimum(np.searchsorted(flagged, k[starts]), len(flagged) - 1)
            many |= flagged[at] == k[starts]
        run = np.repeat(np.arange(len(starts)), size)
        joined = many[run] & (v != v[starts][run])
        sure.append(np.column_stack([v[starts][run][joined], v[joined]]))
        counted = np.flatnonzero(~many[run] & (size > 1)[run])  # most keys are of one set
        k, v, run = k[counted], v[counted], run[counted]
        for d in range(1, FEW_SMALL):
            i = np.flatnonzero(run[:-d] == run[d:])
            if not len(i):
                break
            pairs.append(np.column_stack([v[i], v[i + d]]))
            need.append((k[i] & np.uint64(7)).astype(np.int64))
        del run, joined, many, counted
    del k, v
    e = np.unique(np.concatenate(sure), axis=0)
    p, q = np.concatenate(pairs), np.concatenate(need)
    del sure, pairs, need
    order = np.lexsort((p[:, 1], p[:, 0]))
    p, q = p[order], q[order]
    starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]).any(1)])[: len(p)])
    n, q = np.diff(np.append(starts, len(p))), np.minimum.reduceat(q, starts) if len(starts) else q
    out = np.concatenate([e, p[starts]])
    return pa.table({"a": out[:, 0], "b": out[:, 1], "n": np.concatenate([np.ones(len(e), np.int64), n]), "need": np.concatenate([np.zeros(len(e), np.int64), q])})


def _verify(batches: Iterator[pa.RecordBatch], n: int, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (comp, part); yields an edge from each set to the root of its linked part."""
    at, sets = None, {}

    def done() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            ids = np.array(list(sets), np.int64)
            root = linked_parts(list(sets.values()), rule)
            moved = root != np.arange(len(ids))
            if moved.any():
                yield pa.RecordBatch.from_pydict({"a": ids[moved], "b": ids[root[moved]]})

    for b in batches:
        for comp, part, v, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if (comp, part) != at:
                yield from done()
                at, sets = (comp, part), {}
            if v not in sets:
                s = shingles(raw.as_py(), n)
                if set_id(s) == v:  # another text under the same document id is another vertex
                    sets[v] = s
    yield from done()
    sets = {}
    _forget()


def _by_size(large: DataFrame, rule: Rule) -> DataFrame:
    """Coarse groups as parts of sets that may link by their sizes: a band's and those of the one below. Parts without a set of their own band lie in another."""
    limits = [x for x in rule.limits if x < 1 << 31]
    band = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x <= F.col("n_shingles"))) - 1
    rows = large.drop("__volume", "__rows").withColumn("__band", band).withColumn("__at", F.explode(F.array(F.col("__band"), F.col("__band") + 1)))
    part = F.xxhash64("__comp", "__at")
    rows = rows.select("__id", "__hash", "v", part.alias("__comp"), "n_shingles", (F.col("__at") == F.col("__band")).alias("__own"))
    sizes = rows.groupBy("__comp").agg(F.sum("n_shingles").alias("__volume"), F.count("*").alias("__rows"), F.max("__own").alias("__any"))
    return cut(rows.drop("__own").join(maybe_broadcast(cut(sizes.where("__any AND __rows > 1").drop("__any"))), "__comp"))


def _large_links(large: DataFrame, verified: Callable[[DataFrame], DataFrame], max_shingles: int, max_rows: int) -> DataFrame:
    """Links within parts too large for one task, as edges (a, b).

    First each block of such a group meets the group's pivots, which unites the most of it in one pass. Two sets in
    different parts then aren't both in the largest one; so only what is left outside it meets every block.
    """
    def blocks(volume: Column, rows: Column) -> Column:
        return F.greatest(F.ceil(2 * volume / max_shingles), F.ceil(rows / max_rows)).cast("int")  # halves of the bound, for two blocks share a task

    k = blocks(F.col("__volume"), F.col("__rows"))
    rows = large.withColumn("__k", k).withColumn("__block", F.pmod(F.xxhash64("v"), F.col("__k").cast("long")).cast("int"))
    seeds = [F.min(F.struct(F.xxhash64("v", F.lit(i)).alias("h"), "__id", "__hash", "v")) for i in range(PIVOTS)]
    pivots = rows.groupBy("__comp", "__k").agg(F.array(*seeds).alias("p")).withColumn("p", F.explode("p"))
    pivots = pivots.select("p.__id", "p.__hash", "p.v", "__comp", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)).alias("__part"))
    first = cut(verified(rows.select("__id", "__hash", "v", "__comp", F.col("__block").alias("__part")).unionByName(pivots)))
    named = cut(rows.join(components(first), "v", "left").withColumn("__label", F.coalesce("root", "v")).drop("root"))
    main = named.groupBy("__comp", "__label").count().groupBy("__comp").agg(F.max_by("__label", F.struct("count", "__label")).alias("__main"))
    # a row a group is sent to its members, which needn't meet in one task
    named = named.join(maybe_broadcast(cut(main)), "__comp").withColumn("__outside", F.col("__label") != F.col("__main"))
    left = named.where("__outside").groupBy("__comp").agg(blocks(F.sum("n_shingles"), F.count("*")).alias("__r"))
    tasks = named.join(maybe_broadcast(cut(left)), "__comp").withColumn("__own", F.pmod(F.xxhash64(F.lit("r"), "v"), F.col("__r").cast("long")).cast("int"))
    as_block = F.transform(F.sequence(F.lit(0), F.col("__r") - 1), lambda r: r * F.col("__k") + F.col("__block"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("__k") - 1), lambda b: F.col("__own") * F.col("__k") + b)
    parts = F.when(F.col("__outside"), F.array_distinct(F.concat(as_block, as_left))).otherwise(as_block)
    return first.unionAll(verified(tasks.select("__id", "__hash", "v", "__comp", F.explode(parts).alias("__part"))))


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", max_shingles: int = MAX_SHINGLES, roots: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id), one row for each row of docs; with roots also text_hash and root, which
    names the component whatever its ids (null for a document without words).

    Linked are sets of n-word shingles with den * |intersection| >= num * |union|.
    """
    rule = Rule(num, den)
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession

    names = [id_col, "text_hash", "v", "n_shingles", "slice", "sketch"]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, id_type = Sketch(), None
        for b in batches:
            id_type = b.schema.field(0).type
            s = [shingles(r.as_py(), n) for r in b.column(1)]
            for x in s:
                sketch.add(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([set_id(x) for x in s], pa.int64()), pa.array([len(x) for x in s], pa.int64()), pa.nulls(len(s), pa.int32()), pa.nulls(len(s), pa.binary())], names)
        if id_type is not None:
            got = sketch.slices()
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, id_type), *[pa.nulls(SLICES, pa.int64())] * 3, pa.array(range(SLICES), pa.int32()), pa.array(got, pa.binary())], names)
        _forget()

    text_hash = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    measured, _ = staged(docs.select(id_col, _raw(text_col), text_hash.alias("__hash")).mapInArrow(sizes, f"`{id_col}` {kind}, text_hash bigint, v bigint, n_shingles bigint, slice int, sketch binary"), "sets")
    every = measured.where("slice IS NULL").select(*names[:4])
    frequent = spark.sparkContext.broadcast(frequent_counters(measured.where("slice IS NOT NULL").select("slice", "sketch"), every.count()))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(_raw(text_col)).mapInArrow(lambda b: _key_rows(b, n, rule, frequent.value, buckets), "bucket int, ks binary, vs binary, edges binary")
    met = keyed.groupBy("bucket").applyInArrow(_meet, "a bigint, b bigint, n bigint, need bigint")
    enough = met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need")
    coarse = cut(components(enough))
    del keyed, met, enough
    release(spark)
    reps = every.where("n_shingles > 0").groupBy("v").agg(F.min(F.struct(F.col(id_col).alias("id"), "text_hash")).alias("rep"), F.first("n_shingles").alias("n_shingles"))
    placed = coarse.join(reps, "v")
    volume = placed.groupBy("root").agg(F.sum("n_shingles").alias("__volume"), F.count("*").alias("__rows"))
    sized = cut(placed.join(volume, "root").select(F.col("rep.id").alias("__id"), F.col("rep.text_hash").alias("__hash"), "v", F.col("root").alias("__comp"), "n_shingles", "__volume", "__rows"))
    max_rows = max(MIN_ROWS, -(-2 * sized.count() // buckets))  # two fair shares of the tasks' rows
    texts = docs.select(F.col(id_col).alias("__doc"), text_hash.alias("__h"), _raw(text_col))
    if every.groupBy(id_col, "text_hash").count().where("count > 1").limit(1).count():
        # rows that repeat an id (or none) and a text are one before they are moved, not only in the task that they meet in
        texts = texts.groupBy("__doc", "__h").agg(F.first("__raw").alias("__raw"))

    def verified(tasks: DataFrame) -> DataFrame:
        # id and text hash: rows of one id, or of none, meet only if their texts are the same
        rows = texts.join(maybe_broadcast(tasks), (F.col("__hash") == F.col("__h")) & F.col("__id").eqNullSafe(F.col("__doc")))
        rows = rows.select("__comp", "__part", "v", "__raw")
        to = F.pmod(F.xxhash64("__comp") + F.col("__part"), F.lit(buckets)).cast("int")  # a group's blocks go to tasks in turn
        return rows.repartitionById(buckets, to).sortWithinPartitions("__comp", "__part").mapInArrow(lambda b: _verify(b, n, rule), "a bigint, b bigint")

    whole = (F.col("__volume") <= max_shingles) & (F.col("__rows") <= max_rows)
    within = sized.where(whole)
    large = sized.where(~whole)
    if large.limit(1).count():
        parts = _by_size(large, rule)
        within, large = within.select(*parts.columns).unionAll(parts.where(whole)), parts.where(~whole)
    links = verified(within.withColumn("__part", F.lit(0)))
    if large.limit(1).count():
        links = links.unionAll(_large_links(large, verified, max_shingles, max_rows))
    root = components(links)
    del links
    release(spark)
    named = every.join(root, "v", "left").withColumn("__root", F.coalesce("root", "v"))
    least = named.where("n_shingles > 0").groupBy("__root").agg(F.min(id_col).alias("__least"))
    return named.join(least, "__root", "left").select(id_col, "n_shingles", *([F.col("text_hash"), F.when(F.col("n_shingles") > 0, F.col("__root")).alias("root")] if roots else []), F.when(F.col("n_shingles") > 0, F.col("__least")).otherwise(F.col(id_col)).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component left, that of the least id, and all documents without words. Rows
    that agree in id and text are one."""
    found = join(docs, n, num, den, id_col, text_col, roots=True).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__h"), "root")
    least = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("__id", "__h")).alias("k")).select("k.__id", "k.__h")
    kept = least.unionAll(found.where(F.col("root").isNull()).select("__id", "__h").distinct())
    # one key for the join and the aggregate, so that texts are moved once; the row is one column, so that no names clash
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key(F.col(id_col)).alias("key"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("hash"))
    kept = kept.select(key(F.col("__id")).alias("key"), F.col("__h").alias("hash"))
    once = rows.join(kept, ["key", "hash"], "left_semi").dropDuplicates(["key", "hash"])
    return once.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
