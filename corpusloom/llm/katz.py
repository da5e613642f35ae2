"""Katz backoff model of any order: Good-Turing discounted counts, exactly normalised backoff weights, recursive scores.

Counting and scoring are one exchange of compact tables. Documents are read once into blocks of some million
tokens (a bucketed table: counts, tokens as local numbers; and sorted word hashes, which go once they have been asked for). Each block asks, hash range by hash
range, for the counts of its distinct words; the partition of a range adds up what all blocks hold and answers in
the order asked. A word's number is its rank in its range by falling count, dealt round the ranges, so that frequent words
have small numbers, and each range's distinct counts (some hundred, by the driver to all) tell a number's count. With those answers the blocks ask for their distinct bigrams, partitioned by the first word, and get
the counts, and for each first word how many successors it has by count and their lower-order mass. Each higher order
is asked likewise, partitioned by its context, for the n-grams whose context and shorter n-gram training holds. If the
model is to be stored, each partition's counts become a row of a table, in the form of a question, and score_stored()
joins these to the questions that other texts ask. So what crosses the network is distinct words and bigrams of blocks, sorted, as
differences, compressed. A context with a share s of all tokens is spread over ceil(s * partitions)
partitions by the word that follows, and blocks add up the parts. What has a context or a shorter n-gram all of whose
occurrences, in training and beyond, are in one block (the block knows how many there are) isn't asked about: the block
has the count itself, and sends only how many such n-grams have each count, for each context that others share.
An answer says only what its block doesn't know: counts beyond the block's own, sums over a context's other n-grams, and
the lower-order mass of these only where the block has an n-gram without a count. Sums travel once, to the scores.

Model. Good-Turing: r* = (r+1) n(r+1) / n(r) for r <= K, renormalised as Katz does. Where r* isn't less than r, or no
longer told apart from it, and for all r beyond, n(r) is smoothed by Gale and Sampson's log-linear fit to all counts of counts.
Only tables whose counts of counts don't fall steeper than 1 / r (a few texts) get absolute discounts. P(w) is discounted, and what is left goes to one unknown word. P(w|v) of a
context v of one or more words is discounted for seen n-grams; else bow(v) P(w|v'), v' being v without its first word
and bow(v) what v's seen words leave divided by what they leave in P(.|v'). If a context's successors leave less than
1 / (c(v) + 1), they are scaled to leave that. A context unseen in training backs off with weight 1. So P(.|v) sums to
1 over the known words and the unknown one. A text's first word follows ends of texts only.

Defined results: a null or empty text is its end only. Words are split at ASCII white space, A-Z in lower case.
Null ids and repeated rows count and score like others. Without training rows all words are unknown, with
probability 1. An empty table gives an empty result. Identity of a word, and of a context of three or more, is a 64-bit
hash. Other columns are ignored.
"""

from __future__ import annotations

import atexit
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import remove, shared_dir, staged

K = 5
BLOCK_TOKENS = 3_000_000
END = b"\n"  # no word holds white space
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ANSWER = "kind string, block bigint, bucket int, blob binary"
#: Block b tells as TOLD - b what it knows without asking.
TOLD = -2


#: Arrays of so many numbers have each byte plane compressed on its own, so that a plane of few values costs little.
APART = 512


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers or of floats as bytes: byte planes of the least width that holds them; zeros take none."""
    out = []
    squeeze = zstandard.ZstdCompressor(level=1, write_content_size=False).compress
    for a in arrays:
        if a.dtype.kind == "f":
            kind, a = b"f", np.ascontiguousarray(a, np.float64)
        else:
            top = int(a.max()) if len(a) else 0
            kind, t = next((k, t) for k, t, m in ((b"0", np.uint8, 0), (b"1", np.uint8, 8), (b"2", np.uint16, 16), (b"4", np.uint32, 32), (b"8", np.uint64, 64)) if top < 1 << m)
            a = a.astype(t)
        out.append(kind + struct.pack("<I", len(a)))
        if kind == b"0" or not len(a):
            continue
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
        for plane in planes if len(a) >= APART else [planes]:
            body = squeeze(plane.tobytes()) if plane.any() else b""
            out.append(struct.pack("<I", len(body)) + body)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    expand = zstandard.ZstdDecompressor().decompress
    while at < len(blob):
        kind, (n,) = blob[at : at + 1], struct.unpack_from("<I", blob, at + 1)
        at += 5
        t = {b"f": np.float64, b"0": np.int64, b"1": np.uint8, b"2": np.uint16, b"4": np.uint32, b"8": np.uint64}[kind]
        if kind == b"0" or not n:
            out.append(np.zeros(n, t))
            continue
        width = np.dtype(t).itemsize
        planes = np.zeros((width, n), np.uint8)
        for part in planes if n >= APART else [planes]:
            (size,) = struct.unpack_from("<I", blob, at)
            if size:
                part[...] = np.frombuffer(expand(blob[at + 4 : at + 4 + size], max_output_size=part.size), np.uint8).reshape(part.shape)
            at += 4 + size
        a = np.ascontiguousarray(planes.T).reshape(-1).view(t)
        out.append(a if kind == b"f" or kind == b"8" else a.astype(np.int64))
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first element first."""
    return np.diff(a, prepend=a[:1] * 0)


def steps(a: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Differences of an array that is sorted within each run of equal elements of another; a run's first element as it is."""
    out = a.copy()
    out[1:] -= np.where(of[1:] == of[:-1], a[:-1], 0)
    return out


def summed_steps(step: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The array of which these are the steps, from the sizes of the runs."""
    run = np.cumsum(step)
    starts = np.cumsum(size) - size
    base = np.where(starts > 0, run[np.maximum(starts - 1, 0)], 0) if len(run) else starts
    return run - np.repeat(base, size)


def halves(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted identities as differences of their upper halves, and of their lower ones where the upper are equal."""
    upper, lower = ((x & np.uint64(0xFFFFFFFF)).astype(np.int64) for x in (ids >> np.uint64(32), ids))
    return gaps(upper), steps(lower, upper)


def joined(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The identities that halves() was given."""
    starts = np.flatnonzero(np.append(True, upper[1:] != 0)[: len(upper)])
    low = summed_steps(lower, np.diff(np.append(starts, len(upper))))
    return np.cumsum(upper).astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def by_count(c: np.ndarray) -> np.ndarray:
    """The order of falling counts, the first of equals first."""
    return np.argsort(-c, kind="stable")


def _edges() -> np.ndarray:
    """Where the bins of counts begin: each count on its own up to 32, then bins a quarter wider than their start."""
    out = list(range(1, 33))
    while out[-1] < 1 << 40:
        out.append(out[-1] + -(-out[-1] // 4))
    return np.array(out, np.int64)


#: A table's counts of counts are a histogram over these bins: as many numbers whatever the table.
EDGES = _edges()


def counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.searchsorted(EDGES, c[c > 0], "right") - 1, minlength=len(EDGES) - 1)


def slope(h: np.ndarray) -> float:
    """b of the fit log n(r) = a + b log r over all bins that hold counts; 0 with fewer than three of them."""
    at = np.flatnonzero(h)
    if len(at) < 3:
        return 0.0
    x = (np.log(EDGES[at]) + np.log(EDGES[at + 1] - 1)) / 2
    y = np.log(h[at] / (EDGES[at + 1] - EDGES[at]))
    x = x - x.mean()
    return float((x * (y - y.mean())).sum() / (x * x).sum())


def good_turing(h: np.ndarray, k: int = K) -> np.ndarray | None:
    """d(1..k) from a histogram of counts; None if it doesn't fall steeper than 1 / r, so that no smoothing gives discounts."""
    n = [0, *h[: k + 1].tolist()]
    b = slope(h)
    if b >= -1 or not n[1]:
        return None
    smooth = [(1 + 1 / r) ** (b + 1) for r in range(1, k + 1)]  # r* / r of the fit
    cut = (k + 1) * n[k + 1] / n[1]
    ratio = list(smooth)
    for r in range(1, k + 1):  # the counts themselves, while they can be trusted
        if not n[r] or not n[r + 1]:
            break
        raw = (r + 1) * n[r + 1] / n[r] / r
        error = (r + 1) / r * n[r + 1] / n[r] * np.sqrt((1 + n[r + 1] / n[r]) / n[r + 1])
        if not cut < raw < 1 or abs(raw - smooth[r - 1]) <= 1.65 * error:
            break
        ratio[r - 1] = raw
    if min(ratio) <= cut:
        ratio, cut = smooth, (k + 1) ** (b + 1)
    return (np.array(ratio) - cut) / (1 - cut)


def discounts(h: np.ndarray, k: int = K) -> np.ndarray:
    """d(0..k) from a histogram of counts: a seen count r <= k keeps d(r) r."""
    found = good_turing(h, k)
    if found is None:
        one, two = (int(x) for x in h[:2])
        off = one / (one + 2 * two) if one and two else 0.5
        found = [(r - off) / r for r in range(1, k + 1)]
    return np.array([1.0, *found])


@dataclass
class Unigrams:
    tokens: int  # N, training tokens
    types: int  # V, distinct ones
    d: np.ndarray
    scale: float
    unknown: float
    buckets: int  # hash ranges; a word's number is its rank in its range times these, plus the range's
    numbers: int  # all numbers are below
    table: bytes  # each range's distinct counts, falling, and how many words have each: a word's number tells its count

    @classmethod
    def of(cls, h: np.ndarray, tokens: int, types: int, sizes: np.ndarray, distinct: list[np.ndarray], words: list[np.ndarray], k: int = K) -> Unigrams:
        d = discounts(h, k)
        kept = tokens - sum((1 - d[r]) * r * int(h[r - 1]) for r in range(1, k + 1))
        left = 1 - kept / tokens if tokens else 1.0
        scale = 1.0
        if tokens and left < 1 / (tokens + 1):
            left = 1 / (tokens + 1)
            scale = (1 - left) * tokens / kept
        return cls(tokens, types, d, scale, left, len(sizes), (int(sizes.max(initial=0)) + 1) * len(sizes), pack(np.array([len(x) for x in distinct]), *(np.concatenate([*x, np.empty(0, np.int64)]) for x in (distinct, words))))

    def counts(self, number: np.ndarray) -> np.ndarray:
        """How often training has the words of these numbers."""
        n, distinct, words = unpack(self.table)
        size, at = self.numbers // self.buckets, np.repeat(np.arange(len(n)), n)
        ends = np.cumsum(words)
        before = np.append(0, ends)[np.cumsum(n) - n]
        ends += at * size - before[at]
        rank, bucket = np.divmod(number, self.buckets)
        return distinct[np.searchsorted(ends, bucket * size + rank, "right")]

    def parts(self, total: np.ndarray) -> np.ndarray:
        """Over how many partitions contexts that occur so often are spread."""
        return np.maximum(1, np.ceil(total / max(1, self.tokens) * self.buckets).astype(np.int64))

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word by its count; 0: the unknown word."""
        low = np.where(c <= len(self.d) - 1, self.d[np.minimum(c, len(self.d) - 1)], 1.0)
        return np.where(c > 0, low * c / max(1, self.tokens) * self.scale, self.unknown)


def ranges(h: np.ndarray, buckets: int) -> np.ndarray:
    """The hash range, one of so many, of each 64-bit hash."""
    return ((h >> np.uint64(32)).astype(np.int64) * buckets) >> 32


def spread(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))).astype(np.uint64) >> np.uint64(8)


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _combine(ids: np.ndarray, number: np.ndarray, exact: bool) -> np.ndarray:
    """Identity of contexts with one more word: both numbers, if they fit, else a hash."""
    if exact:
        return ids << np.uint64(32) | number.astype(np.uint64)
    x = (ids ^ (ids >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(batches: Iterator[pa.RecordBatch], order: int = 2) -> Iterator[pa.RecordBatch]:
    """Two rows of the block table for each block: hashes and counts of words, which are asked for once, and ids and
    training flags of documents with counts, lengths and tokens, which stay."""
    from pyspark import TaskContext

    most = BLOCK_TOKENS // max(1, order - 1)  # a worker holds as much of each order
    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    local, ids, train, tokens = _Local({END: 0}), [], [], []
    held, id_type = 0, None

    def flush() -> pa.RecordBatch:
        h = np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, len(local))
        hs, first, place = np.unique(h, return_index=True, return_inverse=True)  # words of equal hash are one
        t = place[np.concatenate(tokens)]
        lengths = np.array([len(x) for x in tokens])
        learn = np.repeat(np.array(train, bool), lengths)
        count, held = (np.bincount(t[x], minlength=len(hs)) for x in (learn, ~learn))
        rank = np.empty(len(hs), np.int64)
        rank[by_count(count + held)] = np.arange(len(hs))  # frequent words have small numbers, which take less
        return pa.RecordBatch.from_arrays([
            pa.array([block, block], pa.int64()), pa.array([[], ids], pa.list_(id_type)), pa.array([[], train], pa.list_(pa.bool_())),
            pa.array([pack(gaps(hs), count, held), pack(count, held)], pa.binary()), pa.array([b"", pack(lengths, rank[t], place[:1])], pa.binary()),
            pa.array(["hashes", "block"], pa.string()),
        ], ["block", "ids", "train", "words", "tokens", "kind"])

    for b in batches:
        id_type = b.column(0).type
        for doc, learn, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            words = raw.as_py().lower().split()
            words.append(END)
            tokens.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
            ids.append(doc)
            train.append(learn)
            held += len(words)
            if held >= most:
                yield flush()
                block += 1
                local, ids, train, tokens, held = _Local({END: 0}), [], [], [], 0
    if ids:
        yield flush()


def _ask_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            g, count, held = unpack(words.as_py())
            h = np.cumsum(g.astype(np.uint64), dtype=np.uint64)
            ends = np.searchsorted(ranges(h, buckets), np.arange(buckets + 1))
            for k in range(buckets):
                lo, hi = ends[k], ends[k + 1]
                if hi > lo:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bucket": pa.array([k], pa.int32()), "blob": pa.array([pack(gaps(h[lo:hi]), count[lo:hi], held[lo:hi])], pa.binary())})


def _rows(rows: list[tuple]) -> pa.Table:
    c = list(zip(*rows, strict=True))
    return pa.table({"kind": pa.array(c[0], pa.string()), "block": pa.array(c[1], pa.int64()), "bucket": pa.array(c[2], pa.int32()), "blob": pa.array(c[3], pa.binary())})


def _count_words(table: pa.Table, keep: bool = False, stored: bool = False) -> pa.Table:
    """One hash range: counts of counts, an answer to each block that asked, and if it is to be kept the model's table.
    With stored, block -1 is that table and alone counts."""
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("block").to_pylist()
    asked = [unpack(x) for x in table.column("blob").to_pylist()]
    hashes = [np.cumsum(x[0].astype(np.uint64), dtype=np.uint64) for x in asked]
    rows = []
    if stored:
        h, count = next(((x, a[1]) for b, x, a in zip(blocks, hashes, asked, strict=True) if b < 0), (np.empty(0, np.uint64), np.empty(0, np.int64)))
        every = np.concatenate(hashes)
        place = np.searchsorted(h, every)  # an unknown word gets a number that is never asked for
        known = np.append(h, np.uint64(0))[place] == every
        known &= place < len(h)
        got = np.where(known, np.append(count, 0)[place], 0)
        place = np.where(got > 0, place, len(h))
        sole = got[:0]
    else:
        h, place = np.unique(np.concatenate(hashes), return_inverse=True)
        count, held = (np.bincount(place, weights=np.concatenate([x[i] for x in asked]), minlength=len(h)).astype(np.int64) for i in (1, 2))
        got = count[place]
        times = np.concatenate([x[1] + x[2] for x in asked])
        sole = ((got > 0) & (got + held[place] == times)).astype(np.int64)
        rows.append(("stat", -1, bucket, pack(np.array([len(h), count.sum(), (count > 0).sum(), *counts_of_counts(count)]), *(x[::-1] for x in np.unique(count, return_counts=True)))))
        if keep:
            rows.append(("table", -1, bucket, pack(gaps(h), count, count[:0])))
    rank = np.empty(len(h) + 1, np.int64)
    rank[by_count(count)] = np.arange(len(h))
    rank[len(h)] = len(h)
    rank, at = rank[place], 0
    for block, x in zip(blocks, hashes, strict=True):
        mine = slice(at, at + len(x))
        at += len(x)
        if block >= 0:
            rows.append(("answer", block, bucket, pack(got[mine], gaps(rank[mine][by_count(got[mine])]), sole[mine])))
    return _rows(rows) if rows else _rows([("none", -1, bucket, b"")])


class Level:
    """A block's distinct n-grams of one order: index of the context and of the last word, sorted by both.

    Contexts are numbered in the order of their ids; total: how often training has each as a context; own: whether all
    its occurrences, in training and beyond, are in this block. low: the n-gram without its first word, an index of the
    level below; low_count: how often training has that; low_own: whether all its occurrences are here. What has an own
    context or an own shorter n-gram occurs nowhere else, so that its count is known here. home: from which partition on
    a context's n-grams are; contexts of two words keep to those of their first, where they are dense and so take little."""

    def __init__(self, uni: Unigrams, context: np.ndarray, tokens: np.ndarray, number: np.ndarray, ids: np.ndarray, home: np.ndarray, total: np.ndarray, own: np.ndarray, low: np.ndarray, low_count: np.ndarray, low_own: np.ndarray):
        self.uni, self.context, self.number, self.ids, self.home, self.total, self.own = uni, context, number, ids, home, total, own & (total > 0)
        key = context * len(number) + tokens
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        s = key[self.order]
        self.new = np.concatenate([[True], s[1:] != s[:-1]])
        self.first, self.second = (x.astype(np.int32) for x in np.divmod(s[self.new], len(number)))
        self.low = low[self.order[self.new]].astype(np.int32)
        self.by_word = low is tokens  # the shorter n-gram is the last word
        self.low_count = low_count[self.low]
        self.known = self.own[self.first] | (low_own[self.low] & (self.low_count > 0) & (self.total[self.first] > 0))

    def grams(self) -> np.ndarray:
        """The n-gram that ends at each token."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.new) - 1
        return out

    def times(self) -> np.ndarray:
        """How often the block has each n-gram."""
        return np.diff(np.append(np.flatnonzero(self.new), len(self.order)))

    def learnt(self, learn: np.ndarray) -> np.ndarray:
        """How often the block's training has each n-gram."""
        return np.add.reduceat(learn[self.order].astype(np.int64), np.flatnonzero(self.new))

    def told(self, learn: np.ndarray) -> bytes:
        """Counts of counts of the n-grams that aren't asked for."""
        return pack(counts_of_counts(self.learnt(learn)[self.known]))

    def asked(self, buckets: int) -> tuple[np.ndarray, ...]:
        """For the n-grams that training may hold elsewhere too and for their contexts: where each goes, in sorted order.

        Returns the n-grams' indexes and buckets, and the contexts, their buckets and which of a context's partitions
        it is, all sorted by bucket, then by number."""
        open_ = (self.total > 0) & ~self.own
        pair = np.flatnonzero(open_[self.first] & (self.low_count > 0) & ~self.known)
        parts, home = self.uni.parts(self.total), self.home
        to = ((home[self.first[pair]] + spread(self.number[self.second[pair]]) % parts[self.first[pair]].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        pair, to = pair[order], to[order]
        word = self.first[np.concatenate([[True], self.first[1:] != self.first[:-1]])]
        word = word[open_[word]]
        every = np.repeat(word, parts[word])
        part = np.arange(len(every)) - np.repeat(np.cumsum(parts[word]) - parts[word], parts[word])
        there = ((home[every] + part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(there, kind="stable")
        return pair, to, every[order], there[order], part[order]

    def wants(self, seen: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """How each context's lower-order mass is wanted: 2: an n-gram of it is unknown; 1: if one that is asked for turns out
        so; 0: not at all. A context in several partitions can't have 1."""
        out = np.zeros(len(self.ids), np.int64)
        out[self.first[seen == 0]] = 1
        out[(out > 0) & (self.uni.parts(self.total) > 1)] = 2
        sure = seen == 0
        sure[pair] = False
        out[self.first[sure]] = 2
        return out

    def questions(self, learn: np.ndarray, buckets: int, last: bool) -> Iterator[tuple[int, bytes]]:
        seen = self.learnt(learn)
        held = self.times() - seen
        pair, to, word, there, part = self.asked(buckets)
        wants = self.wants(seen, pair)
        sure = np.flatnonzero(self.known & ~self.own[self.first] & (seen > 0))
        sums = summed(self.first[sure], seen[sure], self.low_count[sure], len(self.ids))
        ends, word_ends = np.searchsorted(to, np.arange(buckets + 1)), np.searchsorted(there, np.arange(buckets + 1))
        for k in range(buckets):
            p, w = pair[ends[k] : ends[k + 1]], word[word_ends[k] : word_ends[k + 1]]
            if not len(w):
                continue
            first = self.first[p]
            lo = np.searchsorted(first, w)
            size = np.searchsorted(first, w, "right") - lo
            whole = part[word_ends[k] : word_ends[k + 1]] == 0  # a context's sums go to its first partition
            yield k, asking(self.ids[w], size, self.number[self.second[p]], first, self.low_count[p[:0] if self.by_word else p], seen[p], held[p[:0] if last else p], wants[w], [np.where(whole, x[w], 0) for x in sums])

    def read(self, answers: dict[int, bytes], buckets: int, learn: np.ndarray, sums: dict[int, bytes] | None = None) -> tuple[np.ndarray, ...]:
        """The count of each n-gram and whether all its occurrences are here; with sums also summed() of each context, and
        before these how many of its n-grams occur once. The lower-order mass is whole only where it is needed."""
        pair, _, word, _, _ = self.asked(buckets)
        seen = self.learnt(learn)
        c = np.where(self.known, seen, 0)
        own = c > 0
        at = 0
        for k in sorted(answers):
            more, sole = unpack(answers[k])
            mine = pair[at : at + len(more)]
            c[mine] = seen[mine] + more
            if len(sole):
                own[mine[(more == 0) & (seen[mine] > 0)]] = sole > 0
            at += len(more)
        if sums is None:
            return c, own, []
        have = np.flatnonzero(c > 0)
        out = summed(self.first[have], c[have], self.low_count[have], len(self.ids))
        wants = needs(self.wants(seen, pair), self.first[c == 0])
        at = 0
        for k in sorted(sums):
            rest = unpack(sums[k])
            w = word[at : at + len(rest[0])]
            asked = w[wants[w]]
            for i, (x, y) in enumerate(zip(out, rest, strict=True)):
                x[w if i < K else asked] += y  # a context comes once in a bucket
            at += len(w)
        once = self.total - sum(x * r for r, x in zip([*range(2, K + 1), 1], out[:K], strict=True))
        return c, own, [once, *out[: K - 1], *out[K:]]


def needs(wants: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Which contexts' lower-order mass is needed, by how it is wanted and the contexts of n-grams without a count."""
    out = wants.copy()
    out[unknown] *= 2
    return out > 1


def asking(ids: np.ndarray, size: np.ndarray, second: np.ndarray, first: np.ndarray, low: np.ndarray, seen: np.ndarray, held: np.ndarray, wants: np.ndarray, sums: list[np.ndarray]) -> bytes:
    """Contexts and their n-grams as a question. What a shorter n-gram's count is goes with each n-gram that has been
    learnt; if it is the last word, low is empty, since the word's number tells its count."""
    return pack(*halves(ids), size, steps(second, first), seen, low[seen > 0] if len(low) else low, held, wants, *sums)


def asked_for(blob: bytes) -> tuple[np.ndarray, ...]:
    """ids, size, second, low (0 where nothing was learnt), seen, held, wants and sums of a question."""
    upper, lower, size, step, seen, low, held, wants, *sums = unpack(blob)
    out = np.zeros(len(seen), np.int64)
    if len(low):
        out[seen > 0] = low
    return joined(upper, lower), size, summed_steps(step, size), out, seen, held, wants, sums


def summed(of: np.ndarray, count: np.ndarray, low: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n contexts: its n-grams by their count from 2 up to K, and the sum of such counts beyond (with all that
    it occurs, those of count 1 follow); then by the shorter n-gram's count up to K, and the sum of such counts beyond K.
    Discounts, which aren't known yet, make weights of these."""
    out = []
    for x, least in ((count, 2), (low, 1)):
        out += [np.bincount(of[x == r], minlength=n) for r in range(least, K + 1)]
        big = x > K
        out.append(np.bincount(of[big], weights=x[big], minlength=n).astype(np.int64))
    return out


class Block:
    """A block's tokens with what is known of its words."""

    def __init__(self, words: bytes, tokens: bytes, train: np.ndarray, answers: dict[int, bytes], uni: Unigrams, ask_all: bool):
        self.uni = uni
        count, held = unpack(words)
        n = len(count)
        self.lengths, tokens, end = unpack(tokens)
        self.learn = np.repeat(train, self.lengths)
        self.ask_all = ask_all
        self.starts = np.cumsum(self.lengths) - self.lengths
        own, number = np.zeros(n, bool), np.empty(n, np.int64)
        ranked = by_count(count + held)
        at = 0
        for bucket in sorted(answers):
            c, g, sole = unpack(answers[bucket])
            mine = slice(at, at + len(c))
            rank = np.empty(len(c), np.int64)
            rank[by_count(c)] = np.cumsum(g)
            count[mine], number[mine] = c, rank * uni.buckets + bucket
            if not ask_all:
                own[mine] = sole > 0
            at += len(c)
        order = np.argsort(number, kind="stable")  # from here words go by their numbers
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.count, self.number, self.own = count[order], number[order], own[order]
        self.tokens, self.end = place[ranked][tokens], int(place[end[0]])

    def bigrams(self) -> Level:
        # every document's first word follows the end of the one before
        before = np.concatenate([[self.end], self.tokens[:-1]])
        ids = self.number.astype(np.uint64)
        self.start_id = ids[self.end : self.end + 1]
        return Level(self.uni, before, self.tokens, self.number, ids, spread(ids), self.count, self.own, self.tokens, self.count, self.own)

    def longer(self, level: Level, count: np.ndarray, own: np.ndarray, n: int) -> Level:
        """The n-grams of order n, after those one shorter and their counts."""
        grams = level.grams()
        exact = n == 3 and self.uni.numbers <= 1 << 32
        self.start_id = _combine(self.start_id, self.number[self.end : self.end + 1], exact)
        ids = np.concatenate([_combine(level.ids[level.first], self.number[level.second], exact), self.start_id])
        home = spread(ids)
        if n == 3:
            first, second = np.append(level.first, self.end), np.append(level.second, self.end)
            parts = self.uni.parts(self.count).astype(np.uint64)
            word = spread(self.number)
            home = word[first] + word[second] % parts[first]
        total = np.append(count, self.count[self.end])  # a text begins as often as one ends
        context = np.concatenate([[0], grams[:-1]])
        context[self.starts] = len(count)
        own = own & (not self.ask_all)
        start = np.append(own, self.own[self.end])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return Level(self.uni, place[context], self.tokens, self.number, ids[order], home[order], total[order], start[order], grams, count, own)

    def questions(self, answers: dict[int, dict[int, bytes]], n: int, buckets: int, last: bool) -> tuple[Iterator[tuple[int, bytes]], bytes]:
        level = self.bigrams()
        for m in range(2, n):
            level = self.longer(level, *level.read(answers.get(m, {}), buckets, self.learn)[:2], m + 1)
        return level.questions(self.learn, buckets, last or self.ask_all), level.told(self.learn)

    def scores(self, answers: dict[int, dict[int, bytes]], buckets: int, d: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each document; d: discounts of the orders from 2."""
        uni, level = self.uni, self.bigrams()
        low = np.log10(uni.p(self.count))
        # what a shorter n-gram's count weighs, up to K and for each one beyond, and by which factor in each of its contexts
        weights, factor = [*uni.p(np.arange(1, K + 1)), uni.scale / max(1, uni.tokens)], None
        for n, dn in enumerate(d, 2):
            c, own, sums = level.read(answers.pop(n, {}), buckets, self.learn, answers.pop(-n, {}))
            mass = sum(x * w for x, w in zip(sums[K:], weights, strict=True))
            if factor is not None:
                below = np.zeros(len(level.ids), np.int64)
                below[level.context] = context
                mass = mass * factor[below]
            total = np.maximum(level.total, 1).astype(float)
            lost = sum(x * ((1 - dn[r]) * r) for r, x in enumerate(sums[:K], 1)) / total  # what discounting leaves
            left = np.maximum(lost, 1 / (total + 1))
            scale = (1 - left) / np.maximum(1 - lost, 1e-300)
            with np.errstate(divide="ignore"):
                back = np.where(level.total > 0, np.log10(left / np.maximum(1 - mass, 1e-300)), 0.0)
                seen = np.where(c <= K, dn[np.minimum(c, K)], 1.0) * c * (scale / total)[level.first]
                low = np.where(c > 0, np.log10(seen), back[level.first] + low[level.low])
            weights, factor, context = [*(dn[r] * r for r in range(1, K + 1)), 1.0], scale / total, level.context
            del sums, mass, lost, left, scale, total, back, seen
            if n <= len(d):
                level = self.longer(level, c, own, n + 1)
        each = low[level.grams()]
        base = np.log10((self.count + 0.5) / (uni.tokens + 0.5 * (uni.types + 1)))[self.tokens]
        known = (self.count[self.tokens] > 0).astype(np.int64)
        return self.lengths, np.add.reduceat(known, self.starts), np.add.reduceat(base, self.starts), np.add.reduceat(each, self.starts)


def _count_grams(table: pa.Table, keep: bool = False, uni: Unigrams | None = None) -> pa.Table:
    """The n-grams of one partition: counts of counts, an answer to each block, and if it is to be kept the table. uni is
    given if these are bigrams. An answer is two rows: counts, and sums, which are read when all discounts are known.
    Block -1 is a stored table; what asks with it has learnt nothing itself. Blocks up to TOLD tell the counts of counts
    of what they haven't asked for."""
    bucket = table.column("bucket")[0].as_py()
    blocks, asked = [], []
    own = np.zeros(len(EDGES) - 1, np.int64)
    for block, x in zip(table.column("block").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if block <= TOLD:
            own += unpack(x)[0].astype(np.int64)
        else:
            blocks.append(block)
            asked.append(x)
    if not blocks:
        return _rows([("stat", -1, bucket, pack(own))])
    words, sizes, seconds, lows, counts, beyond, wants, sums = zip(*map(asked_for, asked), strict=True)
    word, at = np.unique(np.concatenate(words), return_inverse=True)
    first, second = np.repeat(at, np.concatenate(sizes)), np.concatenate(seconds)
    order = np.argsort(first << 32 | second, kind="stable") if max(len(word), int(second.max(initial=0))) < 1 << 31 else np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    a, b = a[new], b[new]
    if uni:
        low = uni.counts(b)
    else:
        low = np.maximum.reduceat(np.concatenate(lows)[order], starts) if len(starts) else starts
    count = np.bincount(place, weights=np.concatenate(counts), minlength=len(a)).astype(np.int64)
    held = np.concatenate(beyond)
    if len(held):
        held = np.bincount(place, weights=held, minlength=len(a)).astype(np.int64)
    seen = count > 0
    of = a[seen]
    whole = summed(of, count[seen], low[seen], len(word))
    j = 0
    for w, more in zip(words, sums, strict=True):
        for x, y in zip(whole, more, strict=False):
            if y.any():
                np.add.at(x, at[j : j + len(w)], y)
        j += len(w)
    rows = [("stat", -1, bucket, pack(counts_of_counts(count) + own))]
    if keep:
        rows.append(("table", -1, bucket, asking(word, np.bincount(of, minlength=len(word)), b[seen], of, low[:0] if uni else low[seen], count[seen], count[:0], count[:0], [])))
    i = j = 0
    for block, size, w, mine_seen, mine_held, want, told in zip(blocks, sizes, words, counts, beyond, wants, sums, strict=True):
        mine, there = place[i : i + len(mine_seen)], at[j : j + len(w)]
        i, j = i + len(mine_seen), j + len(w)
        if block >= 0:
            c, x = count[mine], low[mine]
            more, sole = c - mine_seen, c[:0]
            if len(mine_held):
                alone = (more == 0) & (mine_seen > 0)
                sole = (held[mine[alone]] == mine_held[alone]).astype(np.int64)
            have = c > 0
            context = np.repeat(np.arange(len(w)), size)
            own = summed(context[have], c[have], x[have], len(w))  # what the block knows now
            rest = [x[there] - y - z for x, y, z in zip(whole, own, told, strict=True)]
            want = needs(want, context[~have])
            rows.append(("answer", block, bucket, pack(more, sole)))
            rows.append(("sums", block, bucket, pack(*rest[:K], *(x[want] for x in rest[K:]))))
    return _rows(rows)


def _stat(answers: DataFrame) -> dict[int, np.ndarray]:
    """The counts of counts of each partition: some hundred numbers for each."""
    return {r.bucket: unpack(r.blob) for r in answers.where("kind = 'stat'").collect()}


def _unigrams(words: DataFrame, buckets: int) -> Unigrams:
    stat = _stat(words)
    sizes = np.zeros(buckets, np.int64)
    for b, x in stat.items():
        sizes[b] = x[0][0]
    sums = sum((x[0] for x in stat.values()), np.zeros(3 + len(EDGES) - 1, np.int64))
    none = [np.empty(0, np.int64)] * 3
    return Unigrams.of(sums[3:], int(sums[1]), int(sums[2]), sizes, *([stat.get(b, none)[i] for b in range(buckets)] for i in (1, 2)))


def _discounts(grams: DataFrame) -> np.ndarray:
    return discounts(sum((x[0] for x in _stat(grams).values()), np.zeros(len(EDGES) - 1, np.int64)))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, store: str | None = None) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows for which train
    holds are what the model of n-grams up to the order learns from. With store, its tables are written to that path."""
    return _exchange(docs, train, id_col, text_col, order, store, None)


def score_stored(docs: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same of other texts, all held out, by the model that score() has stored."""
    return _exchange(docs, F.lit(False), id_col, text_col, 0, None, store)


def _exchange(docs: DataFrame, train: Column, id_col: str, text_col: str, order: int, store: str | None, model: str | None) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if model:
        order, buckets = spark.read.parquet(f"{model}/form").select("n", "buckets").first()
    if order < 2:
        raise ValueError(f"order {order}: a model with contexts has an order of 2 or more")
    rows = docs.select(id_col, F.coalesce(train, F.lit(False)).alias("__train"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__raw"))
    name = f"katz_blocks_{uuid.uuid4().hex}"
    made = rows.mapInArrow(_blocks if order == 2 else lambda b: _blocks(b, order), f"block bigint, ids array<{kind}>, train array<boolean>, words binary, tokens binary, kind string")
    # bucketed, so that answers travel to the blocks and not the blocks to the answers
    path = f"{shared_dir(spark)}/{name}"
    made.write.option("compression", "none").option("path", path).partitionBy("kind").bucketBy(buckets, "block").saveAsTable(name)
    atexit.register(_drop, spark, name)
    blocks = spark.table(name).where("kind = 'block'").drop("kind")
    keep = store is not None

    def answered(asked: DataFrame, n: int, count: Callable[[pa.Table], pa.Table]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Answers of an order, their sums, as of a level below zero, and the frame that has the order's statistics."""
        if model:
            asked = asked.unionByName(spark.read.parquet(f"{model}/order{n}").where("kind = 'table'").select("block", "bucket", "blob"))
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")  # a step's shuffle files go once its answers are written
        try:
            got, _ = staged(asked.groupBy("bucket").applyInArrow(count, ANSWER), f"katz-{n}", ["kind"])
        finally:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
        if keep:
            got.where("kind IN ('stat', 'table')").write.parquet(f"{store}/order{n}")
        answers, sums = (got.where(F.col("kind") == k).select("block", "bucket", "blob", F.lit(level).alias("level")) for k, level in (("answer", n), ("sums", -n)))
        return answers, sums, spark.read.parquet(f"{model}/order{n}") if model else got

    asked = spark.table(name).where("kind = 'hashes'").select("block", "words").mapInArrow(lambda b: _ask_words(b, buckets), "block bigint, bucket int, blob binary")
    answers, _, stat = answered(asked, 1, lambda t: _count_words(t, keep, model is not None))
    remove(spark, f"{path}/kind=hashes")
    uni = _unigrams(stat, buckets)
    sums: list[DataFrame] = []
    d: list[np.ndarray] = []

    def opened(block: pa.Table, answers: pa.Table) -> tuple[Block, dict[int, dict[int, bytes]]]:
        by_level: dict[int, dict[int, bytes]] = {}
        for b, x, n in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), answers.column("level").to_pylist(), strict=True):
            by_level.setdefault(n, {})[b] = x
        train = np.array(block.column("train")[0].as_py(), bool)
        return Block(block.column("words")[0].as_py(), block.column("tokens")[0].as_py(), train, by_level.pop(1), uni, keep or model is not None), by_level

    def asks(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def ask(d: pa.Table, answers: pa.Table) -> pa.Table:
            block, by_level = opened(d, answers)
            asked, told = block.questions(by_level, n, buckets, n == order)
            got = list(asked)
            own = d.column("block")[0].as_py()
            got.append((own % buckets, told))
            return pa.table({"block": pa.array([own] * (len(got) - 1) + [TOLD - own], pa.int64()), "bucket": pa.array([k for k, _ in got], pa.int32()), "blob": pa.array([x for _, x in got], pa.binary())})

        return ask

    def counts(words: Unigrams | None) -> Callable[[pa.Table], pa.Table]:
        return lambda t: _count_grams(t, keep, words)

    for n in range(2, order + 1):
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(asks(n), "block bigint, bucket int, blob binary")
        more, more_sums, stat = answered(asked, n, counts(uni if n == 2 else None))
        answers = answers.unionAll(more)
        sums.append(more_sums)
        d.append(_discounts(stat))
    if keep:
        spark.createDataFrame([(order, buckets)], "n int, buckets int").write.parquet(f"{store}/form")

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        of, by_level = opened(block, answers)
        tokens, known, base, total = of.scores(by_level, buckets, d)
        ids = block.column("ids").combine_chunks().flatten()
        held = np.logical_not(np.array(block.column("train")[0].as_py(), bool))
        return pa.table([ids, pa.array(held), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(tokens), uni.tokens), pa.int64()), pa.array(base), pa.array(total)], names)

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    for more_sums in sums:
        answers = answers.unionAll(more_sums)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def _drop(spark, name: str) -> None:
    try:
        path = f"{shared_dir(spark)}/{name}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)
    except Exception:  # the session is gone
        pass
