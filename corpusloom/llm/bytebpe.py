"""Byte-level BPE of a tokenizers JSON file: encoding by a priority queue of merge ranks, decoding by strings.

A text is cut at the file's special tokens, then into pieces by the byte-level pattern. The bytes of a piece
are a doubly linked list of symbols; a heap holds (rank, position) of adjacent pairs. The least is popped; it is
stale, and skipped, if the symbols at its position no longer form a pair of that rank; else the right symbol is
unlinked and the pairs on both sides are pushed. Ids are decoded by joining the vocabulary's byte strings.

Defined results: a null text is an empty one and has no ids; a special token's string in a text is that token,
as the library does by default; ids are the library's for every code point. A very long piece takes time n log n, and
memory holds one text. Repeated rows are encoded each; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers before it starts anew.
CACHE_PIECES = 1_000_000


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class _Pieces(dict):
    """Ids of the pieces met so far, as bytes; others are merged when asked for."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = np.array(self.merge(piece.encode("utf-8", "replace")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class ByteBPE:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        of_char = {c: b for b, c in enumerate(byte_chars())}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for s, i in vocab.items():
            if s not in special:
                self.strings[i] = bytes(of_char[c] for c in s)
        for s, i in special.items():
            self.strings[i] = s.encode()
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.byte_id = [vocab[c] for c in byte_chars()]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(vocab[a] << 24 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.pieces = regex.compile(PATTERN).findall
        self.cache = _Pieces(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        byte_id, rank, made = self.byte_id, self.rank, self.made
        sym = [byte_id[b] for b in piece]
        n = len(sym)
        if n == 1:
            return sym
        get = rank.get
        heap = []
        a = sym[0]
        for i in range(n - 1):
            b = sym[i + 1]
            r = get(a << 24 | b)
            if r is not None:
                heap.append(r << 32 | i)
            a = b
        if not heap:
            return sym
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            e = pop(heap)
            i = e & 0xFFFFFFFF
            a = sym[i]
            j = after[i]
            if a < 0 or j >= n or get(a << 24 | sym[j]) != e >> 32:
                continue  # stale
            c = sym[i] = made[e >> 32]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = get(c << 24 | sym[k])
                if r is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = get(sym[h] << 24 | c)
                if r is not None:
                    push(heap, r << 32 | h)
        return [s for s in sym if s >= 0]

    def _ordinary(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.split is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        parts = (p for p in self.split.split(text) if p)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._ordinary(p) for p in parts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str) -> ByteBPE:
    """One per worker process."""
    return ByteBPE(path)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of each row; with keep_ids also ids (binary) and decoded.

    path: the tokenizer file, which must be there on every worker.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            n, h, g, ids, texts = [], [], [], [], []
            for t in b.column("__text"):
                e = bpe.encode(t.as_py())
                d = bpe.decode(e)
                n.append(len(e) // 4)
                h.append(hashlib.sha256(e).hexdigest())
                g.append(hashlib.sha256(d.encode()).hexdigest())
                if keep_ids:
                    ids.append(e)
                    texts.append(d)
            cols = [b.column(id_col), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(g, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary()), pa.array(texts, pa.string())] if keep_ids else []), [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids)

    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, schema)
