"""Harmonic packing: documents cut into class-sized pieces, fixed counts of them to a sequence.

The capacity C is divided into classes j with piece length C // j; classes whose bins would be padded by more
than C / 256 are left out. A document is cut greedily: the largest class length that fits, again and again; the
shrinking rest gives three or four pieces on average. A bin of class j is full with j pieces. What is shorter
than every class goes, as in the classical algorithm's last class, by next fit, here cut at the end of a bin.
Each worker packs its own partition in one pass and holds less than one bin of each class; at its end these are
joined by next fit, and the last bin is cut into powers of two, which need no padding.

Defined results: a null text is an empty one, whose only id is the end id; every id lies in exactly one piece.
A null doc_id is kept. Repeated rows are packed each on its own. A very long text is encoded whole by its task and gives as
many pieces as it needs. An empty table gives no pieces. Sequence ids are unique over partitions. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bytebpe import PATTERN, byte_chars
from corpusloom.llm.common import free

LAST_CLASS = 64
#: Pieces that a worker remembers before it starts anew.
PIECES_HELD = 600_000
OUT = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class _Pieces(dict):
    """Ids of the pieces met so far, as bytes; others are merged by the library's model when asked for."""

    def __init__(self, tokenize):
        self.tokenize = tokenize
        self.chars = dict(enumerate(byte_chars()))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES_HELD:
            self.clear()
        found = self.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.chars))
        ids = np.array([t.id for t in found], "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """text -> uint32 ids of a byte-level tokenizers file. A piece of the byte-level pattern has the same ids wherever it
    stands, so the tokenizers library's model is asked for each distinct one; texts with the string of a special token
    go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = regex.compile(PATTERN).findall
        self.pieces = _Pieces(self.library.model.tokenize)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.cut(text))), "<u4")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def classes(capacity: int) -> list[int]:
    """The piece lengths, longest first."""
    return [capacity // j for j in range(1, min(LAST_CLASS, capacity + 1)) if capacity % j <= capacity / 256]


class Packer:
    """Takes documents' ids one by one; take() returns the rows of the sequences that are full by then."""

    def __init__(self, capacity: int, first_sequence: int = 0):
        self.capacity, self.sequence = capacity, first_sequence
        self.lengths = classes(capacity)
        self.count = {n: capacity // n for n in self.lengths}
        self.open: dict[int, list] = {n: [] for n in self.lengths}
        self.tail: list = []
        self.tail_n = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), ids.tobytes(), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def _next_fit(self, piece: tuple) -> None:
        doc, start, ids, total = piece
        while len(ids):
            n = min(len(ids), self.capacity - self.tail_n)
            self.tail.append((doc, start, ids[:n], total))
            self.tail_n += n
            start, ids = start + n, ids[n:]
            if self.tail_n == self.capacity:
                self._close(self.tail)
                self.tail, self.tail_n = [], 0

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        for n in self.lengths:
            while total - at >= n:
                held = self.open[n]
                held.append((doc, at, ids[at : at + n], total))
                at += n
                if len(held) == self.count[n]:
                    self._close(held)
                    self.open[n] = []
        if at < total:
            self._next_fit((doc, at, ids[at:], total))

    def finish(self) -> None:
        for n in self.lengths:
            for piece in self.open[n]:
                self._next_fit(piece)
            self.open[n] = []
        rest, n = self.tail, self.tail_n
        self.tail, self.tail_n = [], 0
        while n:
            size = 1 << (n.bit_length() - 1)
            n -= size
            bin_, need = [], size
            while need:
                doc, start, ids, total = rest.pop(0)
                bin_.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    rest.insert(0, (doc, start + need, ids[need:], total))
                need -= len(bin_[-1][2])
            self._close(bin_)

    def rows(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", forget: bool = True) -> DataFrame:
    """A row per piece: id_col, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    forget: workers drop the pieces that they have met at a task's end, for they may live on in other stages; False where they have no others."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], "<u4")

        def flush(id_type) -> pa.RecordBatch:
            rows = packer.rows()
            c = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc, np.concatenate([encode(t.as_py()), end]).astype("<u4", copy=False))
                if len(packer.done) >= 4096:
                    yield flush(id_type)
        if id_type is not None:
            packer.finish()
            yield flush(id_type)
        if forget:
            encode.pieces.clear()
        free()

    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, {OUT}")
