"""Embedders and the content-addressed vector cache."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens

DIM = 64
#: Tokens whose buckets a worker remembers (some 15 MB), and rows that it embeds at once.
KNOWN, EMBED_ROWS = 100_000, 2_000
_WORD = regex.compile(r"[\p{L}\p{N}_]+")


def hash64_cells(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, bucket, value): the signed count in each bucket that a token of the text falls into, in SQL only."""
    digest = F.sha2("token", 256)
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % DIM).cast("int")
    odd = F.substring(digest, 10, 1).isin(*"13579bdf")
    exploded = df.select(key, F.explode(tokens(F.col(text))).alias("token"))
    return exploded.select(key, bucket.alias("bucket"), F.when(odd, 1).otherwise(-1).alias("sign")).groupBy(key, "bucket").agg(F.sum("sign").alias("value"))


class Hash64:
    """Feature hashing of tokens into DIM buckets, sign from the token's digest. `counts` are whole numbers."""

    name, dim = "hash64", DIM

    def __init__(self):
        self._cells: dict[str, int] = {}

    def _cell(self, token: str) -> int:
        """The token's bucket, and DIM more if it counts as -1."""
        found = self._cells.get(token)
        if found is None:
            d = hashlib.sha256(token.encode()).digest()
            if len(self._cells) >= KNOWN:
                self._cells.clear()
            found = self._cells[token] = int.from_bytes(d[:4], "big") % DIM + (0 if d[4] & 1 else DIM)
        return found

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIM))
        for i, t in enumerate(texts):
            cells = [self._cell(w) for w in _WORD.findall((t or "").lower())]
            if cells:
                n = np.bincount(cells, minlength=2 * DIM)
                out[i] = n[:DIM] - n[DIM:]
        return out

    def embed(self, texts: list[str]) -> np.ndarray:
        v = self.counts(texts)
        n = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


class Remote:
    """An embedder behind a client: batches of at most `batch` texts, answers put in order by their index.

    make_client() runs on the worker and returns a function from texts to (index, vector) pairs.
    """

    def __init__(self, name: str, dim: int, make_client: Callable[[], Callable[[list[str]], list[tuple[int, list[float]]]]], batch: int = 256):
        self.name, self.dim, self.make_client, self.batch = name, dim, make_client, batch
        self._client = None

    def __getstate__(self):
        return self.__dict__ | {"_client": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        self._client = self._client or self.make_client()
        out = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            got = sorted(self._client(part), key=lambda x: x[0])
            if len(got) != len(part):
                raise ValueError(f"{self.name}: {len(got)} vectors for {len(part)} texts")
            out += [v for _, v in got]
        return np.array(out, float).reshape(len(texts), -1)


def _openai(model: str):
    """A client of OpenAI's embeddings, made on the worker; its library and key are needed only there."""
    def make():
        if not os.environ.get("OPENAI_API_KEY"):
            raise ValueError("OPENAI_API_KEY is not set")
        try:
            import openai
        except ImportError as e:
            raise ValueError(f"{model} needs the openai library") from e
        client = openai.OpenAI()
        return lambda texts: [(x.index, x.embedding) for x in client.embeddings.create(model=model, input=texts).data]

    return make


#: Registered embedders by name.
EMBEDDERS: dict[str, Callable[[], object]] = {"hash64": Hash64, "text-embedding-3-small": lambda: Remote("text-embedding-3-small", 1536, _openai("text-embedding-3-small"))}


def embedder(name: str):
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedding {name!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name]()


def embedded(model, texts: list[str], counts: bool) -> np.ndarray:
    """A row of numbers a text: whole ones as float64, others as float32."""
    v = model.counts(texts) if counts else model.embed(texts)
    if len(texts) and v.shape[1] != model.dim:
        raise ValueError(f"{model.name}: vectors of {v.shape[1]} numbers, not {model.dim}")
    return v.astype(np.float64 if counts else np.float32)


def embed(df: DataFrame, model, key: str, text: str = "text", out: str = "embedding", counts: bool = False) -> DataFrame:
    """key and vector of each row, row by row without a shuffle. counts: whole numbers, if the model has them."""
    kind = df.schema[key].dataType.simpleString()
    element = "double" if counts else "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, EMBED_ROWS) for whole in batches for at in range(0, whole.num_rows, EMBED_ROWS)):
            texts = b.column(1).to_pylist()
            flat = pa.array(embedded(model, texts, counts).ravel(), from_pandas=False)
            offsets = pa.array(np.arange(0, (len(texts) + 1) * model.dim, model.dim), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], [key, out])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{out}` array<{element}>")


def unique_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, text) of distinct texts; the key is their content's hash."""
    return df.select(F.sha2(F.col(text), 256).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])


def misses(df: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    return unique_keys(df, text).join(cache.where(F.col("model") == model).select("key"), "key", "left_anti")


def embed_cached(df: DataFrame, cache: DataFrame, model, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, embedding) of every row of df, and the cache with the new vectors: only distinct texts that the cache
    lacks are embedded. Vectors are float32 either way."""
    new = embed(misses(df, cache, model.name, text), model, "key", "text", "vec").select(F.lit(model.name).alias("model"), "key", "vec")
    grown = cache.unionByName(new)
    keyed = df.select(key, F.sha2(F.col(text), 256).alias("__key"))
    vectors = grown.where(F.col("model") == model.name).select(F.col("key").alias("__key"), F.col("vec").alias("embedding"))
    return keyed.join(vectors, "__key").select(key, "embedding"), grown


def cache_stats(df: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """One row: hits and misses among distinct texts."""
    have = cache.where(F.col("model") == model).select("key", F.lit(1).alias("have"))
    return unique_keys(df, text).join(have, "key", "left").agg(F.count("have").alias("hits"), F.count_if(F.col("have").isNull()).alias("misses"))


