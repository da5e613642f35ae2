"""Exact cosine search: batches of queries against partitions of vectors, each partition keeping its k best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions.text import squeeze, tokens
from corpusloom.functions.vector import cosine_distance
from corpusloom.operators.embed import embed, embedded

#: Queries of a block, vectors of a tile, and scores that a task holds at once (8 MB, a few times over).
QUERY_BLOCK, TILE_ROWS, CELLS = 4096, 50_000, 500_000
#: Numbers in all query vectors together that may be sent to every task (32 MB).
FEW_VALUES = 4_000_000


class Best:
    """The k best ids of each query so far, by score, those below all others last, then by id. Scores that are NaN don't count."""

    def __init__(self, names: list, k: int, digits: int | None):
        self.names, self.k, self.digits = names, k, digits
        self.best: list[list[tuple]] = [[] for _ in names]
        self.least = np.full(len(names), -np.inf)  # what a score must reach to be among the k

    def offer(self, ids, score: np.ndarray) -> None:
        """A row of scores, one a query, for each of the ids (an Arrow array). What doesn't reach the k best of a query isn't looked at."""
        if self.digits is not None:
            score = np.round(score, self.digits)
        reach = self.least
        if len(score) > self.k and np.isneginf(reach).any():  # the k best of these alone
            reach = np.maximum(reach, np.partition(np.where(np.isnan(score), -np.inf, score), len(score) - self.k, axis=0)[len(score) - self.k])
        query, row = np.nonzero((score >= reach[None, :]).T)
        if not len(query):
            return
        names, value = ids.take(pa.array(row)).to_pylist(), score[row, query].tolist()
        bounds = np.flatnonzero(np.diff(query, prepend=-1)).tolist() + [len(query)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            j = int(query[lo])
            held = self.best[j] + [(-value[i], names[i]) for i in range(lo, hi)]
            held.sort()
            self.best[j] = held[: self.k]
            if len(held) >= self.k:
                self.least[j] = -self.best[j][-1][0]

    def batch(self, query_type: pa.DataType, id_type: pa.DataType, columns: list[str]) -> pa.RecordBatch:
        """What is held as rows; a score below all others is NaN again."""
        flat = [(n, i, float("nan") if s == np.inf else -s) for n, held in zip(self.names, self.best, strict=True) for s, i in held]
        q, i, s = list(zip(*flat, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(q, query_type), pa.array(i, id_type), pa.array(s, pa.float64())], columns)


class _Near:
    """The vectors nearest to each of some query vectors, zero vectors last."""

    def __init__(self, names: list, q: np.ndarray, k: int, digits: int | None):
        self.q, self.norm, self.best = q, np.sqrt((q * q).sum(1)), Best(names, k, digits)

    def add(self, ids, v: np.ndarray) -> None:
        norms = np.sqrt((v * v).sum(1))[:, None] * self.norm[None, :]
        score = v @ self.q.T
        with np.errstate(invalid="ignore", divide="ignore"):
            np.divide(score, norms, out=score)
        score[~(norms > 0) | np.isnan(score)] = -np.inf
        self.best.offer(ids, score)


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(flat), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "embedding", query_col: str = "query_id", query_vec: str = "embedding", digits: int | None = None, read=None) -> DataFrame:
    """(query_col, id_col, score, rank): for each query its k nearest vectors, ties by id, zero vectors last.

    Vectors are read once, whatever the number of queries. Queries of a checked size are sent to all tasks, and no vector moves;
    more are dealt to blocks, vectors to tiles, and each task meets one block with one tile. Either way a task passes on only k rows a
    query. With digits, scores are rounded before ranking, so that the order doesn't hang on the last bit. read: makes the numbers of
    an Arrow column vec_col that doesn't hold vectors yet.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    kinds = {query_col: queries.schema[query_col].dataType.simpleString(), id_col: vectors.schema[id_col].dataType.simpleString()}
    schema = f"`{query_col}` {kinds[query_col]}, `{id_col}` {kinds[id_col]}, score double"
    types = [to_arrow_type(queries.schema[query_col].dataType), to_arrow_type(vectors.schema[id_col].dataType)]
    asked, searched = queries.select(F.col(query_col).alias("q"), F.col(query_vec).alias("qv")), vectors.select(F.col(id_col).alias("i"), F.col(vec_col).alias("iv"))

    columns = [query_col, id_col, "score"]

    n, values = asked.agg(F.count("*"), F.sum(F.size("qv"))).first()
    if (values or 0) <= FEW_VALUES:
        rows = asked.collect()
        shared = vectors.sparkSession.sparkContext.broadcast(([r.q for r in rows], np.array([r.qv for r in rows], float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            near = [_Near(names[at : at + QUERY_BLOCK], q[at : at + QUERY_BLOCK], k, digits) for at in range(0, len(names), QUERY_BLOCK)]
            for b in batches:
                _meet(near, b.column(0), b.column(1), read or _vectors)
            yield from (x.best.batch(*types, columns) for x in near)

        found = searched.mapInArrow(run, schema)
    else:
        blocks, tiles = -(-n // QUERY_BLOCK), max(1, -(-searched.count() // TILE_ROWS))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = searched.withColumn("tile", F.pmod(F.xxhash64("i", "iv"), F.lit(tiles)).cast("int")).withColumn("block", every(blocks))
        right = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("tile", every(tiles))

        def cell(vs: pa.Table, qs: pa.Table) -> pa.Table:
            if not vs.num_rows or not qs.num_rows:
                return pa.Table.from_batches([Best([], k, digits).batch(*types, columns)])
            near = _Near(qs.column("q").to_pylist(), _vectors(qs.column("qv")), k, digits)
            _meet([near], vs.column("i").combine_chunks(), vs.column("iv").combine_chunks(), read or _vectors)
            return pa.Table.from_batches([near.best.batch(*types, columns)])

        found = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(cell, schema)
    # distance ascending: NaN is the greatest and so the last
    w = Window.partitionBy(query_col).orderBy((1 - F.col("score")).asc(), F.col(id_col).asc())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(chunked: DataFrame, questions: DataFrame, model, k: int, counts: bool = False, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) as top_k finds them for texts that have no vectors yet: chunks (chunk_id, text) and questions
    (query_id, text). A chunk is embedded in the worker that searches it, so that its vector never leaves that."""
    def read(texts) -> np.ndarray:
        return embedded(model, texts.to_pylist(), counts).astype(float)

    return top_k(chunked, embed(questions, model, "query_id", counts=counts), k, vec_col="text", digits=digits, read=read)


def _meet(near: list[_Near], ids, vectors, read=_vectors) -> None:
    """All vectors against all queries, in pieces of a bounded number of scores."""
    step = max(1, CELLS // max((len(x.q) for x in near), default=1))
    for at in range(0, len(ids), step):
        names, v = ids[at : at + step], read(vectors[at : at + step])
        for x in near:
            x.add(names, v)


def search_vector(chunked: DataFrame, embeddings: DataFrame, query: list[float], strategy: str, model: str, k: int, fresh_only: bool = False, digits: int | None = None) -> DataFrame:
    """One query vector: (chunk_id, doc_id, score, text) best first. Nothing for an unknown strategy or model. Vectors
    of changed chunks count unless fresh_only. With digits, distances are rounded before ranking."""
    e = embeddings.where((F.col("strategy") == strategy) & (F.col("model") == model))
    q = F.array(*[F.lit(float(x)) for x in query])
    keys = ["strategy", "chunk_id"] + ["text_hash"] * fresh_only
    ranked = e.join(chunked.where(F.col("strategy") == strategy).select(*keys), keys, "left_semi").select("chunk_id", cosine_distance(F.col("embedding"), q).alias("distance"))
    if digits is not None:
        ranked = ranked.withColumn("distance", F.round("distance", digits))
    best = ranked.orderBy("distance", "chunk_id").limit(k)  # ids first; the wide text is joined to k rows
    text = chunked.where(F.col("strategy") == strategy).select("chunk_id", "doc_id", "text")
    return F.broadcast(best).join(text, "chunk_id").select("chunk_id", "doc_id", (1 - F.col("distance")).alias("score"), "text").orderBy((1 - F.col("score")).asc(), "chunk_id")


class DenseRetriever:
    """Embeds questions and searches the vectors of one strategy and model. With a store, questions too are embedded once:
    their vectors are kept in its cache."""

    def __init__(self, chunked: DataFrame, embeddings: DataFrame, model, strategy: str, store=None):
        self.store = store
        self.chunked, self.model = chunked.where(F.col("strategy") == strategy), model
        self.vectors = embeddings.where((F.col("strategy") == strategy) & (F.col("model") == model.name)).join(self.chunked.select("chunk_id"), "chunk_id", "left_semi")

    def hits(self, questions: DataFrame, k: int, digits: int | None = None) -> DataFrame:
        from corpusloom.operators.index import vectors_of

        asked = embed(questions, self.model, "query_id") if self.store is None else vectors_of(self.store, questions, self.model, "query_id")
        return top_k(self.vectors, asked, k, digits=digits)

    def search(self, questions: DataFrame, k: int, digits: int | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, doc_id, score, text) for questions (query_id, text)."""
        hits = self.hits(questions, k, digits)
        return hits.join(self.chunked.select("chunk_id", "doc_id", "text"), "chunk_id").select("query_id", "rank", "chunk_id", "doc_id", "score", "text")


def retriever(config, chunked: DataFrame, embeddings: DataFrame, model, text_index: tuple[DataFrame, DataFrame] | None = None, store=None):
    """The retriever that a configuration asks for: dense, sparse or hybrid; there are no rerankers. text_index: stored
    postings and lengths, which are else made from the chunks. store: whose cache keeps the questions' vectors."""
    from corpusloom.operators.fulltext import HybridRetriever, SparseRetriever

    if config.rerank is not None:
        raise NotImplementedError(f"reranker {config.rerank!r}")
    if config.retrieval == "dense":
        return DenseRetriever(chunked, embeddings, model, config.chunking, store)
    if config.retrieval not in ("sparse", "hybrid"):
        raise ValueError(f"unknown retrieval {config.retrieval!r}; known: dense, sparse, hybrid")
    sparse = SparseRetriever(chunked.where(F.col("strategy") == config.chunking), *(text_index or ()))
    return sparse if config.retrieval == "sparse" else HybridRetriever(DenseRetriever(chunked, embeddings, model, config.chunking, store), sparse)


def render(hits: DataFrame, width: int = 160) -> DataFrame:
    """Rank, id, score with four decimals and a snippet on one line."""
    line = F.concat(F.col("rank").cast("string"), F.lit("  "), F.format_string("%.4f", "score"), F.lit("  "), F.col("chunk_id"), F.lit("  "), F.substring(squeeze(F.col("text")), 1, width))
    return hits.select("query_id", "rank", line.alias("line"))


#: Words without weight in full-text search (fixed values).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def terms(text):
    """Distinct lower-case words without stop words. No stemming: an approximation of a stemmed text index."""
    return F.array_distinct(F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS)))


def contains_all(df: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Rows whose terms include every word."""
    wanted = F.array(*[F.lit(w.lower()) for w in words])
    return df.where(F.size(F.array_except(wanted, terms(F.col(text)))) == 0)
