"""Exact cosine search that passes over vectors: they lie in balls around pivots, and a ball or a shell of it that can't
hold a better vector isn't met.

On unit vectors the distance d has d(a, b)^2 = 2 - 2 cos(a, b), so nearest by d is best by cosine, and by the triangle inequality
a vector v of pivot p is at least |d(q, p) - d(v, p)| from q.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from corpusloom.operators import search

#: Most pivots, vectors that they are chosen from, and room for the rounding of distances.
PIVOTS, SAMPLE, SLACK = 1024, 20_000, 1e-5
_LONG = LongType()
#: The ball of vectors without a direction: null, empty or zero.
NOWHERE = -1


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(1))[:, None]
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _spread(v: np.ndarray, n: int) -> np.ndarray:
    """n of the unit vectors, each the farthest from those before it; fewer if they repeat."""
    chosen, near = [0], _distance(v, v[:1])[:, 0]
    while len(chosen) < n and near.max() > SLACK:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distance(v, v[chosen[-1:]])[:, 0])
    return v[chosen]


def build(vectors: DataFrame, path: str, pivots: int = 64, id_col: str = "chunk_id", vec_col: str = "embedding") -> Balls:
    """Writes all vectors into balls below path, a folder that isn't there yet; what tells of the balls is written last. Pivots come from SAMPLE vectors at most, the first by hash, which decides only how
    much a search reads, never what it finds. A large ball is written by several tasks."""
    if not 1 <= pivots <= PIVOTS:
        raise ValueError(f"pivots must be from 1 to {PIVOTS}")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    has = F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    some = rows.where(has).orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).select("vec").collect()
    centres = _spread(_unit(np.array([r.vec for r in some], float)), pivots) if some else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centres)
    kind = to_arrow_type(rows.schema["id"].dataType)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ball, away = np.full(len(b), NOWHERE, np.int32), np.zeros(len(b))
            if len(shared.value):
                kept = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
                step = max(1, search.CELLS // len(shared.value))
                for at in range(0, len(kept), step):
                    part = kept[at : at + step]
                    d = _distance(_unit(search._vectors(b.column(1).take(pa.array(part)))), shared.value)
                    ball[part], away[part] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(kind), b.column(1), pa.array(ball), pa.array(away)], ["id", "vec", "ball", "away"])

    dealt = rows.withColumn("has", has).mapInArrow(near, f"id {rows.schema['id'].dataType.simpleString()}, vec array<double>, ball int, away double")
    dealt.hint("rebalance", F.col("ball")).sortWithinPartitions("ball", "away").write.partitionBy("ball").parquet(f"{path}/vectors")
    stored = spark.read.schema(dealt.schema).parquet(f"{path}/vectors")
    sizes = stored.groupBy("ball").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most"), F.min("id").alias("id"))
    centre = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(NOWHERE, [])], "ball int, centre array<double>")
    sizes.join(F.broadcast(centre), "ball").coalesce(1).write.parquet(f"{path}/balls")
    return Balls(spark, path)


class Balls:
    """Vectors as build() wrote them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        balls = spark.read.parquet(f"{path}/balls")
        self.kind = balls.schema["id"].dataType
        self.vectors = spark.read.schema(f"id {self.kind.simpleString()}, vec array<double>, away double, ball int").parquet(f"{path}/vectors")
        rows = balls.orderBy("ball").collect()  # at most PIVOTS and one more
        self.n = np.array([r.n for r in rows if r.ball != NOWHERE])
        self.ball = [r.ball for r in rows if r.ball != NOWHERE]
        self.least, self.most = (np.array([r[c] for r in rows if r.ball != NOWHERE]) for c in ("least", "most"))
        self.centre = np.array([r.centre for r in rows if r.ball != NOWHERE], float)
        self.nowhere = sum(r.n for r in rows if r.ball == NOWHERE)

    def _reached(self, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which query may find a vector within its limit in which ball."""
        d = _distance(q, self.centre)
        return np.maximum(d - self.most, self.least - d) <= limit[:, None]

    def _met(self, names: list, q: np.ndarray, pairs: np.ndarray, limit: np.ndarray, nowhere: np.ndarray, k: int, digits: int | None, kind) -> DataFrame:
        """(query_id, id, score): k best of each query in the balls of its pairs and, where it asks for them, among vectors without direction."""
        asked = {b: np.flatnonzero(pairs[:, i]) for i, b in enumerate(self.ball) if pairs[:, i].any()} | ({NOWHERE: np.flatnonzero(nowhere)} if nowhere.any() else {})
        away = {b: _distance(_unit(q[asked[b]]), self.centre[i : i + 1])[:, 0] for i, b in enumerate(self.ball) if b in asked}
        shared = self.spark.sparkContext.broadcast((names, q, asked, away, limit))
        types, schema = [to_arrow_type(kind), to_arrow_type(self.kind)], f"query_id {kind.simpleString()}, id {self.kind.simpleString()}, score double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, asked, away, limit = shared.value
            near: dict[int, search._Near] = {}
            for b in batches:
                balls, far = b.column(2).to_numpy(), b.column(3).to_numpy()
                for one in np.unique(balls):
                    who = asked[one]
                    if one not in near:
                        near[one] = search._Near([names[i] for i in who], q[who], k, digits)
                    rows = np.flatnonzero(balls == one)
                    if one != NOWHERE:  # the shell that some query of this ball reaches
                        rows = rows[(far[rows] >= (away[one] - limit[who]).min()) & (far[rows] <= (away[one] + limit[who]).max())]
                        search._meet([near[one]], b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)))
                    else:  # no score; the smallest ids count
                        near[one].add(b.column(0).take(pa.array(rows)), np.zeros((len(rows), q.shape[1])))
            yield from (x.best.batch(*types, ["query_id", "id", "score"]) for x in near.values())

        return self.vectors.where(F.col("ball").isin(list(asked))).select("id", "vec", "ball", "away").mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
        """((query_id, id, score, rank), (query_id, met, of)): what search.top_k finds for queries (query_id, embedding), and how many vectors lie
        in the balls that each query met, of how many. Ties go to the smaller id; vectors without direction come last, with NaN as score.

        The balls nearest to a query that hold k vectors give a first k-th score; balls that it rules out aren't read. Queries are told
        apart on the driver, so they must be few (search.FEW_VALUES numbers); for more, search.top_k reads the vectors once. Queries without
        direction meet everything.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        kind = queries.schema["query_id"].dataType
        values = queries.agg(F.sum(F.size("embedding"))).first()[0] or 0
        if values > search.FEW_VALUES:
            raise ValueError(f"{values} numbers in queries; search.top_k takes more than {search.FEW_VALUES}")
        rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("e")).collect()
        of = int(self.n.sum() + self.nowhere)
        if not rows or not of:
            empty = self.spark.createDataFrame([], f"query_id {kind.simpleString()}, id {self.kind.simpleString()}, score double, rank int")
            return empty, self.spark.createDataFrame([(r.query_id, 0, of) for r in rows], f"query_id {kind.simpleString()}, met long, of long")
        names, q = [r.query_id for r in rows], np.array([r.e for r in rows], float)
        aimless = ~q.any(1)
        limit, short = np.full(len(q), np.inf), np.full(len(q), self.n.sum() < k)
        if len(self.ball):
            order = np.argsort(_distance(_unit(q), self.centre), axis=1)
            before = np.cumsum(self.n[order], axis=1) - self.n[order]
            first = np.zeros((len(q), len(self.ball)), bool)
            np.put_along_axis(first, order, before < k, axis=1)
            first[aimless | short] = False
            if first.any():
                spots = self._met(list(range(len(q))), q, first, limit, np.zeros(len(q), bool), k, digits, _LONG)
                w = Window.partitionBy("query_id").orderBy(F.desc("score"))
                for r in spots.withColumn("at", F.row_number().over(w)).where(F.col("at") == k).collect():  # one a query
                    least = r.score - (10.0**-digits if digits is not None else 0.0)
                    limit[r.query_id] = np.sqrt(max(0.0, 2.0 - 2.0 * least)) + SLACK
            pairs = self._reached(_unit(q), limit)
            pairs[aimless] = True
        else:
            pairs = np.zeros((len(q), 0), bool)
        nowhere = (aimless | short) & bool(self.nowhere)
        found = self._met(names, q, pairs, limit, nowhere, k, digits, kind)
        w = Window.partitionBy("query_id").orderBy((1 - F.col("score")).asc(), "id")  # NaN is the greatest and so the last
        met = pairs @ self.n + nowhere * self.nowhere if len(self.ball) else nowhere * self.nowhere
        read = self.spark.createDataFrame([(n, int(m), of) for n, m in zip(names, met, strict=True)], f"query_id {kind.simpleString()}, met long, of long")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), read
