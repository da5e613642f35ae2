import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import balls, search


def frame(spark, v, id_kind="int", name="chunk_id", parts=3):
    rows = [(f"v{i}" if id_kind == "string" else i, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, f"{name} {id_kind}, embedding array<double>").repartition(parts)


def both(spark, path, v, q, k, pivots, digits=None, id_kind="int"):
    """What the balls and the full search find, and how many vectors were met of how many."""
    df, qs = frame(spark, v, id_kind), frame(spark, q, name="query_id")
    hits, met = balls.build(df, path, pivots).search(qs, k, digits)
    show = lambda rows, c: sorted((r.query_id, r["rank"], r[c], repr(r.score) if r.score != r.score else round(r.score, 9)) for r in rows)
    return show(hits.collect(), "id"), show(search.top_k(df, qs, k, digits=digits).collect(), "chunk_id"), {r.query_id: (r.met, r.of) for r in met.collect()}


@pytest.mark.parametrize(("pivots", "k", "id_kind"), [(1, 3, "int"), (9, 7, "string"), (64, 1, "int")])
def test_equals_the_full_search_with_ties_and_zero_vectors(spark, tmp_path, pivots, k, id_kind):
    rng = np.random.default_rng(5)
    v, q = rng.integers(-2, 3, (250, 3)), rng.integers(-2, 3, (12, 3))
    q[4] = 0
    got, want, met = both(spark, str(tmp_path), v, q, k, pivots, 9, id_kind)
    assert got == want and len(got) == 12 * k
    assert met[4] == (250, 250)  # a query without direction meets everything


def test_clustered_vectors_are_passed_over(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    v = (centres[:, None] + rng.normal(scale=0.05, size=(20, 30, 16))).reshape(-1, 16)
    q = centres + rng.normal(scale=0.05, size=(20, 16))
    got, want, met = both(spark, str(tmp_path), v, q, 5, 20)
    assert got == want
    assert sum(m for m, _ in met.values()) <= 0.2 * sum(n for _, n in met.values())


def test_one_ball_may_hold_all(spark, tmp_path):
    v = np.tile([[1.0, 2.0]], (80, 1))  # equal vectors: one pivot, ties by id
    got, want, met = both(spark, str(tmp_path), v, [[1.0, 2.0], [-1.0, 0.0]], 4, 8)
    assert got == want and [g[2] for g in got[:4]] == [0, 1, 2, 3] and met == {0: (80, 80), 1: (80, 80)}


def test_fewer_vectors_than_k_and_vectors_without_direction(spark, tmp_path):
    df = frame(spark, [[1, 0], None, [0, 0], [], [0, 1]])
    qs = frame(spark, [[2, 1], [0, 0]], name="query_id")
    hits, met = balls.build(df, str(tmp_path), 4).search(qs, 4)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {0: [0, 4, 1, 2], 1: [0, 1, 2, 3]} and {r.met for r in met.collect()} == {5}


def test_empty_sides_and_wrong_arguments(spark, tmp_path, monkeypatch):
    df, qs = frame(spark, [[1, 0], [0, 1]]), frame(spark, [[1, 1]], name="query_id")
    none = balls.build(df.where("false"), str(tmp_path / "none"))
    assert none.search(qs, 2)[0].count() == 0 and none.search(qs, 2)[1].collect() == [(0, 0, 0)]
    some = balls.build(df, str(tmp_path / "some"))
    assert [x.count() for x in some.search(qs.where("false"), 2)] == [0, 0]
    assert balls.Balls(spark, str(tmp_path / "some")).search(qs, 1)[0].select("id").collect() == [(0,)]
    for k in (0, -1):
        with pytest.raises(ValueError):
            some.search(qs, k)
    for n in (0, balls.PIVOTS + 1):
        with pytest.raises(ValueError):
            balls.build(df, str(tmp_path / "x"), n)
    monkeypatch.setattr(search, "FEW_VALUES", 1)
    with pytest.raises(ValueError):
        some.search(qs, 1)


def test_only_the_folders_of_reached_balls_are_read(spark, tmp_path):
    rng = np.random.default_rng(7)
    centres = np.eye(6)
    v = (centres[:, None] + rng.normal(scale=0.01, size=(6, 20, 6))).reshape(-1, 6)
    stored = balls.build(frame(spark, v), str(tmp_path), 6)
    hits, met = stored.search(frame(spark, [centres[2]], name="query_id"), 3)
    assert met.first().met == 20
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ball" in plan or "PartitionFilters: [(ball" in plan or "PartitionFilters: [ball" in plan
    assert {r.ball for r in stored.vectors.where(F.col("id").isin([r.id for r in hits.collect()])).select("ball").collect()} <= set(stored.ball)
