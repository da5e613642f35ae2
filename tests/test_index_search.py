import math

import pytest
from pyspark.sql import functions as F

from corpusloom.config import RunConfig
from corpusloom.operators import index, search
from corpusloom.operators.embed import Hash64, embed
from corpusloom.streaming import reindex


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def test_incremental_index(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"))
    long = "".join(f"line {i} of the text.\n" for i in range(60))
    s = index.index_corpus(store, docs(spark, a="alpha", b=long))
    assert (s.docs, s.chunks, s.written, s.deleted, s.embedded) == (2, 4, 4, 0, 4)
    s = index.index_corpus(store, docs(spark, a="alpha", b=long))
    assert (s.written, s.deleted, s.embedded) == (0, 0, 0)
    s = index.index_corpus(store, docs(spark, a="beta", b=long[:500]))
    assert (s.written, s.deleted, s.embedded) == (2, 2, 2)
    chunked, vectors = store.read()
    assert chunked.count() == vectors.count() == 2
    s = index.index_corpus(store, docs(spark, a="beta").where("false"))
    assert s.deleted == 2
    assert store.read()[1].count() == 0


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"), buckets=8)
    texts = {f"d{i}": f"text {i}" for i in range(40)}
    index.index_corpus(store, docs(spark, **texts))
    before = store.state().folders["chunks"]
    index.index_corpus(store, docs(spark, **(texts | {"d7": "changed"})))
    after = store.state().folders["chunks"]
    assert len(before) == 8 and sum(before[f] != after[f] for f in before) == 1
    store.compact()
    assert len(set(store.state().folders["chunks"].values())) == 1
    assert {r.doc_id: r.text for r in store.read()[0].collect()} == texts | {"d7": "changed"}
    assert store.read()[1].count() == 40


def test_other_models_and_strategies_stay(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"))

    class Other(Hash64):
        name = "other"

    d = docs(spark, a="alpha", b="beta")
    index.index_corpus(store, d)
    index.index_corpus(store, d, model=Other())
    assert {(r.model, r["count"]) for r in store.read()[1].groupBy("model").count().collect()} == {("hash64", 2), ("other", 2)}
    index.index_corpus(store, docs(spark, a="alpha"))
    assert store.read()[1].count() == 2  # of both models


def test_change_set_actions(spark):
    s = "strategy string, chunk_id string, text_hash string"
    old = spark.createDataFrame([("f", "a", "1"), ("f", "b", "1"), ("f", "c", "1")], s)
    new = spark.createDataFrame([("f", "a", "1"), ("f", "b", "2"), ("f", "d", "1")], s)
    assert {(r.chunk_id, r.action) for r in index.change_set(old, new).collect()} == {("a", "keep"), ("b", "update"), ("c", "delete"), ("d", "insert")}


def test_search_finds_exact_text_first(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"))
    index.index_corpus(store, docs(spark, a="the lock waits", b="rows and pages", c="", d="…"))
    chunked, vectors = store.read()
    r = search.retriever(RunConfig("t"), chunked, vectors, Hash64())
    q = spark.createDataFrame([("q1", "rows and pages"), ("q2", "…")], "query_id string, text string")
    hits = r.search(q, 5).orderBy("query_id", "rank").collect()
    assert hits[0].chunk_id == "b#c0" and abs(hits[0].score - 1) < 1e-5
    assert [h.chunk_id for h in hits if h.query_id == "q2"] == ["a#c0", "b#c0", "d#c0"]  # all NaN: by id
    one = search.search_vector(chunked, vectors, Hash64().embed(["rows and pages"])[0].tolist(), "fixed512", "hash64", 2).collect()
    assert [h.chunk_id for h in one][0] == "b#c0" and len(one) == 2
    assert search.search_vector(chunked, vectors, [1.0] * 64, "fixed512", "nope", 2).count() == 0
    assert search.search_vector(chunked, vectors, [1.0] * 64, "nope", "hash64", 2).count() == 0


def test_top_k_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties and some zero vectors
    rows = [(f"v{i}", x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(5)
    qs = spark.createDataFrame([(i, v[i].tolist()) for i in range(10)], "query_id int, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in search.top_k(df, qs, 7, digits=9).collect()}
    for q in range(10):
        def key(i, q=q):
            n = math.sqrt((v[i] @ v[i]) * (v[q] @ v[q]))
            return (math.inf if n == 0 else -round(v[i] @ v[q] / n, 9), f"v{i}")
        assert [got[q, r] for r in range(1, 8)] == [f"v{i}" for i in sorted(range(300), key=key)[:7]]
    with pytest.raises(ValueError):
        search.top_k(df, qs, 0)


@pytest.mark.parametrize(("block", "few", "cells"), [(1, 1000, 7), (4, 1000, 4_000_000), (5, 0, 4_000_000), (1, 0, 3), (100, 0, 50)])
def test_blocks_of_queries_lose_none(spark, monkeypatch, block, few, cells):
    import numpy as np

    for name, value in (("QUERY_BLOCK", block), ("FEW_VALUES", few), ("CELLS", cells), ("TILE_ROWS", 25)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(60, 3)), rng.normal(size=(11, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id int, embedding array<double>").repartition(3)
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, embedding array<double>").repartition(2)
    got = {}
    for r in search.top_k(df, qs, 2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
    near = (v @ q.T) / np.sqrt((v * v).sum(1))[:, None]
    assert got == {i: {1 + j: int(x) for j, x in enumerate(np.argsort(-near[:, i])[:2])} for i in range(11)}
    assert search.top_k(df, qs.where("false"), 2).count() == search.top_k(df.where("false"), qs, 2).count() == 0


def test_ten_thousand_queries_read_the_vectors_once(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "FEW_VALUES", 1000)
    rng = np.random.default_rng(4)
    v, q = rng.integers(-3, 4, (300, 4)).astype(float), rng.integers(-3, 4, (10_000, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id int, embedding array<double>")
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, embedding array<double>")
    got = np.full((10_000, 3), -1)
    for r in search.top_k(df, qs, 3, digits=9).collect():
        got[r.query_id, r["rank"] - 1] = r.chunk_id
    with np.errstate(invalid="ignore", divide="ignore"):
        near = np.round((q @ v.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((v * v).sum(1)), 9)
    order = np.lexsort((np.broadcast_to(np.arange(300), near.shape), np.where(np.isnan(near), np.inf, -near)), axis=1)[:, :3]
    assert (got == order).all()


def test_a_run_that_fails_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = index.Store(spark, str(tmp_path / "store"))
    index.index_corpus(store, docs(spark, a="alpha", b="beta"))

    def crash(*_):
        raise OSError("gone")

    for step in ("_point_to", "_folders"):
        with monkeypatch.context() as m:
            m.setattr(store, step, crash)
            with pytest.raises(OSError):
                index.index_corpus(store, docs(spark, a="changed", c="new"))
        again = index.Store(spark, str(tmp_path / "store"))
        assert {r.doc_id: r.text for r in again.read()[0].collect()} == {"a": "alpha", "b": "beta"} and again.read()[1].count() == 2
    assert not store._point_to({"chunks": {}, "embeddings": {}}, 1)  # the name is taken
    index.index_corpus(store, docs(spark, a="changed", c="new"))
    assert {r.doc_id: r.text for r in store.read()[0].collect()} == {"a": "changed", "c": "new"}
    assert store.vacuum(keep=1) >= 2 and store._listed("state-") == ["state-000000000002"]
    assert {r.doc_id: r.text for r in store.read()[0].collect()} == {"a": "changed", "c": "new"} and store.read()[1].count() == 2


def test_a_run_overtaken_by_another_loses_nothing(spark, tmp_path, monkeypatch):
    """A second run, whole, inside the first one's: in the same bucket the first begins anew, in another it keeps both."""
    texts = {f"d{i}": f"text {i}" for i in range(20)}
    for name, buckets in (("same", 1), ("other", 64)):
        store = index.Store(spark, str(tmp_path / name), buckets)
        index.index_corpus(store, docs(spark, **texts))
        whole, runs = index.Store.write, []

        def overtaken(self, *args, whole=whole, runs=runs, **kw):
            runs.append(1)
            if len(runs) == 1:
                monkeypatch.setattr(index.Store, "write", whole)
                index.index_corpus(index.Store(spark, self.root), docs(spark, new2="from the second"), partial=True)
                monkeypatch.setattr(index.Store, "write", overtaken)
            whole(self, *args, **kw)

        with monkeypatch.context() as m:
            m.setattr(index.Store, "write", overtaken)
            index.index_corpus(store, docs(spark, d3="changed", new1="from the first"), partial=True)
            monkeypatch.setattr(index.Store, "write", whole)
        assert len(runs) == (2 if name == "same" else 1)
        want = texts | {"d3": "changed", "new1": "from the first", "new2": "from the second"}
        chunked, vectors = store.read()
        assert {r.doc_id: r.text for r in chunked.collect()} == want and chunked.count() == vectors.count() == 22


def test_conflicts_that_never_end_are_an_error(spark, tmp_path, monkeypatch):
    tries = []

    def beaten(*_):
        tries.append(1)
        raise index.Conflict("always")

    monkeypatch.setattr(index, "_index_once", beaten)
    with pytest.raises(index.Conflict):
        index.index_corpus(index.Store(spark, str(tmp_path / "store")), docs(spark, a="beta"))
    assert len(tries) == index.ATTEMPTS


def test_a_store_keeps_its_bucket_count(spark, tmp_path):
    root = str(tmp_path / "store")
    texts = {f"d{i}": f"text {i} " * 100 for i in range(30)}
    index.index_corpus(index.Store(spark, root, buckets=8), docs(spark, **texts))
    again = index.Store(spark, root)  # with the default count
    changed = texts | {"d1": "one", "d2": "two", "d3": "three"}
    index.index_corpus(again, docs(spark, **changed))
    chunked, vectors = again.read()
    assert again.buckets == 8 and chunked.count() == chunked.select("chunk_id").distinct().count() == vectors.count()
    assert {r.doc_id for r in chunked.collect()} == set(texts) and {r.text for r in chunked.where("doc_id IN ('d1', 'd2', 'd3')").collect()} == {"one", "two", "three"}
    before = sorted(map(tuple, chunked.drop("bucket").collect()))
    again.compact(buckets=32)  # a store that has grown
    assert index.Store(spark, root).buckets == 32 and sorted(map(tuple, again.read()[0].drop("bucket").collect())) == before
    index.index_corpus(index.Store(spark, root, buckets=8), docs(spark, **(changed | {"d1": "uno"})))
    assert again.read()[0].count() == len(before) == again.read()[1].count()


def test_cache_reads_only_the_folders_of_its_keys(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"))
    index.index_corpus(store, docs(spark, **{f"d{i}": f"text {i}" for i in range(300)}))
    keys = store.read()[0].limit(3).select(F.col("text_hash").alias("key")).distinct()
    found = store.cached("hash64", keys)
    wanted = {k.key[:2] for k in keys.collect()}
    read = {f.split("prefix=")[1][:2] for f in found.inputFiles() if "/cache/" in f}
    assert found.count() == 3 and len(wanted) <= 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and "prefix" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "BroadcastHashJoin" in plan
    assert wanted <= read
    # a key that two runs have added counts once
    store.add_to_cache(spark.createDataFrame(store.cached("hash64", keys).collect(), index.CACHE))
    assert store.cached("hash64", keys).count() == 3


def test_what_was_embedded_once_is_not_again(spark, tmp_path, monkeypatch):
    """Equal texts under another strategy, and a text that comes back, take their vectors from the cache."""
    from corpusloom.operators import chunk

    monkeypatch.setitem(chunk.STRATEGIES, "wide", chunk.FixedSize(900, 0))
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counting(Hash64):
        name = "counting"

        def embed(self, texts):
            import uuid

            if len(texts):
                (calls / uuid.uuid4().hex).write_text("\n".join(texts))
            return super().embed(texts)

    embedded = lambda: sorted(x for f in calls.iterdir() for x in f.read_text().split("\n"))
    store = index.Store(spark, str(tmp_path / "store"))
    d = docs(spark, a="alpha", b="beta", c="alpha")
    assert index.index_corpus(store, d, model=Counting()).embedded == 3
    assert embedded() == ["alpha", "beta"]  # distinct texts
    assert index.index_corpus(store, d, "wide", Counting()).embedded == 3
    index.index_corpus(store, docs(spark, a="alpha"), model=Counting())
    index.index_corpus(store, d, model=Counting())
    assert embedded() == ["alpha", "beta"]
    vectors = {(r.strategy, r.chunk_id): list(r.embedding) for r in store.read()[1].collect()}
    assert len(vectors) == 6 and vectors["wide", "b#c0"] == vectors["fixed512", "b#c0"] == pytest.approx(Hash64().embed(["beta"])[0].tolist())


def test_questions_are_embedded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counting(Hash64):
        name = "hash64"

        def embed(self, texts):
            import uuid

            if len(texts):
                (calls / uuid.uuid4().hex).write_text("\n".join(texts))
            return super().embed(texts)

    store = index.Store(spark, str(tmp_path / "store"))
    index.index_corpus(store, docs(spark, a="the lock waits", b="rows and pages"))
    r = search.retriever(RunConfig("t"), *store.read(), Counting(), store=store)
    q = spark.createDataFrame([("q1", "rows and pages"), ("q2", "new question"), ("q3", "new question")], "query_id string, text string")
    for _ in range(2):
        hits = {(h.query_id, h["rank"]): h.chunk_id for h in r.search(q, 1).collect()}
        assert hits["q1", 1] == "b#c0" and len(hits) == 3
    assert [f.read_text() for f in calls.iterdir()] == ["new question"]  # the other is a chunk's text


def test_one_version_of_a_document_in_a_batch(spark):
    rows = [("a", "old", 1), ("a", "new", 2), ("b", "x", 1), ("b", "y", 1), ("c", None, 1)]
    df = spark.createDataFrame(rows, f"doc_id string, text string, {reindex.WRITTEN} int")
    for frame in (df, df.orderBy("text"), df.repartition(3)):
        assert {r.doc_id: r.text for r in reindex.latest(frame).collect()} == {"a": "new", "b": "y", "c": None}


def test_not_implemented(spark):
    with pytest.raises(NotImplementedError):
        search.retriever(RunConfig("x", rerank="r"), None, None, Hash64())


def test_full_text(spark):
    d = docs(spark, a="SELECT ... FOR UPDATE NoWait", b="wait for it")
    assert [r.doc_id for r in search.contains_all(d, ["nowait"]).collect()] == ["a"]
    assert [r.doc_id for r in search.contains_all(d, ["nowait", "missing"]).collect()] == []


def test_stream_brings_store_up_to_date(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"))
    text = "".join(f"word{i} " for i in range(400))
    docs(spark, a=text, b="beta").write.parquet(str(tmp_path / "in"))
    run = lambda: reindex.start(reindex.stream_documents(spark, str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
    run()
    n = store.read()[0].count()
    docs(spark, b="gamma", c="delta").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    chunked, vectors = store.read()
    assert chunked.count() == vectors.count() == n + 1
    assert {r.doc_id: r.text for r in chunked.where("doc_id <> 'a'").collect()} == {"b": "gamma", "c": "delta"}
    assert {r.doc_id for r in chunked.select(F.col("doc_id")).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("few", [10**6, 0])
@pytest.mark.parametrize("counts", [True, False])
def test_nearest_embeds_where_it_searches(spark, monkeypatch, few, counts):
    """one Python worker a task embeds and searches; the hits are those of vectors that were made before."""
    monkeypatch.setattr(search, "FEW_VALUES", few)
    c = spark.createDataFrame([(f"d{i}#c0", f"w{i % 7} w{i % 5} x{i}" if i % 9 else "") for i in range(60)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "w1 w2"), (2, "x17 w3"), (3, "")], "query_id int, text string")
    got = search.nearest(c, q, Hash64(), 4, counts=counts, digits=6)
    made = search.top_k(embed(c, Hash64(), "chunk_id", counts=counts), embed(q, Hash64(), "query_id", counts=counts), 4, digits=6)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, made.collect())) and got.count() == 12
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") < made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") or not few


def test_remembered_tokens_are_bounded(monkeypatch):
    import numpy as np

    from corpusloom.operators import embed as module

    monkeypatch.setattr(module, "KNOWN", 5)
    model, texts = Hash64(), [" ".join(f"t{i + j}" for j in range(4)) for i in range(50)]
    assert (model.counts(texts) == np.concatenate([Hash64().counts([t]) for t in texts])).all() and len(model._cells) <= 5
