"""The jobs: growing input, runs again, failures in between, odd rows, and their SQL."""

import json
import logging
import os
import subprocess
import sys

import duckdb
import pytest

from corpusloom.operators import embed
from jobs import known_items, queries, refresh_index
from jobs.common import settings

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string"
LONG = "".join(f"line {i} of the text. " for i in range(60))


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def state(spark, out):
    return sorted((r.doc_id, r.n, r.text, r.lang, len(r.embedding)) for r in refresh_index.current(spark, str(out)).collect())


def folders(out, table):
    return sorted(x for x in os.listdir(f"{out}/{table}") if x.startswith("batch=") and x != "batch=-1")


def test_two_runs_over_growing_input(spark, tmp_path, caplog, monkeypatch):
    class Counting(embed.Hash64):
        name = "counting"

    monkeypatch.setitem(embed.EMBEDDERS, "counting", Counting)
    source, out, how = tmp_path / "in", tmp_path / "out", {"embedding": "counting"}
    add(spark, source, [(1, LONG, "en"), (2, "alpha", "de"), (3, "alpha", None), (4, None, "en"), (5, "", " "), (None, "no id", "en")])
    with caplog.at_level(logging.INFO):
        first = refresh_index.refresh(spark, str(source), str(out), how)
    assert "read 6 rows" in caplog.text and "1 of them without id" in caplog.text
    assert first == {"batches": 1, "documents": 5, "chunks": 5, "vectors": 4}  # three chunks of 1; 2 and 3 share a text
    assert {(d, lang) for d, _, _, lang, _ in state(spark, out)} == {("1", "en"), ("2", "de"), ("3", "und")}
    before = state(spark, out)
    assert refresh_index.refresh(spark, str(source), str(out), how)["batches"] == 0 and state(spark, out) == before  # nothing new
    # a new document with a known text, a changed one, one that goes, one that stays
    add(spark, source, [(6, "alpha", "fr"), (1, "beta", "en"), (2, None, "de")])
    second = refresh_index.refresh(spark, str(source), str(out), how)
    assert second == {"batches": 1, "documents": 3, "chunks": 2, "vectors": 1}  # "alpha" isn't embedded again
    assert [(d, t) for d, _, t, _, _ in state(spark, out)] == [("1", "beta"), ("3", "alpha"), ("6", "alpha")]
    assert folders(out, "chunks") == folders(out, "vectors") == ["batch=0", "batch=1"]


def test_same_state_as_one_run_over_everything(spark, tmp_path):
    parts = [[(i, f"text {i % 7} " * 90, "en") for i in range(j * 10, j * 10 + 15)] for j in range(3)]
    for p in parts:
        add(spark, tmp_path / "in", p)
        refresh_index.refresh(spark, str(tmp_path / "in"), str(tmp_path / "grown"))
    refresh_index.refresh(spark, str(tmp_path / "in"), str(tmp_path / "once"))
    assert state(spark, tmp_path / "grown") == state(spark, tmp_path / "once")
    small = {"files_per_batch": 1}
    assert refresh_index.refresh(spark, str(tmp_path / "in"), str(tmp_path / "small"), small)["batches"] >= 3
    assert state(spark, tmp_path / "small") == state(spark, tmp_path / "once")


@pytest.mark.parametrize("at", [1, 2, 3])
def test_a_run_that_fails_is_made_good_by_the_next(spark, tmp_path, monkeypatch, at):
    source, out = tmp_path / "in", tmp_path / "out"
    add(spark, source, [(1, LONG, "en"), (2, "alpha", "de")])
    whole, calls = refresh_index.write, []

    def fails(*args):
        calls.append(args)
        if len(calls) == at:
            raise OSError("gone")
        return whole(*args)

    with monkeypatch.context() as m:
        m.setattr(refresh_index, "write", fails)
        with pytest.raises(Exception, match="gone"):
            refresh_index.refresh(spark, str(source), str(out))
    add(spark, source, [(3, "gamma", "de")])
    refresh_index.refresh(spark, str(source), str(out))
    assert [(d, n) for d, n, _, _, _ in state(spark, out)] == [("1", 0), ("1", 1), ("1", 2), ("2", 0), ("3", 0)]
    vectors = spark.read.schema(refresh_index.VECTORS).parquet(f"{out}/vectors")
    assert vectors.count() == vectors.select("text_hash").distinct().count() == 5


def test_newest_version_within_a_batch(spark):
    rows = [("a", "old", "en", 1), ("a", "new", "de", 2), ("b", "x", "en", 1), ("b", "y", "en", 1), ("c", None, "en", 3), ("c", "was", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, written int")
    for frame in (df, df.orderBy("text"), df.repartition(3)):
        assert sorted((r.doc_id, r.text, r.lang) for r in refresh_index.newest(frame).collect()) == [("a", "new", "de"), ("b", "y", "en"), ("c", None, "en")]


def test_empty_input(spark, tmp_path):
    add(spark, tmp_path / "in", [])
    refresh_index.refresh(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert state(spark, tmp_path / "out") == []


def questions(spark, path, rows):
    spark.createDataFrame(rows, "item_id bigint, text string").write.parquet(str(path))


def test_known_items(spark, tmp_path, caplog):
    passage = "the quick brown fox jumps over the lazy dog near the old river bank"
    add(spark, tmp_path / "docs", [(1, f"Before it. {passage.upper()} and after.", "en"), (2, "nothing of that kind stands here at all", "de"), (3, "", None), (None, passage, "en"), (4, None, "fr")])
    questions(spark, tmp_path / "q", [(1, passage), (2, "seven words are too few for one"), (3, None), (4, "")])
    how = {"run": "r1", "top_k": 2}
    with caplog.at_level(logging.INFO):
        rows = known_items.evaluate(spark, str(tmp_path / "docs"), str(tmp_path / "q"), str(tmp_path / "out"), how)
    assert rows["scores"] == 3 and rows["hits"] == 6 and "wrote" in caplog.text
    read = lambda: {r.query_id: (r.n_relevant, r.recall, r.mrr, r.best) for r in spark.read.parquet(str(tmp_path / "out" / "scores")).collect()}
    got = read()
    assert got[1] == (1, 1.0, 1.0, "1#c0") and got[2][:3] == (0, None, None) and got[4][:3] == (0, None, None)
    report = {r.best_lang: (r.scored, r.skipped) for r in spark.read.parquet(str(tmp_path / "out" / "report" / "run=r1")).collect()}
    assert report["all"] == (1, 2)
    # another run's folders stay; the same run again replaces its own, with languages that no hit has any more
    known_items.evaluate(spark, str(tmp_path / "docs"), str(tmp_path / "q"), str(tmp_path / "out"), how | {"run": "r2"})
    known_items.evaluate(spark, str(tmp_path / "docs"), str(tmp_path / "q"), str(tmp_path / "out"), how)
    assert read() == got and spark.read.parquet(str(tmp_path / "out" / "scores")).count() == 6
    known_items.evaluate(spark, str(tmp_path / "docs"), str(tmp_path / "q"), str(tmp_path / "out"), how | {"top_k": 1})
    assert spark.read.parquet(str(tmp_path / "out" / "hits" / "run=r1")).count() == 3


def test_a_shuffle_gives_the_same_labels(spark, monkeypatch):
    q = spark.createDataFrame([(1, "a b c d"), (2, "x y z")], "query_id int, text string")
    c = spark.createDataFrame([("1#c0", "o A b, c p"), ("2#c0", "x y z x y z"), ("3#c0", "c d")], "chunk_id string, text string")
    want = {(1, "1#c0"), (2, "2#c0")}
    assert {tuple(r) for r in known_items.relevant(q, c, 3).collect()} == want
    monkeypatch.setattr(known_items, "FEW_WINDOWS", 0)
    assert {tuple(r) for r in known_items.relevant(q, c, 3).collect()} == want


def test_settings(spark, tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
    for job in (refresh_index, known_items):
        assert settings(spark, f"{here}/jobs/{job.__name__.split('.')[1]}.json", job.DEFAULTS) == job.DEFAULTS
    (tmp_path / "bad.json").write_text(json.dumps({"topk": 3}))
    with pytest.raises(ValueError, match="topk"):
        settings(spark, str(tmp_path / "bad.json"), known_items.DEFAULTS)


def test_command_line(spark, tmp_path):
    add(spark, tmp_path / "in", [(1, "alpha", "en")])
    here = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
    env = os.environ | {"PYTHONPATH": here, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    call = [sys.executable, "-m", "jobs.refresh_index", "--source", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--config", f"{here}/jobs/refresh_index.json"]
    run = subprocess.run(call, cwd=here, env=env, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0 and "done: {'batches': 1, 'documents': 1, 'chunks': 1, 'vectors': 1}" in run.stderr
    assert [x[:3] for x in state(spark, tmp_path / "out")] == [("1", 0, "alpha")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLES[name])
    names = [x[0] for x in want.description]
    show = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
    assert sorted(show([r[c] for c in names]) for r in df.collect()) == sorted(map(show, want.fetchall()))


def test_shared_windows_are_found_once_a_run(spark, tmp_path, monkeypatch):
    """hits, totals and scores of a run use the same pairs, which are let go at its end."""
    spark.createDataFrame([(i, f"w{i} a b c d e f g h {i}", "en") for i in range(20)], "doc_id int, text string, lang string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, "w1 a b c d e f g h"), (2, "nothing of it")], "item_id int, text string").write.parquet(str(tmp_path / "q"))
    seen, found, kept = spark.sparkContext.accumulator(0), known_items.relevant, []

    def counted(questions, chunks, size):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        kept.append(found(questions, chunks, size).mapInArrow(count, "query_id int, chunk_id string"))
        return kept[-1]

    monkeypatch.setattr(known_items, "relevant", counted)
    known_items.evaluate(spark, str(tmp_path / "docs"), str(tmp_path / "q"), str(tmp_path / "out"))
    assert seen.value == 20 and not kept[0].is_cached
    assert {r.query_id: r.n_relevant for r in spark.read.parquet(str(tmp_path / "out/scores")).collect()} == {1: 20, 2: 0}
