import json

import pytest
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.operators import golden, metrics, prompt
from corpusloom.plans import evaluate
from corpusloom.sources import files, records


def entries(spark, *rows):
    return spark.createDataFrame([(i, q, a, ids, d) for i, q, a, ids, d in rows], golden.SCHEMA)


def chunked(spark, *ids):
    return spark.createDataFrame([(i, "h" + i) for i in ids], "chunk_id string, text_hash string")


@pytest.mark.parametrize(("rows", "rule"), [
    ([("a", "q", "x", ["d#c0"], "single-hop"), ("a", "r", "x", ["d#c0"], "single-hop")], "duplicate id"),
    ([("a", "Q  one", "x", ["d#c0"], "single-hop"), ("b", " q ONE ", "x", ["d#c0"], "single-hop")], "duplicate question"),
    ([("a", " ", "x", ["d#c0"], "single-hop")], "empty question"),
    ([("a", "q", "", ["d#c0"], "single-hop")], "empty answer"),
    ([("a", "q", "x", ["d#c0"], "hard")], "unknown difficulty"),
    ([("a", "q", "x", ["d#c0"], "unanswerable")], "unanswerable with chunks"),
    ([("a", "q", "x", [], "multi-hop")], "no chunks"),
    ([("a", "q", "x", ["d#c0", "d#c0"], "multi-hop")], "repeated chunk"),
    ([("a", "q", "x", ["e#c0"], "multi-hop")], "unknown chunk"),
    ([("a", "q", "x", ["d#c0"], "single-hop"), ("b", "r", "x", [], "unanswerable")], None),
])
def test_rules(spark, rows, rule):
    got = {r.rule for r in golden.violations(entries(spark, *rows), chunked(spark, "d#c0")).collect()}
    assert got == ({rule} if rule else set())


def test_drift_and_freeze(spark):
    e = entries(spark, ("a", "q", "x", ["d#c0", "d#c1", "d#c9"], "multi-hop"), ("b", "r", "x", ["d#c2"], "single-hop"))
    c = chunked(spark, "d#c0", "d#c1", "d#c2")
    lock = spark.createDataFrame([("d#c0", "hd#c0"), ("d#c1", "old"), ("z#c0", "h")], "chunk_id string, frozen_hash string")
    assert {tuple(r) for r in golden.drift(e, c, lock).collect()} == {("d#c1", "drifted"), ("d#c2", "unfrozen")}
    assert len(golden.drift(e, c, lock, "fixed512", "other").collect()) == 1
    diff = {tuple(r) for r in golden.freeze_diff(lock, golden.freeze(e, c)).collect()}
    assert diff == {("d#c0", "same"), ("d#c1", "updated"), ("d#c2", "added"), ("z#c0", "removed")}
    good = entries(spark, ("a", "q", "x", ["d#c1"], "multi-hop"))
    with pytest.raises(ValueError, match="frozen texts changed: d#c1"):
        golden.checked_freeze(good, c, lock)
    assert golden.checked_freeze(good, c, lock, force=True).count() == 1
    with pytest.raises(ValueError, match="unknown chunk"):
        golden.checked_freeze(e, c, lock)
    marks = {(r.id, r.position): r.mark for r in golden.show(e, c, lock).collect()}
    assert marks == {("a", 0): "ok", ("a", 1): "drifted", ("a", 2): "missing", ("b", 0): "not frozen"}


def test_stats(spark):
    e = entries(spark, ("a", "q", "x", ["d#c0", "e#c1"], "multi-hop"), ("b", "r", "x", ["d#c2"], "single-hop"))
    assert {tuple(r) for r in golden.stats(e).collect()} == {("single-hop", 1, 1), ("multi-hop", 1, 2), ("unanswerable", 0, 0)}
    assert [tuple(r) for r in golden.top_docs(e).collect()] == [("d", 2), ("e", 1)]


@pytest.mark.parametrize(("got", "want", "k", "recall", "mrr", "ndcg"), [
    ("abcde", "bd", 5, 1, 0.5, 0.65093), ("abcde", "bd", 3, 0.5, 0.5, 0.38685), ("xyab", "ab", 4, 1, 1 / 3, 0.57064), ("ab", "abc", 2, 2 / 3, 1, 1),
    ("abcde", "", 5, None, None, None), ("aab", "b", 5, 1, 0.5, 0.63093), ("", "a", 5, 0, 0, 0),
])
def test_ranking_metrics(spark, got, want, k, recall, mrr, ndcg):
    df = spark.createDataFrame([("q", list(got), list(want))], "query_id string, retrieved array<string>, relevant array<string>")
    r = metrics.score_queries(df, k).first()
    assert [r.recall, r.mrr, r.ndcg] == [x if x is None else pytest.approx(x, abs=1e-5) for x in (recall, mrr, ndcg)]


def test_rows_score_like_arrays(spark):
    import random

    rng = random.Random(3)
    rows = [(f"q{i}", rng.sample("abcdefghij", rng.randint(0, 8)), rng.sample("abcdefghij", rng.randint(0, 5))) for i in range(30)]
    df = spark.createDataFrame(rows, "query_id string, retrieved array<string>, relevant array<string>")
    hits = df.select("query_id", "relevant", F.posexplode("retrieved").alias("pos", "id")).select("query_id", (F.col("pos") + 1).alias("rank"), F.array_contains("relevant", F.col("id")).alias("relevant"))
    got = {r.query_id: tuple(r)[1:] for r in metrics.score_ranked(hits, df.select("query_id", F.size("relevant").alias("n_relevant")), 4).collect()}
    for r in metrics.score_queries(df, 4).collect():
        assert got[r.query_id] == (pytest.approx((r.recall, r.mrr, r.ndcg)) if r.recall is not None else (None, None, None))


def test_aggregate_skips_null(spark):
    df = spark.createDataFrame([("a", ["x"], ["x"]), ("b", ["y", "x", "z"], ["x", "w"]), ("c", [], [])], "query_id string, retrieved array<string>, relevant array<string>")
    s = metrics.score_queries(df, 3)
    m = metrics.aggregate(s).first()
    assert (m.recall, m.mrr, m.scored, m.skipped) == (0.75, 0.75, 2, 1)
    assert metrics.unpivot(s, "t").count() == 6
    with pytest.raises(Exception, match="no query has a score"):
        metrics.checked_aggregate(s.where("query_id = 'c'")).collect()
    with pytest.raises(ValueError):
        metrics.top(F.col("x"), 0)


def test_latency(spark):
    import statistics

    for n in (1, 2, 10, 11, 30, 31):
        v = [float((i * 7919) % 101) for i in range(n)]
        r = metrics.latency(spark.createDataFrame([(x,) for x in v], "v double"), "v").first()
        assert (r.p50, r.p95) == (statistics.median(v), sorted(v)[round(0.95 * (n - 1))])
    r = metrics.latency(spark.createDataFrame([], "v double"), "v").first()
    assert (r.p50, r.p95) == (0, 0)


def test_latency_by_brackets(spark, monkeypatch):
    """The path for large groups: many ties, two groups, exact all the same."""
    import random
    import statistics

    monkeypatch.setattr(metrics, "BRACKET_ROWS", 100)
    rng = random.Random(1)
    rows = [("a", rng.random()) for _ in range(30_001)] + [("b", float(rng.randint(0, 3))) for _ in range(20_000)] + [("c", 1.0)]
    got = {r.g: (r.p50, r.p95) for r in metrics.latency(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    for g in "abc":
        v = sorted(x for h, x in rows if h == g)
        assert got[g] == (statistics.median(v), v[round(0.95 * (len(v) - 1))])


def test_shown(spark):
    df = spark.createDataFrame([(0.0625, None)], "a double, b double")
    assert tuple(df.select(metrics.shown(F.col("a"), 3), metrics.shown(F.col("b"), 2)).first()) == ("0.062", "—")


def test_prompt_answer_and_judge(spark):
    q = spark.createDataFrame([("q1", "why?"), ("q2", "who?")], "query_id string, text string")
    hits = spark.createDataFrame([("q1", 2, "a#c1", "two"), ("q1", 1, "a#c0", "one")], "query_id string, rank int, chunk_id string, text string")
    m = {r.query_id: r.message for r in prompt.user_message(q, hits).collect()}
    assert m["q2"] == "<context>\n\n</context>\n\n<question>\nwho?\n</question>"
    assert m["q1"].index("one") < m["q1"].index("two") < m["q1"].index("why?")

    def client():
        return lambda system, user: {"text": "Because [a#c0]." if "why" in user else prompt.ABSTAIN_PREFIX, "input_tokens": 3, "output_tokens": 2}

    a = prompt.answer(prompt.user_message(q, hits), client, "scripted")
    got = {r.query_id: r for r in a.collect()}
    assert got["q1"].cited_chunk_ids == ["a#c0"] and not got["q1"].abstained and got["q2"].abstained
    j = {r.query_id: r.faithfulness for r in prompt.judge(a, hits, lambda: lambda text, contexts: 0.5 if contexts == ["one", "two"] else float("nan")).collect()}
    assert j == {"q1": 0.5, "q2": None}
    t = metrics.tokens_used(a).first()
    assert (t.answers, t.refusals, t.input_tokens, t.output_tokens) == (2, 0, 6, 4)
    e = a.withColumn("difficulty", F.when(F.col("query_id") == "q2", "unanswerable").otherwise("single-hop"))
    assert metrics.abstain_accuracy(e).first().abstain_accuracy == 1


@pytest.mark.parametrize("text", ["- a\n- b", "chunking: fixed512", "name: x\nfoo: 1", "name: x\nchunking: no", "name: x\nembedding: no", "name: x\nretrieval: no", "name: x\ntop_k: 0", "name: x\ntop_k: many", "name: x\nprompt: v9", "name: x\njudge: ''"])
def test_bad_config(tmp_path, text):
    (tmp_path / "c.yaml").write_text(text)
    with pytest.raises(ValueError):
        config.load(tmp_path / "c.yaml")


def test_good_config(tmp_path):
    (tmp_path / "c.yaml").write_text("# run\nname: base\ntop_k: 3 # few\nrerank: null\n")
    assert config.load(tmp_path / "c.yaml") == config.RunConfig("base", top_k=3) and config.RunConfig("x").embedding == "text-embedding-3-small"


def test_golden_file(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    good = {"id": "a", "question": "q", "answer": "x", "relevant_chunk_ids": ["d#c0"], "difficulty": "single-hop"}
    p.write_text(json.dumps(good) + "\n\n")
    assert records.read_golden(spark, p).count() == 1
    p.write_text("{\n" + json.dumps(good | {"more": 1}) + "\n" + json.dumps(good | {"id": 3}) + "\n")
    with pytest.raises(ValueError, match=r"(?s)line 1.*line 2.*line 3"):
        records.read_golden(spark, p)


def test_line_numbers_hold_across_splits_and_files(spark, tmp_path):
    from corpusloom.sources import jsonl

    texts = {f"f{j}.txt": "".join(f"{j}-{i}" + "x" * (i % 50) + ("\n\n" if i % 5 == 0 else "\r\n" if i % 7 == 0 else "\n") for i in range(400)) + "end" for j in range(3)}
    texts["empty.txt"] = ""
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = jsonl.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, i): line for name, text in texts.items() for i, line in enumerate(text.splitlines(), 1)}


def test_every_defect_is_reported_with_its_line(spark, tmp_path):
    good = {"id": "a", "question": "q", "answer": "x", "relevant_chunk_ids": [], "difficulty": "single-hop"}
    lines = ["{", "[]", '"text"', "3", "null", json.dumps(good)[:-1], json.dumps(good), "", " \t", json.dumps({"id": "a"}), json.dumps(good | {"z": 1, "b": 2}), json.dumps(good | {"relevant_chunk_ids": "x"}), json.dumps(good | {"answer": None, "question": 4}), json.dumps(good | {"relevant_chunk_ids": ["a", 1]})]
    p = tmp_path / "g.jsonl"
    p.write_text("\n".join(lines))
    with pytest.raises(ValueError) as e:
        records.read_golden(spark, p)
    assert str(e.value).split("\n") == [
        "line 1: no JSON", "line 2: no object", "line 3: no object", "line 4: no object", "line 5: no object", "line 6: no JSON", "line 10: lacks question, answer, difficulty, relevant_chunk_ids",
        "line 11: has no place for b, z", "line 12: wrong types: relevant_chunk_ids", "line 13: wrong types: question, answer", "line 14: wrong types: relevant_chunk_ids",
    ]
    p.write_text("x\n" * 1005)
    with pytest.raises(ValueError, match="line 1000: no JSON\nand 5 more"):
        records.read_golden(spark, p)
    p.write_text("\n" + json.dumps(good) + "\n" + json.dumps(good | {"id": "é", "relevant_chunk_ids": ["d#c0"]}))
    assert [tuple(r) for r in records.read_golden(spark, p).orderBy("line").collect()] == [(2, "a", "q", "x", [], "single-hop"), (3, "é", "q", "x", ["d#c0"], "single-hop")]


def test_lock_file(spark, tmp_path):
    lock = spark.createDataFrame([("b#c0", "2"), ("a#c0", "1")], "chunk_id string, frozen_hash string")
    p = records.lock_path(tmp_path / "g.jsonl")
    assert p.name == "g.lock.json"
    assert records.read_lock(spark, p) is None
    records.write_lock(p, "fixed512", lock)
    assert p.read_text().endswith("}\n") and p.read_text().index("a#c0") < p.read_text().index("b#c0")
    assert records.read_lock(spark, p)[1].count() == 2


def test_manifest_archive_and_report(tmp_path):
    import hashlib
    import zipfile

    m = records.parse_manifest("# x\n\nhttps://e.org/a.zip docs subdir=a/b sha256=ff\nhttps://e.org/b.txt\n")
    assert m == [records.Source("https://e.org/a.zip", "docs", "a/b", "ff"), records.Source("https://e.org/b.txt")]
    for bad in ("u a b", "u x=1"):
        with pytest.raises(ValueError):
            records.parse_manifest(bad)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a/b/one.txt", "1")
        z.writestr("c.txt", "2")
    assert records.extract(tmp_path / "a.zip", tmp_path / "out", "a/b") == 1
    assert (tmp_path / "out/one.txt").read_text() == "1"
    with pytest.raises(ValueError, match="no files"):
        records.extract(tmp_path / "a.zip", tmp_path / "out", "zz")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.txt", "1")
    with pytest.raises(ValueError, match="leads out"):
        records.extract(tmp_path / "b.zip", tmp_path / "out")
    with pytest.raises(ValueError, match="sha256"):
        records.verify(tmp_path / "a.zip", "00")
    records.verify(tmp_path / "a.zip", hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest().upper())
    records.verify(tmp_path / "a.zip", hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest())
    records.append_row(tmp_path / "r.md", ["a", "b"], ["1", "2"])
    records.append_row(tmp_path / "r.md", ["a", "b"], ["3", "4"])
    assert (tmp_path / "r.md").read_text() == "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n"
    assert records.write_run(tmp_path, "base", "2024-01-02T03:04:05Z", {"a": 1}).name == "base-20240102T030405Z.json"


def test_corpus_files(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "guides").mkdir(parents=True)
    (root / "b.txt").write_bytes(b"two\r\n")
    (root / "A.HTML").write_text("<body><p>one</p></body>")
    (root / "guides/nested.md").write_text("# three\n")
    (root / ".hidden.txt").write_text("no")
    (root / "x.csv").write_text("no")
    got = [tuple(r) for r in files.load_corpus(spark, str(root)).select("doc_id", "text").collect()]
    assert got == [("A", "one"), ("b", "two"), ("guides/nested", "# three")]
    cached = files.load_corpus(spark, str(root), str(tmp_path / "cache"))
    assert cached.count() == 3 and files.load_corpus(spark, str(root), str(tmp_path / "cache")).count() == 3
    assert files.load_doc(cached, "b") == "two"
    with pytest.raises(FileNotFoundError):
        files.load_doc(cached, "zz")
    (root / "b.md").write_text("again")
    with pytest.raises(Exception, match="several files for b"):
        files.load_corpus(spark, str(root)).collect()


def test_run_with_scripted_parts(spark):
    from corpusloom.operators import chunk
    from corpusloom.operators.embed import Hash64, embed
    from corpusloom.operators.search import DenseRetriever

    d = spark.createDataFrame([("a", "lock waits"), ("b", "rows and pages")], "doc_id string, text string")
    c = chunk.with_hash(chunk.chunks(d)).withColumn("strategy", F.lit("fixed512"))
    v = embed(c, Hash64(), "chunk_id").join(c.select("chunk_id", "text_hash"), "chunk_id").withColumns({"strategy": F.lit("fixed512"), "model": F.lit("hash64")})
    e = entries(spark, ("q1", "lock waits", "x", ["a#c0"], "single-hop"), ("q2", "pages and rows", "x", [], "unanswerable"))
    got = evaluate.run(config.RunConfig("t", top_k=1), e, DenseRetriever(c, v, Hash64(), "fixed512"), lambda: lambda s, u: {"text": "yes"}, lambda: lambda t, x: 1.0)
    rows = {r.query_id: r for r in got.results.collect()}
    assert rows["q1"].recall == 1 and rows["q2"].recall is None and rows["q2"].retrieved == ["b#c0"]
    assert metrics.faithfulness(got.judged).first().n == 2
    row = evaluate.report_row(config.RunConfig("t", top_k=1), metrics.aggregate(got.results), "2024-01-02T03:04:05Z", None)
    assert len(row) == len(evaluate.HEADER) == 16 and row[6:8] == ["2 (1/1)", "1.000"] and row[10] == "—"
    watched, o = evaluate.observed(got.results, "run")
    watched.collect()
    assert o.get["queries"] == 2 and o.get["recall"] == 1
    assert prompt.judge_arguments("m-1", ("m-",)) == {"temperature": 0.0} and prompt.judge_arguments("m-1") == {}
    with pytest.raises(ValueError):
        evaluate.run(config.RunConfig("t"), e, None, None, lambda: None)
