import pytest
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.operators import metrics, traces
from corpusloom.plans import evaluate

ANSWERS = "query_id string, model string, input_tokens int, output_tokens int, latency_ms double, abstained boolean"


@pytest.fixture
def results(spark):
    rows = spark.createDataFrame([("q1", ["a", "b"], ["b"]), ("q2", [], ["b"]), ("q3", ["a"], [])], "query_id string, retrieved array<string>, relevant array<string>")
    return metrics.score_queries(rows, 2)


@pytest.fixture
def answers(spark):
    return spark.createDataFrame([("q1", "m", 1000, 10, 5.0, False), ("q3", "m", None, 20, 7.0, None)], ANSWERS)


def test_a_tree_of_spans_a_question(spark, results, answers):
    timed = spark.createDataFrame([("q2", 3.5)], "query_id string, latency_ms double")
    got = traces.spans("r", results, answers, timed, ("fixed512",)).collect()
    assert sorted((r.query_id, r.name) for r in got) == [("q1", "generation"), ("q1", "query"), ("q1", "retrieval"), ("q2", "query"), ("q2", "retrieval"), ("q3", "generation"), ("q3", "query"), ("q3", "retrieval")]
    assert len({r.span_id for r in got}) == 8 and len({r.trace_id for r in got}) == 3
    roots = {r.trace_id: r.span_id for r in got if r.name == "query"}
    assert all(r.parent_id == (None if r.name == "query" else roots[r.trace_id]) for r in got)
    at = {(r.query_id, r.name): r for r in got}
    assert at["q2", "retrieval"].latency_ms == 3.5 and at["q1", "retrieval"].latency_ms is None
    assert [at[q, "retrieval"].n_hits for q in ("q1", "q2", "q3")] == [2, 0, 1]
    g = at["q1", "generation"]
    assert (g.model, g.input_tokens, g.output_tokens, g.latency_ms, g.n_hits, g.tags) == ("m", 1000, 10, 5.0, None, ["fixed512"])
    assert {r.span_id for r in traces.spans("other", results).collect()}.isdisjoint({r.span_id for r in got})
    assert traces.spans("r", results.where("false"), answers).count() == 0


def test_a_question_answered_twice_is_an_error(results, answers):
    with pytest.raises(Exception, match="twice: q"):
        traces.spans("r", results, answers.unionByName(answers)).collect()


def test_scores_have_sources_and_no_nulls(spark, results, answers):
    judged = spark.createDataFrame([("q1", 0.5), ("q2", None), ("q3", float("nan"))], "query_id string, faithfulness double")
    got = {(r.query_id, r.name): (r.value, r.source) for r in traces.scores("r", results, answers, judged).collect()}
    assert {k for k in got if k[0] == "q1"} == {("q1", n) for n in ("recall", "mrr", "ndcg", "abstained", "faithfulness")}
    assert got["q1", "faithfulness"] == (0.5, traces.JUDGE) and got["q1", "abstained"] == (0, traces.HEURISTIC) and got["q1", "mrr"] == (0.5, traces.HEURISTIC)
    assert not [k for k in got if k[0] == "q3"] and got["q2", "recall"][0] == 0
    ids = {r.query_id: r.trace_id for r in traces.spans("r", results).collect()}
    assert all(ids[r.query_id] == r.trace_id for r in traces.scores("r", results).collect())


def test_a_run_written_again_replaces_its_own(spark, results, answers, tmp_path):
    for run in ("r1", "2024-01-02", "r1"):
        traces.write(str(tmp_path), traces.spans(run, results, answers), traces.scores(run, results, answers))
    spanned, scored = traces.read(spark, str(tmp_path))
    assert {r.run: r["count"] for r in spanned.groupBy("run").count().collect()} == {"r1": 8, "2024-01-02": 8}
    assert scored.join(spanned.where("name = 'query'"), ["run", "trace_id"], "left_anti").count() == 0


def test_cost(spark, results, answers):
    prices = lambda *rows: spark.createDataFrame(list(rows), "model string, input_price double, output_price double")
    got = traces.cost(traces.spans("r", results, answers), prices(("m", 2.0, 10.0), ("n", 1.0, 1.0))).first()
    assert (got.queries, got.unpriced) == (3, 0) and got.cost == pytest.approx(0.0023) and got.per_query == pytest.approx(0.0023 / 3)
    got = traces.cost(traces.spans("r", results, answers), prices(("n", 1.0, 1.0))).first()
    assert (got.unpriced, got.cost, got.per_query) == (2, None, None)
    assert traces.cost(traces.spans("r", results), prices()).first().cost == 0


def test_of_a_whole_run(results, answers):
    c = config.RunConfig("t", top_k=2)
    spanned, scored = evaluate.traced("r", c, evaluate.Answered(results, answers))
    assert spanned.count() == 8 and spanned.first().tags == [c.chunking, c.embedding, c.retrieval] and scored.where(F.col("name") == "abstained").count() == 1
    row = evaluate.report_row(c, metrics.aggregate(results), "2024-01-02T03:04:05Z", None, cost=0.00123)
    assert len(row) == 16 and row[evaluate.HEADER.index("$/query")] == "0.0012"
