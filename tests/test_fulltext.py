"""Stems against the published sample, postings and BM25 against plain counts, and the stored text index."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.config import RunConfig
from corpusloom.functions.stem import stem, stems
from corpusloom.operators import fulltext, index, search
from corpusloom.operators.embed import Hash64

#: Words and their stems of the algorithm's published sample (fixed values).
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consolingly consol consols consol consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc
constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()
RULES = """skies sky dying die news news inning inning succeed succeed proceeds proceed ties tie cries cri gas gas gaps gap this this kiwis kiwi agreed agre feed feed luxuriated luxuri hopping hop hoping hope
fizzed fizz say say by by cry cri relational relat conditional condit digitizer digit operator oper feudalism feudal hopefulness hope formalize formal electrical electr goodness good activate activ
adoption adopt communion communion generously generous arsenal arsenal rate rate roll roll controlling control yes yes youth youth boy boy ed ed sing sing""".split()


@pytest.mark.parametrize("pairs", [SAMPLE, RULES])
def test_stems_equal_the_published_sample(pairs):
    assert {w: stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))
    assert stem("été") == "été" and stem("naïves") == "naïves" and stem("x") == "x" and stem("") == "" and stem("'s") == "'s"


def test_stems_of_arrays(spark):
    rows = [(1, ["running", "runs", None]), (2, []), (3, None), (4, ["locks"] * 3)]
    got = {r.id: r.s for r in spark.createDataFrame(rows, "id int, w array<string>").repartition(2).select("id", stems(F.col("w")).alias("s")).collect()}
    assert got == {1: ["run", "run", None], 2: [], 3: None, 4: ["lock"] * 3}


TEXTS = {"a": "SELECT ... FOR UPDATE NoWait", "b": "wait for it, waiting waits", "c": "", "d": None, "e": "the locks; locked rows wait", "f": "Row locking of rows and pages", "g": "the and of"}


def chunked(spark):
    return spark.createDataFrame([("fixed512", f"{d}#c0", d, t) for d, t in TEXTS.items()], "strategy string, chunk_id string, doc_id string, text string")


def plain_terms(text):
    import re

    return [stem(w) for w in re.findall(r"\w+", (text or "").lower()) if w not in fulltext.ENGLISH_STOP_WORDS]


def test_postings_and_all_words(spark):
    p = fulltext.postings(chunked(spark))
    assert {(r.chunk_id, r.term): (r.tf, r.length) for r in p.collect()} == {(f"{d}#c0", t): (n, len(plain_terms(x))) for d, x in TEXTS.items() for t, n in Counter(plain_terms(x)).items()}
    q = spark.createDataFrame([("1", "nowait"), ("2", "locked waiting"), ("3", "rows lock"), ("4", "the of"), ("5", "missing lock"), ("6", None)], "query_id string, text string")
    assert sorted(map(tuple, fulltext.with_all(p, q).collect())) == [("1", "a#c0"), ("2", "e#c0"), ("3", "e#c0"), ("3", "f#c0")]
    with pytest.raises(ValueError, match="klingon"):
        fulltext.analyzer("klingon")


@pytest.mark.parametrize("few", [0, 1000])
def test_bm25_equals_plain_scores(spark, monkeypatch, few):
    monkeypatch.setattr(fulltext, "FEW_TERMS", few)
    terms = {d: plain_terms(t) for d, t in TEXTS.items()}
    mean, asked = sum(map(len, terms.values())) / len(terms), {"1": "waiting rows", "2": "locks locks", "3": "nothing here", "4": "page update wait"}
    want = {}
    for q, text in asked.items():
        scores = {}
        for t in set(plain_terms(text)):
            df = sum(t in x for x in terms.values())
            for d, x in terms.items():
                if t in x:
                    tf = x.count(t)
                    scores[d] = scores.get(d, 0) + math.log(1 + (len(terms) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
        for rank, (s, d) in enumerate(sorted((-round(s, 9), d) for d, s in scores.items())[:3], 1):
            want[q, rank] = (f"{d}#c0", pytest.approx(-s))
    c, q = chunked(spark), spark.createDataFrame(list(asked.items()), "query_id string, text string")
    got = fulltext.SparseRetriever(c).search(q, 3, digits=9).collect()
    assert {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in got} == want
    assert fulltext.bm25(fulltext.postings(c), fulltext.sizes(c), q.where("false"), 3).count() == 0
    none = c.where("false")
    assert fulltext.bm25(fulltext.postings(none), fulltext.sizes(none), q, 3).count() == 0


def test_postings_and_search_of_bags_shuffle_no_chunk(spark, monkeypatch):
    """terms are counted where a chunk lies, and pairs of chunks and questions stay in their task."""
    c = chunked(spark).unionByName(spark.range(300).selectExpr("'fixed512'", "concat('n', id, '#c0')", "concat('n', id)", "concat('rows wait ', repeat('lock ', cast(id % 7 as int)))").toDF("strategy", "chunk_id", "doc_id", "text"))
    assert "Exchange" not in fulltext.postings(c)._jdf.queryExecution().executedPlan().toString()
    q = spark.createDataFrame([("1", "waiting rows"), ("2", "locks locks"), ("3", "nothing here"), ("4", "page update wait")], "query_id string, text string")
    assert "Exchange" not in fulltext.with_all(fulltext.bags(c), q)._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()))
    ways = []
    for few, pairs, cells, counted in ((0, 10**6, 10**6, 1000), (1000, 10**6, 10**6, 1000), (1000, 5, 10**6, 7), (1000, 10**6, 13, 3)):
        for name, value in (("FEW_TERMS", few), ("PAIRS", pairs), ("CELLS", cells), ("COUNTED_ROWS", counted)):
            monkeypatch.setattr(fulltext, name, value)
        p = fulltext.postings(c)
        best = fulltext.bm25(fulltext.bags(c), None, q, 5, digits=6)
        assert rows(best) == rows(fulltext.bm25(p, fulltext.sizes(c), q, 5, digits=6))
        ways.append((rows(best), rows(fulltext.with_all(fulltext.bags(c), q)), rows(fulltext.with_all(p, q)), rows(p)))
    assert all(w == ways[0] for w in ways) and len(ways[0][1]) > 300
    plan = best._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(query_id" in plan  # k rows a query and task alone
    with pytest.raises(ValueError, match="lengths"):
        fulltext.bm25(p, None, q, 5)


def test_blocks_hold_all_postings_and_shuffle_nothing(spark, monkeypatch):
    """a store's postings are inverted where their chunks lie, whatever buckets a batch has."""
    c = spark.range(40).selectExpr("'s' || id % 2", "concat('d', id, '#c0')", "concat('row ', id % 5, repeat(' lock', cast(id % 3 as int)))", "cast(id % 3 as int)").toDF("strategy", "chunk_id", "text", "bucket")
    c = c.unionByName(spark.createDataFrame([("s0", "e#c0", "the of", 0), ("s0", "n#c0", None, 1)], c.schema))
    want = sorted(map(tuple, fulltext.postings(c, keep=("strategy", "bucket")).collect()))
    for most in (1, 7, 2000):
        monkeypatch.setattr(fulltext, "BLOCK_ROWS", most)
        b = fulltext.blocks(c)
        assert "Exchange" not in b._jdf.queryExecution().executedPlan().toString()
        flat = fulltext.unblocked(b).withColumn("right", F.col("folder") == fulltext.term_folder(F.col("term")))
        assert sorted(map(tuple, flat.select("chunk_id", "term", "tf", "length", "strategy", "bucket").collect())) == want and flat.where("NOT right").count() == 0
    assert b.where("size(chunks) > 1").count() > 0


def test_fusion(spark):
    schema = "query_id int, chunk_id string, rank int"
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1)], schema)
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2), (3, "w", 1)], schema)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in fulltext.fuse([a, b], 2).collect()}
    assert got == {(1, 1): ("y", pytest.approx(1 / 62 + 1 / 61)), (1, 2): ("x", pytest.approx(1 / 61)), (2, 1): ("x", pytest.approx(1 / 61)), (3, 1): ("w", pytest.approx(1 / 61))}
    assert fulltext.fuse([a, b, a], 1).count() == 3
    with pytest.raises(ValueError):
        fulltext.fuse([a], 0)


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def test_stored_index_follows_changes_and_is_read_by_folders(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"), buckets=4)
    texts = {f"d{i}": f"row number {i} waits for locks" for i in range(12)} | {"x": "SELECT FOR UPDATE NOWAIT", "empty": ""}
    index.index_corpus(store, docs(spark, **texts))
    q = spark.createDataFrame([("1", "nowait"), ("2", "waiting lock")], "query_id string, text string")
    found = lambda: sorted(map(tuple, fulltext.with_all(store.text_index("fixed512")[0], q).collect()))
    assert found() == [("1", "x#c0")] + sorted(("2", f"d{i}#c0") for i in range(12))
    index.index_corpus(store, docs(spark, **(texts | {"x": "other words", "d1": "nowait again", "new": "a lock waits"})))
    assert found() == [("1", "d1#c0")] + sorted([("2", f"d{i}#c0") for i in range(12) if i != 1] + [("2", "new#c0")])
    posted, lengths = store.text_index("fixed512")
    fresh = store.read()[0]
    assert sorted(map(tuple, posted.select("chunk_id", "term", "tf", "length").collect())) == sorted(map(tuple, fulltext.postings(fresh).collect()))
    assert sorted(map(tuple, lengths.select("chunk_id", "length").collect())) == sorted(map(tuple, fulltext.sizes(fresh).collect()))
    one = fulltext.with_all(posted, q.where("query_id = '1'"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert all("folder" in x.split("PushedFilters")[0] for x in plan.split("PartitionFilters: ")[1:] if "term" in x) and "PartitionFilters" in plan
    # retrievers over the store
    state = store.state()
    for kind in ("sparse", "hybrid"):
        r = search.retriever(RunConfig("t", embedding="hash64", retrieval=kind), *store.read(state), Hash64(), store.text_index("fixed512", state))
        best = r.search(spark.createDataFrame([("q", "nowait again")], "query_id string, text string"), 3).orderBy("rank").collect()
        assert best[0].chunk_id == "d1#c0" and best[0].text == "nowait again"
    with pytest.raises(ValueError, match="unknown retrieval"):
        search.retriever(RunConfig("t", retrieval="magic"), *store.read(state), Hash64())
    assert store.text_index("no such")[0].count() == 0
    # a store of before: no postings until it is compacted
    old = {n: f for n, f in state.folders.items() if n in ("chunks", "embeddings")}
    store._point_to(old | {"buckets": 4}, state.number + 1)
    with pytest.raises(ValueError, match="compact"):
        store.text_index("fixed512")
    store.compact()
    assert store.text_index("fixed512")[0].count() == posted.count()


def test_blocks_stem_and_count_in_one_pass(spark):
    """A chunk goes through one worker once, in the plan and in what is posted; chunks without terms have lengths but no postings."""
    rows = [("s", i % 3, f"c{i}", t) for i, t in enumerate(["the rows wait", "waiting rows, rows", "", "of the", None, "Bücher relational"] * 20)]
    chunked = spark.createDataFrame(rows, "strategy string, bucket int, chunk_id string, text string")
    found = fulltext.blocks(chunked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("regexp_extract_all") == 1
    assert "ArrowEvalPython" not in fulltext.sizes(chunked)._jdf.queryExecution().executedPlan().toString()
    got = {(r.chunk_id, r.term, r.tf, r.length, r.bucket) for r in fulltext.unblocked(found).collect()}
    assert got == {(r.chunk_id, r.term, r.tf, r.length, r.bucket) for r in fulltext.postings(chunked, keep=("bucket",)).collect()}
    assert {(r.folder, r.term) for r in fulltext.unblocked(found).collect()} == {(r.f, r.term) for r in fulltext.postings(chunked).select(fulltext.term_folder(F.col("term")).alias("f"), "term").collect()}
    lengths = {r.chunk_id: r.length for r in fulltext.sizes(chunked).collect()}
    assert len(lengths) == len(rows) and lengths == {r.chunk_id: r.length for r in fulltext.bags(chunked).collect()}
