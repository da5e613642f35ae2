import os

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp
from corpusloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = docs
    seen = [{r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}]
    for name, stage in cp.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, DATA).collect(), docs.schema)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert all(r.n_chars == len(r.text) for r in rows)
        seen.append({r.doc_id: r.text for r in rows})
        assert set(seen[-1]) <= set(seen[-2])
    toxic = {i for i, r in labels.items() if r.toxic}
    assert len(toxic & set(seen[1])) <= 0.7 * len(toxic)  # few rows to learn from here
    clean = set(seen[0]) - toxic
    assert len(clean & set(seen[1])) >= 0.98 * len(clean)
    assert all(len(seen[1][i].split()) >= 50 for i in seen[2])
    assert set(seen[3]) == set(seen[2])
    pieces = cp.pack(spark, kept, DATA).collect()
    assert {r.doc_id for r in pieces} == set(seen[4])
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"
    rows = [(1, None, None, None, None, None), (2, "", "en", "s", 0, 1.0), (None, "word " * 60, "en", "s", 300, 1.0), (2, "", "en", "s", 0, 1.0), (4, " ".join(f"w{i}" for i in range(80)), "en", "s", 9, 1.0)]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in cp.STAGES:
            out = stage(spark, frame, str(tmp_path))
            out.collect()
            if name != "packing":
                assert out.columns == frame.columns


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Names that stages use themselves stay as they are, with their values."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "toxicity", "_toxicity", "quality_kept", "n_dropped", "__k", "__key", "__hash", "__toxicity", "__quality_kept", "n_lines", "row", "score"]
    rows = [(i, "shared line\n" + " ".join(f"w{i}x{j}" for j in range(70)), "en", "s", 0, *[f"{c}{i}" for c in names[5:]]) for i in range(14)]
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, names)
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == set(range(14))
    assert all(got[i][c] == f"{c}{i}" for i in got for c in names[5:])
    assert sum(r["text"].startswith("shared line") for r in got.values()) == 1


def test_line_dedup_leaves_no_emptied_copies(spark):
    copy = "\n".join(f"line {i} of the copied text" for i in range(12))
    rows = [(i, copy + " \n\t" * (i % 2), "en", "s", 0) for i in range(30)]
    rows += [(40, copy + "\nown words", "en", "s", 0), (41, "", "en", "s", 0), (42, None, "en", "s", None), (43, " \n", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in cp.dedup_lines(spark, docs.repartition(3), DATA).collect()}
    assert got == {0: copy, 40: "own words", 41: "", 42: None, 43: " \n"}


def test_run(spark):
    got = cp.run(spark, DATA).collect()
    assert got and np.all([r.length > 0 for r in got])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_their_contract(spark, name):
    want = {
        "1": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "2": "doc_id held_out n_tokens n_known train_tokens base_score score", "3": "doc_id held_out score predicted",
        "4": "doc_id n_shingles component_id", "5": "doc_id n_tokens ids_sha256 decoded_sha256", "6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "7": "page_id url text n_chars", "8": "doc_id n_lines n_dropped kept_sha256", "9": "page_id host path rule verdict",
        "10": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "11": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "12": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    }
    df = queries.QUERIES[name](spark, DATA)
    assert set(want[name[2:].split("_")[0]].split()) <= set(df.columns)
    table = "pages" if "page_id" in df.columns else "documents"
    key = df.columns[0]
    if key == "part":  # the audit's rows are not of documents
        assert df.count() == 600 * spark.read.parquet(f"{DATA}/documents.parquet").select("lang").distinct().count()
        return
    assert {r[0] for r in df.select(key).collect()} == {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
