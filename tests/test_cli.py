import json

import pytest

from corpusloom import cli
from corpusloom.operators import traces


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "corpus"
    root.mkdir()
    (root / "lock.txt").write_text("NOWAIT is given: the lock is not waited for.")
    (root / "rows.md").write_text("Rows live in pages.")
    rows = [("q1", "NOWAIT is given: the lock is not waited for.", ["lock#c0"], "single-hop"), ("q2", "who?", [], "unanswerable")]
    (tmp_path / "g.jsonl").write_text("".join(json.dumps({"id": i, "question": q, "answer": "a", "relevant_chunk_ids": c, "difficulty": d}) + "\n" for i, q, c, d in rows))
    return tmp_path


def test_commands(spark, folder, capsys):
    corpus, store, golden = str(folder / "corpus"), str(folder / "store"), str(folder / "g.jsonl")

    def run(*args):
        code = cli.main(list(args))
        return code, capsys.readouterr().out

    assert "lock" in run("docs", "--corpus", corpus)[1]
    assert "[0:44)" in run("chunks", "--corpus", corpus, "--doc", "lock")[1]
    code, out = run("grep", "--corpus", corpus, "nowait")
    assert code == 0 and out.startswith("lock#c0\t")
    assert run("grep", "--corpus", corpus, "zebra")[0] == 1
    assert "written=2" in run("index", "--corpus", corpus, "--store", store)[1]
    assert run("search", "--store", store, "rows in pages", "--k", "1")[1].split()[2] == "rows#c0"
    code, out = run("golden", "--corpus", corpus, "--golden", golden)
    assert code and "lock#c0: unfrozen" in out
    assert run("golden", "--corpus", corpus, "--golden", golden, "--freeze")[0] == 0
    assert run("golden", "--corpus", corpus, "--golden", golden) == (0, "ok\n")
    (folder / "corpus/lock.txt").write_text("changed")
    assert "lock#c0: drifted" in run("golden", "--corpus", corpus, "--golden", golden)[1]
    assert run("golden", "--corpus", corpus, "--golden", golden, "--freeze")[0] == 1
    assert run("golden", "--corpus", corpus, "--golden", golden, "--freeze", "--force")[0] == 0
    assert run("golden", "--corpus", corpus, "--golden", golden, "--stats")[0] == 0
    code, out = run("eval", "--store", store, "--golden", golden, "--results", str(folder / "results.md"))
    assert code == 0 and "| 1.000 |" in (folder / "results.md").read_text()
    assert run("eval", "--store", store, "--golden", golden, "--limit", "1", "--traces", str(folder / "traces"))[0] == 0
    spanned, scored = traces.read(spark, str(folder / "traces"))
    assert sorted((r.query_id, r.name) for r in spanned.collect()) == [("q1", "query"), ("q1", "retrieval")] and scored.count() == 3
    assert run("eval", "--store", store, "--golden", str(folder / "none.jsonl"))[0] == 1
