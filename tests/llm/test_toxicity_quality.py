import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality_rules as qr
from corpusloom.llm import toxicity as tox


def labelled(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"t{int(400 * rng.random() ** 2)}" + rng.choice("abcdef") for _ in range(rng.randint(20, 120))]
        toxic = i % 8 == 0
        if toxic:
            for bad in rng.choices(["nasty", "vilest", "grubx" + rng.choice("abcdefgh")], k=3):
                w[rng.randrange(len(w))] = bad.capitalize() + rng.choice(["", "!", "###"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(spark)
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (10**9, 1)], "doc_id bigint, toxic int")
    model = tox.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    assert set(got) == set(range(600)) and all(0 <= s <= 1 for s in got.values())
    wrong = [i for i, _, y in rows if i % 3 == 0 and (got[i] >= 0.3) != bool(y)]
    assert len(wrong) <= 4
    assert model.labels.correlations.shape[0] == len(model.voters) + len(tox.PATTERNS)
    for i, t, _ in rows[:100]:  # scores from votes, mark by mark
        assert got[i] == pytest.approx(plain_score(model, t), abs=1e-9)


def plain_score(model, text):
    """The classifier's score, its votes counted one mark and one word at a time."""
    words, cur = [], ""
    for ch in text.lower() + " ":
        if ch.isalpha() or ch.isalnum() and not ch.isdecimal() and not ch.isdigit():
            cur += ch
        else:
            words += [cur] if cur else []
            cur = ""
    hits = {}
    for v in model.voters:
        mark = v.rstrip("*")
        hits[mark] = sum(w == mark[1:] if mark[0] == "=" else w.startswith(mark[1:]) and len(w) > len(mark) - 1 for w in words)
    learned = []
    for v in model.voters:
        n = hits[v.rstrip("*")]
        learned.append(float(n >= 2 and n >= 0.01 * max(1, len(words)) if v.endswith("*") else n > 0))
    fixed = [float(p.search(text) is not None) for p in tox.PATTERNS]
    total = sum(hits.values())
    x = [1.0, *learned, *fixed, float(any(learned)), math.log(1 + total), min(total / max(1, len(words)), 0.1) * 10]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


def test_wrong_labels_are_overruled(spark):
    """Of the labels a tenth is wrong, and a third of the documents have none; the scores follow the truth all the same."""
    rows = labelled(spark, 1600, 3)
    rng = random.Random(9)
    given = {i: y if rng.random() > 0.1 else 1 - y for i, _, y in rows if i % 3}
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    model = tox.fit(docs, spark.createDataFrame(list(given.items()), "doc_id bigint, toxic int"), F.lit(True))
    got = {r.doc_id: r.score >= 0.3 for r in tox.score(docs, model).collect()}
    wrong_labels = sum(given[i] != y for i, _, y in rows if i in given)
    assert wrong_labels > 60
    assert sum(got[i] != bool(y) for i, _, y in rows if i in given) <= wrong_labels / 6
    assert sum(got[i] != bool(y) for i, _, y in rows) <= 20
    assert model.labels.prior * model.labels.any[1] == pytest.approx(1 / 8, abs=0.02)  # toxic documents that are voted on, not toxic labels


def test_toxicity_odd_input(spark, docs, empty, corpus):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = tox.fit(docs, none, F.lit(True))
    got = tox.score(docs, model).collect()
    assert len(got) == len(corpus) and {r.score for r in got} == {0.0}
    one_kind = tox.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, toxic int"), F.lit(True))
    assert {r.score for r in tox.score(docs, one_kind).collect()} == {1.0}
    assert tox.score(empty, one_kind).collect() == []
    assert tox.fit(empty, none, F.lit(True)).prior == 0


def test_label_model_finds_rates_and_correlation():
    """From a rough start and no label: rates, class balance and the voter that repeats another."""
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    v = np.column_stack([rng.random(20_000) < np.where(y, 0.8, 0.004), rng.random(20_000) < np.where(y, 0.6, 0.002), np.zeros(20_000, bool), rng.random(20_000) < np.where(y, 0.5, 0.002), rng.random(20_000) < 0.3])
    v[:, 2] = v[:, 1]  # says what the second says
    few = rng.permutation(20_000)[:200]
    start = tox.LabelModel.of(v[few], y[few] ^ (rng.random(200) < 0.1), 4)
    n = np.ones(len(v))
    found = tox.estimate(lambda m, both: tox._moments(v, n, m.posterior(v), m.learned, both), start)
    q = found.posterior(v)
    some = v[:, :4].any(1)
    assert ((q > 0.5) == y)[some].mean() > 0.95 and found.prior * found.any[1] == pytest.approx((y & some).mean(), abs=0.02)
    assert found.any[0] < 0.03 and found.any[1] > 0.5
    assert found.rates[1, 0] == pytest.approx(v[y & some, 0].mean(), abs=0.05)
    assert found.correlations[1, 2] > 0.95 and found.weight[1] <= 0.55 and found.weight[1] == pytest.approx(found.weight[2])
    assert found.rates[1, 4] == pytest.approx(found.rates[0, 4], abs=0.05)  # says nothing
    once, times = np.unique(v, axis=0, return_counts=True)  # patterns and their numbers give the same
    again = tox.estimate(lambda m, both: tox._moments(once, times.astype(float), m.posterior(once), m.learned, both), start)
    assert again.posterior(v) == pytest.approx(q, abs=1e-6)


def plain_statistics(text):
    """The base statistics, word by word."""
    space = " \t\n\x0b\x0c\r"
    words, cur = [], ""
    for ch in text + " ":
        if ch in space:
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += ch
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(space):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), dup, len(covered)


def test_statistics_equal_plain_ones(corpus):
    texts = [t or "" for _, t in corpus] + ["a b c a b c", "a a a a", "x\nx\n \n \nx", "#*$%&|<> é", "a b c\nd a b c d"]
    for t in texts:
        assert qr.statistics(t.encode())[0] == plain_statistics(t)
    many = np.arange(100)
    many[50:53] = many[10:13]
    assert qr.repeated_words(many + (1 << 22)) == 6  # ids too large for one integer


def test_forest_isolates_the_odd():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (2000, 4)), rng.normal(7, 0.5, (40, 4))])
    good = np.arange(2040) < 2000
    forest = qr.IsolationForest().fit(x)
    s = forest.score(x)
    t = qr.calibrate(s, good)
    assert (s[~good] > t).mean() > 0.9 and (s[good] > t).mean() <= 0.005
    assert qr.calibrate(s, np.ones(2040, bool)) == float("inf")
    assert qr.IsolationForest().fit(np.ones((5, 3))).score(np.ones((2, 3))).tolist() == pytest.approx([0.5, 0.5], abs=0.2)


def test_quality_judges_every_row(spark, docs, empty, corpus):
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)] + [(None, 0), (3, None)], "doc_id bigint, quality int")
    model = qr.fit(docs, labels)
    got = qr.judge(docs, model).collect()
    want = sorted(plain_statistics(t or "") for _, t in corpus)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    unlabelled = qr.fit(docs, labels.where("false"))
    assert all(r.kept != r.base_failed for r in qr.judge(docs, unlabelled).collect())
    assert qr.judge(empty, model).collect() == []
    assert qr.judge(docs, model, keep=tuple(docs.columns), prefix="q_").columns[:6] == docs.columns


def test_columns_called_like_the_result_are_replaced(spark):
    from corpusloom.llm import quality_rules, toxicity

    df = spark.createDataFrame([(1, "some words", 5, 0.5, True)], "doc_id int, text string, N_words int, Score double, kept boolean")
    got = quality_rules.judge(df, (quality_rules.IsolationForest(), float("inf")), keep=("N_words", "kept"))
    assert [c.lower() for c in got.columns] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept"]
    assert got.first()["n_words"] == 2 and got.first()["kept"] is False
    scored = toxicity.score(df, toxicity.Model(prior=0.25), keep=("doc_id", "Score"))
    assert scored.columns == ["doc_id", "score"] and scored.first().score == 0.25
