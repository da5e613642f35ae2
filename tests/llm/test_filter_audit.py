"""The filter audit against applying the filters in every order, document by document."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.filter_audit import audit, histogram, orders

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    """The set of letters that each (doc_id, text, part) row fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        out.append({k for k, x in f.items() if x})
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for (i, _, part), f in zip(rows, failures(rows), strict=True):
        parts[part or ""].append((f, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = list(range(len(docs)))
            for step, c in enumerate(order, 1):
                gone = [j for j in left if c in docs[j][0]]
                stay = [j for j in left if c not in docs[j][0]]
                redundant = sum(c in f for f, _, _ in docs) - len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), redundant, sum(f == {c} for f, _, _ in docs), sum(docs[j][1] for j in gone), sum(docs[j][2] for j in gone), c]
                removed_by[c] += len(gone)
                left = stay
        for key, x in out.items():
            if key[0] == part:
                x[6] = removed_by[x[6]]
    return out


def made():
    rng = random.Random(2)
    words = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    rows = [(i, words(rng.choice([20, 99, 100, 150]), rng.choice([30, 5000])) + rng.choice(["", " #", " TITLE" * 30]), rng.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(100 + i, rows[i % 4][1], rng.choice(["en", "fr"])) for i in range(30)]  # copies in several parts
    rows += [rows[5], rows[5], rows[70], (None, rows[0][1], "en"), (None, rows[0][1], "en"), (None, "x", None), (None, None, "en"), (200, None, "en"), (201, "", "en"), (202, "é😀ÀB" * 50, "en"), (203, "|" * 100_000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 210, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def test_every_order_equals_plain_filtering(spark):
    rows, labels = made()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, part string, mask int").repartition(4)
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert got == brute(rows, labels)
    assert len(got) == 600 * 4


def test_labels_joined_by_a_shuffle_give_the_same(spark, monkeypatch):
    from corpusloom.llm import filter_audit

    monkeypatch.setattr(filter_audit, "maybe_broadcast", lambda df: df.hint("merge"))
    rows, labels = made()
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in audit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit(none, labels).count() == 0
    one = audit(spark.createDataFrame([(1, None, None)], none.schema), labels)
    assert {(r.part, r.removed + r.redundant) for r in one.where(F.substring("filter_order", F.col("step"), F.lit(1)) == "A").collect()} == {("", 1)}


@pytest.mark.parametrize("letters", ["AB", "ABC"])
def test_other_filters(spark, letters):
    """Any number of filters, without the one for repeats."""
    def filters(text):
        return {"A": text.contains("a"), "B": text.contains("b"), "C": text.contains("c")} if len(letters) == 3 else {"A": text.contains("a"), "B": text.contains("b")}

    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(["a", "b", "ab", "abc", "c", "", "a"])], "doc_id int, text string, lang string")
    cells = histogram(df, spark.createDataFrame([(0, 1, 1)], "doc_id int, quality int, toxic int"), filters=filters, repeat=None)
    assert {r.mask: r.n for r in cells.collect()} == ({1: 2, 2: 1, 3: 1, 7: 1, 4: 1, 0: 1} if len(letters) == 3 else {1: 2, 2: 1, 3: 2, 0: 2})
    got = {(r.filter_order, r.step): r.removed for r in orders(cells, letters).collect()}
    assert got["AB" if len(letters) == 2 else "ABC", 1] == 4
    assert len(got) == {2: 4, 3: 18}[len(letters)]
