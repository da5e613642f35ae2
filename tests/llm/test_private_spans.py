"""Personal data: rules against plain regular expressions, the graph against plain dictionaries."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.llm import private_spans as ps

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x // 10 + x % 10 for x in twice) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text) if ok(k, m.group())]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check_base(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PLAIN]


ODD = [
    None, "", " ", "a@b.c@d.e", "a@b.com_c@d.e.f.", "😀é a.b@c.d😀 1.2.3.4.5.6.7.8", "1.2.3.256 1.2.3.0255 00000000000000000001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112 4111  1111",
    "+1 (375) 555-4393.", "+1((((", "+12 3456 7", "x+4 12345678)) 4 5", "1" * 3000, "a" * 50_000, "@" * 3000, "1.1" * 3000, ".1" * 900, "9 " * 3000, "a@b" + ".c" * 20_000, "+1" + "(" * 30_000,
    "4111111111111111\n4111111111111111", "\U0001f600" * 500 + "x@y.z", "<joe@x.org>, (joe@x.org). \"joe@x\"",
]


def test_rules_equal_plain_expressions(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("+1 4.9-@a(é2)5,") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    made += ["".join(rng.choice("41 -") for _ in range(40)) + " 4111 1111 1111 1111" for _ in range(50)]
    texts = dict(enumerate(ODD + made))
    rows = ps.find(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    check_base(rows, texts)


def test_corpus_with_nulls_repeats_and_clashing_names(spark, docs, corpus, empty):
    rows = ps.find(docs.withColumn("spans", F.lit("x"))).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in corpus)
    texts = {i: t for i, t in corpus if i is not None}
    known = [r for r in rows if r.doc_id is not None]
    check_base(list({r.doc_id: r for r in known}.values()), texts)
    assert ps.find(empty).count() == 0


def test_sums_of_long_lists(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        df = spark.range(1).select(F.transform(F.slice(F.sequence(F.lit(0), F.lit(1000)), 2, n), lambda x: (x % 7).cast("int")).alias("a"))
        want, total = [], 0
        for i in range(1, n + 1):
            total += i % 7
            want.append(total)
        assert df.select(ps.running_sums(F.col("a"))).first()[0] == want


def texts_with_contexts():
    rng = random.Random(3)
    fill = ["the", "of", "and", "rate", "was", "in"]
    some = lambda k: " ".join(rng.choice(fill) for _ in range(k))
    out = []
    for i in range(40):  # phones and addresses after words of their own, seeds all over after any word
        out.append(f"{some(4)} dial tel: +1 (555) 20{i % 10}-{1000 + i} {some(3)} write to: p{i}@mail{i % 3}.example.com {some(2)}")
        out.append(f"{some(3)} +1 (777) 301-{2000 + i} {some(2)} q{i}@x.org {some(2)} 10.0.{i}.1 {some(3)}")
    out += [f"{some(3)} dial tel: 555-01{i}7 {some(2)}" for i in range(6)]  # unseen, in a trusted context
    out += [f"{some(3)} call 555-0117 {some(2)}", f"{some(2)} of 555-0127 and"]  # found elsewhere by their values
    out += [f"{some(2)} hotline 555-7{i}17, 555-0137 x" for i in range(3)]
    out += [f"{some(2)} write to: <root@localhost>, {some(2)}", f"{some(2)} the root@else and", f"{some(3)} of 555-9999 {some(2)} 1234567 was"]
    return out


def brute(texts, seeds, trust, accept, rounds):
    """(kind, start, end) of each text, by dictionaries."""
    own = lambda v: next((i for i, k in enumerate(PLAIN) if re.fullmatch(PLAIN[k], v) and ok(k, v)), None)

    def kinds(v):
        n, number = len(re.sub("[^0-9]", "", v)), re.fullmatch(r"[0-9 ().:/+-]*", v)
        tests = [re.match(r"[^@]*[^@\W][^@]*@[^@]*[^@\W]", v), re.fullmatch("[0-9]+([.:][0-9]+){3,7}", v), number and 12 <= n <= 19, number and 7 <= n <= 15]
        return [i for i, t in enumerate(tests) if t]

    occurrences, edges = [], set()
    for t in texts:
        here, last = [], 0
        ms = list(regex.finditer(ps.INSTANCE, t))
        for i, m in enumerate(ms):
            a, b, v = m.start(), m.end(), m.group()
            if "@" in v:
                a += len(v) - len(v.lstrip("\"'<([{:;,"))
                b -= len(v) - len(v.rstrip("\"'>)]},.:;!?"))
            left = re.sub("[0-9]+", "0", t[max(last, m.start() - 48) : m.start()].lower()).split()
            right = re.sub("[0-9]+", "0", t[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(t)].lower()).split()
            w1, w2, r1 = (left[-1][-24:] if left else "^"), (left[-2][-24:] if len(left) > 1 else "^"), (right[0][-24:] if right else "^")
            last = m.end()
            here.append((a, b, t[a:b]))
            edges |= {(p, t[a:b]) for p in (f"{w2} {w1} _", f"{w1} _", f"{w1} _ {r1}")}
        occurrences.append(here)
    of = defaultdict(set)
    for p, v in edges:
        of[p].add(v)
    score = {}
    for _ in range(rounds):
        trusted = {}
        for p, vs in of.items():
            for k in range(4):
                n = sum(own(v) == k for v in vs)
                share = (n + sum(score.get((v, k), 0) for v in vs if own(v) is None)) / (len(vs) + 1)
                if n >= seeds and share >= trust:
                    trusted[p, k] = share
        new = defaultdict(float)
        for p, v in edges:
            for k in kinds(v) if own(v) is None else ():
                if (p, k) in trusted:
                    new[v, k] += math.log(1 - min(trusted[p, k], 0.999))
        score = {x: 1 - math.exp(s) for x, s in new.items()}
    best = {}
    for (v, k), s in score.items():
        if s >= accept:
            best[v] = max(best.get(v, (0, -9)), (round(s, 9), -k))
    out = []
    for t, here in zip(texts, occurrences, strict=True):
        base = plain(t)
        more = [(list(PLAIN)[-best[v][1]], a, b) for a, b, v in here if v in best and not any(x < b and a < y for _, x, y in base)]
        out.append(listed(sorted(base + more, key=lambda s: (list(PLAIN).index(s[0]), s[1]))))
    return out


@pytest.mark.parametrize("how", [{}, {"seeds": 2, "trust": 0.4, "accept": 0.5, "rounds": 2}, {"rounds": 1}])
def test_graph_equals_plain_dictionaries(spark, how):
    texts = texts_with_contexts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    want = brute(texts, **({"seeds": ps.SEEDS, "trust": ps.TRUST, "accept": ps.ACCEPT, "rounds": ps.ROUNDS} | how))
    for r in ps.find(df, **how).collect():
        assert r.spans == want[r.doc_id], texts[r.doc_id]


def test_contexts_find_what_rules_do_not(spark):
    texts = texts_with_contexts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [texts[r.doc_id][int(a) : int(b)] for _, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in ps.find(df).collect() if r.n_added}
    found = {x for i, xs in got.items() for x in xs if i >= 80}
    assert {f"555-01{i}7" for i in range(6)} <= found and "root@localhost" in found  # in their contexts
    assert got[86] == ["555-0117"] and got[87] == ["555-0127"]  # the same values elsewhere
    assert "555-9999" not in found and "1234567" not in found and "root@else" not in found  # next to words that stand before anything


def test_copies_and_null_ids_keep_their_spans(spark):
    texts = texts_with_contexts()
    rows = [(None if i % 7 == 0 else i % 5, t) for i, t in enumerate(texts + texts[80:83] * 4)]
    got = ps.find(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert len(got) == len(rows)
    want = brute(texts, ps.SEEDS, ps.TRUST, ps.ACCEPT, ps.ROUNDS)
    assert sorted((str(i), want[texts.index(t)]) for i, t in rows) == sorted((str(r.doc_id), r.spans) for r in got)
