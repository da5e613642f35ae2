import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import katz
from corpusloom.llm.common import fold

END = "\n"


def plain_discounts(values, k=5):
    """Good-Turing discounts of a list of counts, step by step: Turing's ratio while it holds, then the log-linear fit."""
    n = Counter(values)
    lows = list(range(1, 33))
    while lows[-1] <= max(values, default=0):
        lows.append(lows[-1] + math.ceil(lows[-1] / 4))
    lows.append(lows[-1] + math.ceil(lows[-1] / 4))
    points = []
    for lo, hi in zip(lows, lows[1:], strict=False):
        have = sum(m for r, m in n.items() if lo <= r < hi)
        if have:
            points.append((math.log(lo * (hi - 1)) / 2, math.log(have / (hi - lo))))
    b = 0.0
    if len(points) > 2:
        mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
        b = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    if b >= -1 or not n[1]:
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return [1.0] + [(r - off) / r for r in range(1, k + 1)]
    fit = [((r + 1) / r) ** (b + 1) for r in range(1, k + 1)]
    floor = (k + 1) * n[k + 1] / n[1]
    chosen, trusted = [], True
    for r in range(1, k + 1):
        if trusted and n[r] and n[r + 1]:
            turing = (r + 1) * n[r + 1] / (r * n[r])
            deviation = math.sqrt(((r + 1) / r) ** 2 * n[r + 1] / n[r] ** 2 * (1 + n[r + 1] / n[r]))
            trusted = floor < turing < 1 and abs(turing - fit[r - 1]) > 1.65 * deviation
        else:
            trusted = False
        chosen.append(turing if trusted else fit[r - 1])
    if min(chosen) <= floor:
        chosen, floor = fit, (k + 1) ** (b + 1)
    return [1.0] + [(x - floor) / (1 - floor) for x in chosen]


def brute(rows, train):
    tok = [[w.decode() for w in (t or "").encode().lower().split()] + [END] for _, t in rows]
    c, b = Counter(), Counter()
    for t, learn in zip(tok, train, strict=True):
        if learn:
            c.update(t)
            b.update(zip([END, *t[:-1]], t, strict=True))
    n, v, k = sum(c.values()), len(c), katz.K

    d1, d2 = plain_discounts(list(c.values())), plain_discounts(list(b.values()))
    p1 = {w: (d1[x] if x <= k else 1) * x / n for w, x in c.items()}
    unknown = 1 - sum(p1.values())
    after = defaultdict(dict)
    for (x, y), m in b.items():
        after[x][y] = m
    scale, bow = {}, {}
    for x, ys in after.items():
        left = 1 - sum((d2[m] if m <= k else 1) * m / c[x] for m in ys.values())
        kept = max(left, 1 / (c[x] + 1))
        scale[x], bow[x] = (1 - kept) / (1 - left), kept / (1 - sum(p1[y] for y in ys))

    def p(x, y):
        m = b.get((x, y), 0)
        return (d2[m] if m <= k else 1) * m / c[x] * scale[x] if m else bow.get(x, 1.0) * p1.get(y, unknown)

    out = [(len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), sum(math.log10(p(x, y)) for x, y in zip([END, *t[:-1]], t, strict=True))) for t in tok]
    return out, p, c, after


@pytest.mark.parametrize("block", [50, 3_000_000])
def test_equals_brute_force(spark, docs, corpus, block, monkeypatch):
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in corpus]
    want, p, c, after = brute(corpus, train)
    for x in [END, *list(after)[:20], "never seen"]:  # exactly normalised
        assert sum(p(x, y) for y in c) + p(x, "\0") == pytest.approx(1, abs=1e-9)
    rows = docs.repartition(4)
    if block == 50:
        rows = rows.where("length(text) < 5000 OR text IS NULL")
        want, *_ = brute(small := [(i, t) for i, t in corpus if t is None or len(t) < 5000], [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, t in small])
    got = blocks(rows, block) if block == 50 else katz.score(rows, fold(F.col("doc_id"), 5) != 1).collect()
    key = lambda r: (r[0], r[1], round(r[3], 5), round(r[4], 5))
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3]
        assert g[3:] == pytest.approx(w[3:], abs=1e-6)


def blocks(rows, size, order=2):
    """score() with many small blocks: the size is read in the workers."""
    original = katz._blocks

    def small(batches, order=2):
        import corpusloom.llm.katz as k

        k.BLOCK_TOKENS = size
        yield from original(batches, order)
        k.BLOCK_TOKENS = 3_000_000

    katz._blocks = small
    try:
        return katz.score(rows, fold(F.col("doc_id"), 5) != 1, order=order).collect()
    finally:
        katz._blocks = original


def brute_order(rows, train, order):
    """Scores by the recursion as written, for any order."""
    tok = [[w.decode() for w in (t or "").encode().lower().split()] + [END] for _, t in rows]
    counts = [defaultdict(Counter) for _ in range(order)]
    for t, learn in zip(tok, train, strict=True):
        if learn:
            for i, w in enumerate(t):
                for m in range(order):
                    counts[m][tuple(([END] * m + t)[i : i + m])][w] += 1
    k = katz.K
    d = [plain_discounts([x for ws in c.values() for x in ws.values()]) for c in counts]

    def kept(m, x):
        return (d[m][x] if x <= k else 1) * x

    n = sum(counts[0][()].values())
    unknown = 1 - sum(kept(0, x) for x in counts[0][()].values()) / n
    memo = {}

    def p(ctx, w):
        m = len(ctx)
        after = counts[m].get(ctx)
        if not m:
            return kept(0, after[w]) / n if w in after else unknown
        if not after:
            return p(ctx[1:], w)
        if ctx not in memo:
            total = sum(after.values())
            left = 1 - sum(kept(m, x) for x in after.values()) / total
            least = max(left, 1 / (total + 1))
            memo[ctx] = total, (1 - least) / (1 - left), least / (1 - sum(p(ctx[1:], y) for y in after))
        total, scale, bow = memo[ctx]
        return kept(m, after[w]) / total * scale if w in after else bow * p(ctx[1:], w)

    score = [sum(math.log10(p(tuple(([END] * (order - 1) + t)[i : i + order - 1]), w)) for i, w in enumerate(t)) for t in tok]
    return score, p, counts


@pytest.mark.parametrize("order", [3, 4])
def test_higher_orders_and_stored_model_equal_brute_force(spark, docs, corpus, order, tmp_path):
    rows = [(i, t) for i, t in corpus if t is None or len(t) < 5000]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows]
    want, p, counts = brute_order(rows, train, order)
    for ctx in list(counts[-1])[:20]:  # exactly normalised
        assert sum(p(ctx, w) for w in counts[0][()]) + p(ctx, "\0") == pytest.approx(1, abs=1e-9)
    frame = docs.where("length(text) < 5000 OR text IS NULL").repartition(4)
    store = str(tmp_path / "model")
    got = katz.score(frame, fold(F.col("doc_id"), 5) != 1, order=order, store=store).collect()
    assert sorted(r.score for r in got) == pytest.approx(sorted(want), abs=1e-6)
    # without a store, contexts of one block only aren't asked about
    assert sorted(r.score for r in blocks(frame, 700, order)) == pytest.approx(sorted(want), abs=1e-6)
    # other texts, unknown words among them, by the stored tables
    texts = ["t1 t2 t3 zz t1 t2 t4", "t0 t0 t5 t1", "", "never seen words", corpus[0][1]]
    other = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    later, *_ = brute_order(rows + list(enumerate(texts)), train + [False] * len(texts), order)
    scored = {r.doc_id: r for r in katz.score_stored(other, store).collect()}
    assert [scored[i].score for i in range(len(texts))] == pytest.approx(later[len(rows) :], abs=1e-6)
    assert all(r.held_out and r.train_tokens == got[0].train_tokens for r in scored.values())


def test_without_training_rows_and_without_rows(spark, docs, empty):
    got = katz.score(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(0) for r in got)
    assert katz.score(empty, F.lit(True)).collect() == []


def test_pack_arrays():
    import numpy as np

    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([256, 3]), np.array([1 << 40]), np.array([0.5, -1e300])]
    assert [a.tolist() for a in katz.unpack(katz.pack(*arrays))] == [a.tolist() for a in arrays]


def test_histogram_bins():
    import numpy as np

    c = np.array([0, 1, 1, 2, 32, 33, 39, 40, 41, 49, 50, 51, 1 << 39])
    h = katz.counts_of_counts(c)
    assert h.sum() == 12 and h[0] == 2 and h[1] == 1 and h[31] == 2 + 1 and katz.EDGES[32] == 40
    assert (np.diff(katz.EDGES) > 0).all() and h[32] == 3  # 40, 41, 49


def test_discounts_are_good_turing():
    import numpy as np

    rng = np.random.default_rng(0)
    for a in (1.6, 2.0, 2.6):
        c = np.minimum(rng.zipf(a, 40_000), 1 << 38)
        found = katz.good_turing(katz.counts_of_counts(c))
        assert found is not None and (found > 0).all() and (found < 1).all()
        assert katz.discounts(katz.counts_of_counts(c)) == pytest.approx(plain_discounts(c.tolist()), rel=1e-9)
    flat = np.repeat(np.arange(1, 30), 10)
    assert katz.good_turing(katz.counts_of_counts(flat)) is None
    assert katz.discounts(katz.counts_of_counts(flat)) == pytest.approx(plain_discounts(flat.tolist()))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_test_tables_get_good_turing_at_every_order(spark, sf):
    """Counts of the contract's training rows of the given tables, counted here."""
    import os

    import numpy as np

    path = f"/root/testdata/sf{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    counts = [Counter(), Counter(), Counter()]
    for r in spark.read.parquet(path).select("doc_id", "text").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            t = [END, END, *(w.decode() for w in (r.text or "").encode().lower().split()), END]
            for m in range(3):
                counts[m].update(tuple(t[i - m : i + 1]) for i in range(2, len(t)))
    for c in counts:
        h = katz.counts_of_counts(np.array(list(c.values())))
        assert katz.good_turing(h) is not None
        assert katz.discounts(h) == pytest.approx(plain_discounts(list(c.values())))


def test_what_travels_and_stays_is_little(spark, monkeypatch):
    """Answers hold what blocks don't know, hashes go once they have been asked for: bytes for each token, of order 3."""
    import numpy as np

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, 200), 5_000)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    held, stages = Counter(), []
    original = katz.staged

    def counted(df, tag, by):
        found = original(df, tag, by)
        for r in found[0].groupBy("kind").agg(F.sum(F.length("blob")).alias("n")).collect():
            held["answers" if r.kind in ("answer", "sums") else r.kind] += r.n
        stages.append(tag)
        if tag == "katz-2":
            name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("katz_blocks") and t.name not in before)
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{katz.shared_dir(spark)}/{name}")
            files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            held["blocks"] = files.getContentSummary(path).getLength()
        return found

    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(katz, "staged", counted)
    got = katz.score(docs, fold(F.col("doc_id"), 5) != 1, order=3).collect()
    assert stages == ["katz-1", "katz-2", "katz-3"] and len(got) == len(texts)
    tokens = sum(r.n_tokens for r in got)
    assert held["answers"] < 1.5 * tokens, held
    assert held["blocks"] < 3 * tokens, held


def test_identities_and_steps():
    import numpy as np

    rng = np.random.default_rng(1)
    for top in (1 << 8, 1 << 34, 1 << 63):
        ids = np.unique(rng.integers(0, top, 1_000).astype(np.uint64))
        assert (katz.joined(*katz.halves(ids)) == ids).all()
        assert len(katz.joined(*katz.halves(ids[:0]))) == 0
    size = np.array([0, 3, 0, 1, 2])
    a = np.array([5, 6, 9, 2, 0, 7])
    assert katz.summed_steps(katz.steps(a, np.repeat(np.arange(5), size)), size).tolist() == a.tolist()
    big = [np.zeros(1_000, np.int64), rng.integers(0, 1 << 20, 1_000), rng.integers(0, 1 << 63, 1_000).astype(np.uint64), rng.random(1_000)]
    assert [x.tolist() for x in katz.unpack(katz.pack(*big))] == [x.tolist() for x in big]
    assert len(katz.pack(big[0])) < 10


def test_number_tells_count():
    import numpy as np

    counts = [np.array([9, 9, 3, 1, 1, 0]), np.array([], np.int64), np.array([7, 2])]
    distinct, words = zip(*[[x[::-1] for x in np.unique(c, return_counts=True)] for c in counts], strict=True)
    uni = katz.Unigrams.of(np.zeros(len(katz.EDGES) - 1, np.int64), 32, 7, np.array([6, 0, 2]), list(distinct), list(words))
    number = np.array([rank * 3 + k for k, c in enumerate(counts) for rank in range(len(c))])
    assert uni.counts(number).tolist() == [9, 9, 3, 1, 1, 0, 7, 2]
