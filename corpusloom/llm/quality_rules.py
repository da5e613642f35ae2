"""Quality rules: an isolation forest on rule statistics, with its threshold calibrated from labelled rows.

Every whole text is reduced to statistics of the kind that quality rules bound (symbols, letters, repeated
words, word lengths). Random splits isolate odd documents after few steps; the mean path length over the
trees gives the anomaly score of Liu, Ting and Zhou. Each tree is grown on PER_TREE rows of a bounded sample of
the labelled documents (SAMPLE_ROWS, those with the least hash of their id), which also calibrate the threshold:
the highest Youden index among thresholds that keep at least KEEP_GOOD of the good rows. Statistics, base rules
and verdicts are computed for every row of the table.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Words are split at
ASCII white space only. Without labelled rows of both kinds no document is rejected by the forest. Repeated
rows and null ids are judged like others. Labels that repeat an id count each. Of a very long text every word counts; memory
holds one text and its words. An empty table gives an empty result. Other columns are ignored, and columns of the
result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import free, fresh

TREES, PER_TREE = 200, 256
SAMPLE_ROWS = 20_000
KEEP_GOOD = 0.995
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "bars", "punctuation", "letters", "mean_word", "repeat_words", "top_word")
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_ALPHA = np.r_[65:91, 97:123]


def repeated_words(ids: np.ndarray) -> int:
    """Words inside a 3-word window that the text has twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    top = int(ids.max()) + 1
    if top < 1 << 21:
        key = (ids[:-2] * top + ids[1:-1]) * top + ids[2:]
    else:  # so many words that three ids don't fit one integer
        pair = np.unique(ids[:-1] * top + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * top + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def statistics(raw: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """STATS and FEATURES of a text in UTF-8."""
    words = raw.split()
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(count.sum() - count[0x80:0xC0].sum())
    chars = points - int(count[SPACE].sum())
    symbols = int(count[SYMBOLS].sum())
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeat = repeated_words(ids)
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    if not n:
        return (0, 0, symbols, 0, 0), (0.0,) * len(FEATURES)
    c = max(1, chars)
    top = int(np.bincount(ids).max())
    features = (
        symbols / c, int(count[124]) / n, int(count[PUNCTUATION].sum()) / n, (int(count[_ALPHA].sum()) + int(count[0xC0:].sum())) / c,
        min(chars / n, 40.0), repeat / n, top / n if n >= 20 else 0.05,
    )
    return (n, chars, symbols, dup, repeat), features


class IsolationForest:
    """Trees as flat arrays: split feature, split value, children; path lengths at leaves."""

    def __init__(self, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 0):
        self.trees, self.per_tree, self.seed = trees, per_tree, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def _mean_path(n: int) -> float:
        """Mean length of an unsuccessful search in a binary tree of n rows."""
        if n < 2:
            return 0.0
        return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        m = min(self.per_tree, len(x))
        self.norm = max(self._mean_path(m), 1e-9)
        limit = int(np.ceil(np.log2(max(m, 2))))
        for _ in range(self.trees):
            feature, value, left, right, path = [], [], [], [], []

            def grow(rows: np.ndarray, depth: int) -> int:
                i = len(feature)
                for a in (feature, value, left, right, path):
                    a.append(0)
                spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(x.shape[1])
                usable = np.flatnonzero(spread > 0)
                if depth >= limit or len(rows) < 2 or not len(usable):
                    feature[i], path[i] = -1, depth + self._mean_path(len(rows))
                    return i
                f = int(rng.choice(usable))
                v = float(rows[:, f].min() + rng.random() * spread[f])
                feature[i], value[i] = f, v
                low = rows[:, f] < v
                left[i], right[i] = grow(rows[low], depth + 1), grow(rows[~low], depth + 1)
                return i

            grow(x[rng.choice(len(x), m, replace=False)], 0)
            self.nodes.append((np.array(feature), np.array(value, float), np.array(left), np.array(right), np.array(path, float)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores: near 1 odd, under 0.5 ordinary."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, right, path in self.nodes:
            at = np.zeros(len(x), np.int64)
            live = rows
            while len(live):
                f = feature[at[live]]
                live = live[f >= 0]
                if not len(live):
                    break
                here = at[live]
                at[live] = np.where(x[live, feature[here]] < value[here], left[here], right[here])
            total += path[at]
        return np.exp2(-total / max(1, len(self.nodes)) / self.norm)


def calibrate(score: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The score above which documents are rejected; infinite if the labels show no use of one."""
    if good.all() or not good.any():
        return float("inf")
    order = np.argsort(-score, kind="stable")
    s, g = score[order], good[order]
    lost, caught = np.cumsum(g) / good.sum(), np.cumsum(~g) / (~good).sum()
    ends = np.concatenate([s[1:] != s[:-1], [True]])  # equal scores go together
    allowed = ends & (lost <= 1 - keep_good)
    if not allowed.any():
        return float("inf")
    gain = np.where(allowed, caught - lost, -1.0)
    i = int(gain.argmax())
    if gain[i] <= 0:
        return float("inf")
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else s[i] - 1e-9)) / 2)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _raw(text_col: str):
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__raw")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[IsolationForest, float]:
    """The forest and its threshold, from at most sample_rows labelled documents."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label")).orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample_rows)
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(r.as_py()) for r in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f for _, f in got], pa.list_(pa.float64())), pa.array([base_failed(s[0], s[4]) for s, _ in got]), b.column(1)], ["f", "base", "label"])

    got = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(_raw(text_col), "__label").mapInArrow(run, "f array<double>, base boolean, label int").toPandas()
    forest = IsolationForest()
    got = got[~got["base"].astype(bool)] if len(got) else got  # the forest judges what the base rules leave
    if not len(got):
        return forest, float("inf")
    x = np.array(got["f"].tolist(), float).reshape(-1, width)
    order = np.lexsort(x.T[::-1])  # the same forest however the rows arrive
    x, good = x[order], got["label"].to_numpy()[order] > 0
    forest.fit(x)
    return forest, calibrate(forest.score(x), good)


def judge(docs: DataFrame, model: tuple[IsolationForest, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """id_col and keep of every row; the statistics, base_failed, anomaly and kept, their names after prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees * 2 * per_tree nodes
    added = [prefix + x for x in (*STATS, "base_failed", "anomaly", "kept")]
    cols = [c for c in dict.fromkeys([id_col, *keep]) if c.lower() not in added]  # columns of the result's names are replaced
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), *(f"`{x}` {k}" for x, k in zip(added, [*["bigint"] * len(STATS), "boolean", "double", "boolean"], strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, most = shared.value
        for b in batches:
            got = [statistics((r.as_py() or "").encode() if at < len(cols) else r.as_py()) for r in b.column(at)]
            s = np.array([x for x, _ in got], np.int64).reshape(-1, len(STATS))
            base = (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])
            score = forest.score(np.array([f for _, f in got], float).reshape(-1, len(FEATURES))) if forest.nodes else np.zeros(len(s))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], *(pa.array(s[:, i]) for i in range(len(STATS))), pa.array(base), pa.array(score), pa.array(~base & (score <= most))], [*cols, *added])
        free()

    # a text that is kept anyway isn't sent twice
    at = cols.index(text_col) if text_col in cols else len(cols)
    return docs.select(*(F.col(f"`{c}`") for c in cols), *[_raw(text_col).alias(fresh(cols, "__raw"))] * (at == len(cols))).mapInArrow(run, schema)
