"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters are found in the labelled training rows: words (lexicon) and word prefixes (patterns) that mark toxic
   rows by being there, or by being dense there (DENSE_HITS and DENSE_SHARE of the words). They are counted in
   Spark, then chosen greedily by the toxic rows they newly cover against others they hit. Three
   fixed patterns (shouting, runs of exclamation marks, stretched letters) vote as well.
2. The label model sees each voter as a noisy witness of a hidden class. It is estimated on every document that
   `train` admits, labelled or not: Spark counts the documents of each pattern of votes, and each EM round is one pass
   over these patterns that returns a few sums. Labels only give the rates that EM starts from; a label is no witness,
   so a wrong one is overruled. From the residual correlations within the classes each voter gets the weight
   1 / sum of its correlations, so that voters that say the same count once.
3. A logistic regression on votes and hit counts learns the posterior labels; it scores every whole text.

Rows for 1 and 3 are a bounded sample (SAMPLE_ROWS, least hash of the id) of the labelled rows that `train`
admits. Labels, language, source and ids are never inputs of a score.

Defined results: a null text is an empty one, which gets the score of a text without votes. Without labelled
rows of both kinds every score is the share of toxic rows (0 if there are none). Null ids and repeated rows are
scored like others; of several labels of one id each counts. Of a very long text all words count; memory holds one text
and its words. An empty table has no scores, and a model fitted on it gives 0. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, free, fresh

SAMPLE_ROWS = 20_000
CANDIDATES, VOTERS = 1_500, 64
PREFIXES = (3, 4, 5, 6, 7)
MIN_HITS = 4
DENSE_HITS, DENSE_SHARE = 2, 0.01
ROUNDS, CORRELATED_FROM, ANCHOR = 20, 5, 5.0
PATTERNS_HELD = 50_000
PATTERNS_A_TASK = 500_000
CACHE_WORDS = 250_000
WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"\b[A-Z]{4,}\b")
BANG = re.compile(r"[!?]{3,}")
STRETCH = re.compile(r"([^\W\d_])\1{3,}")
PATTERNS = (SHOUT, BANG, STRETCH)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def marks(word: str) -> list[str]:
    """What a word can be recognised by: itself ("=word") and its prefixes ("^pre"). A voter's name is such a mark,
    or one with "*" at its end if it votes for dense marks only."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


class _Hits(dict):
    """word -> indexes of the voters it hits, remembered up to a bound."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.lengths = sorted({len(m) - 1 for m in index if m[0] == "^"})

    def __missing__(self, word: str) -> tuple[int, ...]:
        get = self.index.get
        found = [get("=" + word)] + [get("^" + word[:n]) for n in self.lengths if len(word) > n]
        out = tuple(i for i in found if i is not None)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out
        return out


@dataclass
class Model:
    voters: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    prior: float = 0.0
    labels: LabelModel | None = None

    def __post_init__(self):
        self._hits = None
        self.base = list(dict.fromkeys(v.rstrip("*") for v in self.voters))
        at = {m: i for i, m in enumerate(self.base)}
        self.of = np.array([at[v.rstrip("*")] for v in self.voters], int)
        self.dense = np.array([v.endswith("*") for v in self.voters], bool)

    def __getstate__(self):
        return self.__dict__ | {"_hits": None}

    def forget(self) -> None:
        """Drops the words remembered: a worker keeps the model for later tasks."""
        self._hits = None

    def counts(self, text: str) -> np.ndarray:
        """Hits of each mark, then of the fixed patterns, then the number of words."""
        if self._hits is None:
            self._hits = _Hits({m: i for i, m in enumerate(self.base)})
        out = np.zeros(len(self.base) + len(PATTERNS) + 1)
        words = words_of(text)
        for hit in filter(None, map(self._hits.__getitem__, words)):
            for i in hit:
                out[i] += 1
        out[len(self.base) : -1] = [sum(1 for _ in p.finditer(text)) for p in PATTERNS]
        out[-1] = len(words)
        return out

    def votes(self, counts: np.ndarray) -> np.ndarray:
        """Rows x (voters, fixed patterns)."""
        hits, n = counts[:, self.of], np.maximum(counts[:, -1:], 1)
        learned = np.where(self.dense, (hits >= DENSE_HITS) & (hits >= DENSE_SHARE * n), hits > 0)
        return np.column_stack([learned, counts[:, len(self.base) : -1] > 0])

    def inputs(self, counts: np.ndarray) -> np.ndarray:
        """Inputs of the classifier: 1, each vote, whether any learned voter votes, log of all hits, their share."""
        votes = self.votes(counts)
        hits = counts[:, : len(self.base)].sum(1)
        share = np.minimum(hits / np.maximum(counts[:, -1], 1), 0.1) * 10
        return np.column_stack([np.ones(len(counts)), votes, votes[:, : len(self.voters)].any(1), np.log1p(hits), share]).astype(float)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(counts), self.prior)
        return _sigmoid(self.inputs(counts) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _log_odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


@dataclass
class LabelModel:
    """How votes come about: a class, toxic or clean; whether any learned voter votes at all; then which ones do.

    Learned voters that don't vote abstain, since that a text lacks the words of one language says nothing about one
    in another; only that none of them votes is evidence. The fixed patterns are witnesses besides."""

    learned: int  # so many voters are learned, the others are fixed patterns
    prior: float
    any: np.ndarray  # share of texts that have a learned vote, in the clean and the toxic class
    rates: np.ndarray  # 2 x voters: how often each votes, a learned one among texts that have a learned vote
    weight: np.ndarray
    correlations: np.ndarray | None = None

    @classmethod
    def of(cls, votes: np.ndarray, toxic: np.ndarray, learned: int) -> LabelModel:
        """Where EM starts: the rates among labelled rows."""
        m = votes.shape[1]
        blank = cls(learned, 0.5, np.array([0.5, 0.5]), np.full((2, m), 0.5), np.ones(m))
        return blank.updated(_moments(votes, np.ones(len(votes)), toxic.astype(float), learned), None)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is toxic."""
        v = votes.astype(float)
        some = v[:, : self.learned].any(1)
        z = np.where(some, np.log(self.any[1] / self.any[0]), np.log((1 - self.any[1]) / (1 - self.any[0])))
        return _sigmoid(_log_odds(self.prior) + z + v @ (self.weight * np.log(self.rates[1] / self.rates[0])))

    def updated(self, sums: tuple[np.ndarray, ...], start: LabelModel | None) -> LabelModel:
        """The model of expected sums; start, the model that EM began with, counts as ANCHOR texts of each class."""
        texts, some, votes = sums
        tie = start or LabelModel(self.learned, 0.5, np.array([0.01, 0.5]), np.tile([[0.01], [0.05]], votes.shape[1]), self.weight)
        hold = ANCHOR if start else 1.0
        any_ = np.clip((some + hold * tie.any) / (texts + hold), 1e-6, 1 - 1e-4)
        base = np.where(np.arange(votes.shape[1]) < self.learned, some[:, None], texts[:, None])
        rates = np.clip((votes + hold * tie.rates) / (base + hold), 1e-6, 1 - 1e-6)
        return LabelModel(self.learned, float(np.clip(texts[1] / max(texts.sum(), 1e-9), 1e-4, 0.5)), any_, rates, self.weight, self.correlations)

    def correlated(self, both: np.ndarray, texts: np.ndarray) -> LabelModel:
        """With the weights that residual correlations within the classes give; both: 2 x voters x voters, expected
        numbers of texts on which two voters vote."""
        n = max(texts.sum(), 1.0)
        mean = np.array([np.diag(b) / max(t, 1e-9) for b, t in zip(both, texts, strict=True)])
        c = sum(b - t * np.outer(x, x) for b, t, x in zip(both, texts, mean, strict=True)) / n
        s = np.sqrt(np.maximum(np.diag(c), 1e-12))
        corr = np.clip(c / np.outer(s, s), -1, 1)
        strong = np.where(np.abs(corr) > 0.2, np.abs(corr), 0.0)
        np.fill_diagonal(strong, 1.0)
        np.fill_diagonal(corr, 1.0)
        return LabelModel(self.learned, self.prior, self.any, self.rates, 1 / strong.sum(1), corr)


def _moments(votes: np.ndarray, n: np.ndarray, q: np.ndarray, learned: int, both: bool = False) -> tuple[np.ndarray, ...]:
    """Expected numbers in the clean and toxic class of texts, of texts with a learned vote and of each voter's votes;
    with both, of each two voters' in place of these. votes: rows of n texts each, q: probability of toxic."""
    v = votes.astype(float)
    w = np.array([n * (1 - q), n * q])
    return w.sum(1), w @ v[:, :learned].any(1), np.array([(v * x[:, None]).T @ v for x in w]) if both else w @ v


def estimate(expect, start: LabelModel, rounds: int = ROUNDS) -> LabelModel:
    """EM from start. expect(model, both) gives _moments() of all texts under the model."""
    model = start
    for step in range(rounds):
        if step == CORRELATED_FROM:
            texts, _, pairs = expect(model, True)
            model = model.correlated(pairs, texts)
        new = model.updated(expect(model, False), start)
        moved = max(np.abs(new.any - model.any).max(), np.abs(new.rates - model.rates).max(), abs(new.prior - model.prior))
        model = new
        if step > CORRELATED_FROM and moved < 1e-4:
            break
    return model


def vote_patterns(docs: DataFrame, voters: Model, text_col: str) -> DataFrame:
    """(votes binary, n bigint): how many documents have each pattern of votes, as packed bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])
            seen.clear()
            return out

        for b in batches:
            counts = np.array([voters.counts(t.as_py()) for t in b.column(0)]).reshape(b.num_rows, -1)
            seen.update(x.tobytes() for x in np.packbits(voters.votes(counts).astype(bool), axis=1))
            if len(seen) > PATTERNS_HELD:
                yield flush()
        yield flush()
        voters.forget()
        free()

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, "votes binary, n bigint")
    counted = cut(rows.groupBy("votes").agg(F.sum("n").alias("n")))
    # as few tasks as the patterns need, however many partitions the documents came from: each gives the driver a row a round of EM
    return cut(counted.repartition(1 + counted.count() // PATTERNS_A_TASK))


def _expected(patterns: DataFrame, voters: int):
    """estimate()'s expect over a table of patterns: one job a call, which returns one row a partition."""
    def expect(model: LabelModel, both: bool) -> tuple[np.ndarray, ...]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    v = np.unpackbits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)[:, :voters]
                    part = _moments(v, b.column(1).to_numpy(zero_copy_only=False).astype(float), model.posterior(v), model.learned, both)
                    total = part if total is None else tuple(x + y for x, y in zip(total, part, strict=True))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in total], ["texts", "some", "votes"])

        got = patterns.mapInArrow(run, "texts array<double>, some array<double>, votes array<double>").collect()
        sums = [np.array(sorted(map(list, (r[i] for r in got)))).sum(0) for i in range(3)]  # the same however the rows arrive
        return sums[0], sums[1], sums[2].reshape((2, voters, voters) if both else (2, voters))

    return expect


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights by Newton's method for soft targets; the first input is the constant, which isn't held back."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        g = x.T @ (p - target) + hold * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        d = np.linalg.solve(h, g)
        w -= d * min(1.0, 4.0 / max(np.abs(d).max(), 1e-12))
        if np.abs(d).max() < 1e-6:
            break
    return w


def choose(hit: np.ndarray, toxic: np.ndarray, names: list[str], most: int) -> list[int]:
    """Voters, greedily by what each covers that fewer than two chosen ones cover: two witnesses for each row."""
    left = np.full(len(toxic), 2)
    chosen: list[int] = []
    stems = [x[1:].rstrip("*") for x in names]
    out = np.zeros(len(names), bool)
    cost = 3.0 * hit[~toxic].sum(0)
    base = hit[toxic].astype(np.float32)
    for _ in range(most):
        gain = (left[toxic] > 0).astype(np.float32) @ base - cost
        gain[out] = -1
        best = gain.max(initial=-1)
        if best < MIN_HITS:
            break
        # of equal gains the longest mark: it says most exactly what was seen
        i = max(np.flatnonzero(gain == best), key=lambda j: (len(names[j]), names[j]))
        chosen.append(int(i))
        left[hit[:, i]] -= 1
        # what holds a chosen mark, or is held by it, would be no other witness
        out |= np.array([s.startswith(stems[i]) or stems[i].startswith(s) for s in stems])
    return chosen


def sample(docs: DataFrame, labels: DataFrame, train: Column, label: str, sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """text and label of at most sample_rows labelled rows that train (a condition on id_col) admits."""
    chosen = labels.where(train & F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label")).orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample_rows)
    return docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col("__label") > 0).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of voters, label model and classifier; train, a condition on id_col, says which rows may teach it."""
    rows = cut(sample(docs, labels, train, label, sample_rows, id_col, text_col))
    n, pos = rows.select(F.count("*"), F.count(F.when(F.col("toxic"), 1))).first()
    if not pos or pos == n:
        return Model(prior=pos / n if n else 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = Counter(words_of(t.as_py()))
                n, here = sum(words.values()), Counter()
                for w, k in words.items():
                    for m in marks(w):
                        here[m] += k
                for m, k in here.items():
                    seen.setdefault(m, [0, 0])[y] += 1
                    if k >= DENSE_HITS and k >= DENSE_SHARE * n:
                        seen.setdefault(m + "*", [0, 0])[y] += 1
        names = list(seen)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"mark": part, "clean": pa.array([seen[m][0] for m in part], pa.int64()), "toxic": pa.array([seen[m][1] for m in part], pa.int64())})

    counted = rows.mapInArrow(count, "mark string, clean bigint, toxic bigint").groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    gain = F.col("toxic") - 3 * F.col("clean")
    top = [r.mark for r in counted.where((F.col("toxic") >= MIN_HITS) & (gain >= MIN_HITS)).orderBy(gain.desc(), "mark").limit(CANDIDATES).collect()]
    wide = Model(voters=top)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [wide.counts(t.as_py()).astype(np.int32).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), b.column(1)], ["counts", "toxic"])

    # first the votes of every candidate, as bits, to choose from; then the counts of the chosen
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.packbits(wide.votes(wide.counts(t.as_py())[None])[0, : len(top)]).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), b.column(1)], ["counts", "toxic"])

    if top:
        got = rows.mapInArrow(bits, "counts binary, toxic boolean").toPandas()
        hit = np.unpackbits(np.frombuffer(b"".join(got["counts"]), np.uint8).reshape(len(got), -1), axis=1)[:, : len(top)].astype(bool)
        wide = Model(voters=[top[i] for i in choose(hit, got["toxic"].to_numpy(bool), top, VOTERS)])
    got = rows.mapInArrow(hits, "counts binary, toxic boolean").toPandas()
    counts = np.frombuffer(b"".join(got["counts"]), np.int32).reshape(len(got), -1).astype(float)
    order = np.lexsort(np.column_stack([counts, got["toxic"]]).T)  # the same model however the rows arrive
    counts, y = counts[order], got["toxic"].to_numpy(bool)[order]
    votes = wide.votes(counts)
    patterns = vote_patterns(docs.where(train), wide, text_col)
    found = estimate(_expected(patterns, votes.shape[1]), LabelModel.of(votes, y, len(wide.voters)))
    return Model(wide.voters, logistic(wide.inputs(counts), found.posterior(votes)), float(y.mean()), found)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """keep and out, the score (0 to 1), of every row; a column to keep that is called like out is replaced."""
    keep = tuple(c for c in keep if c.lower() != out.lower())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOTERS voters
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            counts = np.array([m.counts(t.as_py() or "") for t in b.column(at)]).reshape(b.num_rows, -1)
            s = m.score(counts) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64())], [*keep, out])
        m.forget()
        free()

    # a text that is kept anyway isn't sent twice
    at = keep.index(text_col) if text_col in keep else len(keep)
    return docs.select(*(F.col(f"`{c}`") for c in keep), *[F.col(text_col).alias(fresh(keep, "__text"))] * (at == len(keep))).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` double"]))
