import random

import pytest

LONG = "".join(f"w{i % 977}x " for i in range(40_000))


def words(rng, n, vocab=300):
    return " ".join(f"t{int(vocab * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with copies, near copies, shared lines, odd texts and null ids."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        out.append("\n".join(words(rng, rng.randint(3, 60)) for _ in range(rng.randint(1, 5))))
    for i in range(15):  # near copies: a word changed here and there
        base = out[i].split(" ")
        for _ in range(max(1, len(base) // 60)):
            base[rng.randrange(len(base))] = f"n{i}"
        out.append(" ".join(base))
    out += [out[3]] * 12 + [out[7].upper()] * 2
    out = [t + "\n Shared LINE here \n" if i % 3 == 0 else t for i, t in enumerate(out)]
    out += ["", None, " \n\t \n", "one", "one two", "ONE two", "é😀 ünï\u00a0code\x1c x", "a" * 3000, LONG, "<|endoftext|> x <|endoftext|>", "x\r\ny\r\n"]
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [(None, "a null id with some words in it"), (None, None), rows[0], rows[0]]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names operators use themselves."""
    rows = [(i, t, "x", 1.5, 7, "s") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string, score double, n_words int, source string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
