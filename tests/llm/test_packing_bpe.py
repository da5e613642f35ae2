import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from corpusloom.llm.bytebpe import ByteBPE, round_trip
from corpusloom.llm.packing import Packer, classes, encoder, pack
from corpusloom.llm.queries import tokenizer_path

TEXTS = ["", " ", "  a  b\n\n", "don't I'll", "\x1c\x85\u00a0\u3000x", "é😀\u200d👩", "<|endoftext|>", "a<|endoftext|>b <|endoftext", "a" * 5000, " " * 3000, "ǅ①²٣ 12345", "\x00\x01", "the the the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("text", TEXTS)
def test_both_encoders_equal_the_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    bpe = ByteBPE(tokenizer_path())
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == want
    assert encoder(tokenizer_path())(text).tolist() == want
    assert bpe.decode(bpe.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_random_strings_equal_the_library(library):
    rng = np.random.default_rng(0)
    bpe = ByteBPE(tokenizer_path())
    for _ in range(300):
        text = "".join(chr(c) for c in rng.choice([*range(32, 127), 9, 10, 0x85, 0xA0, 0xE9, 0x301, 0x4E2D, 0x1F600, 0x2028], rng.integers(0, 60)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_white_space_of_every_kind_equals_the_library(library):
    rng = np.random.default_rng(1)
    encode = encoder(tokenizer_path())
    for _ in range(2000):
        text = "".join(rng.choice(list("  \n\t\r\u00a0\u3000\x1c\x85ab'1.é"), rng.integers(0, 14)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(spark, docs, corpus, empty, library):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(docs, tokenizer_path()).collect())
    want = []
    for i, t in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert round_trip(empty, tokenizer_path()).collect() == []


def check(rows, docs_ids, capacity):
    """rows (doc, start, ids, total, sequence, offset): every id once, sequences gapless and padded by little."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, ids, total, sequence, offset in rows:
        assert len(ids) > 0
        by_doc[doc].append((start, ids, total))
        by_sequence[sequence].append((offset, len(ids)))
    for doc, want in docs_ids.items():
        at = 0
        for start, ids, total in sorted(by_doc[doc], key=lambda x: x[0]):
            assert start == at and total == len(want) and ids == want[start : start + len(ids)]
            at += len(ids)
        assert at == len(want)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 2048])
def test_packer(capacity):
    rng = np.random.default_rng(capacity)
    docs = {i: rng.integers(0, 9, int(rng.integers(0, 3 * capacity + 2))).tolist() for i in range(200)}
    p = Packer(capacity)
    for i, ids in docs.items():
        p.add(i, np.array(ids, "<u4"))
    p.finish()
    rows = [(d, s, np.frombuffer(raw, "<u4").tolist(), t, q, o) for d, s, n, raw, t, q, o in p.rows()]
    docs = {i: x for i, x in docs.items() if x}
    padding = check(rows, docs, capacity)
    assert padding <= 0.01 * sum(map(len, docs.values())) + 1
    full = Counter(q for *_, q, _ in rows)
    assert all(n <= capacity for n in full.values())


def test_classes_have_fixed_counts():
    for n in classes(2048):
        assert 2048 - n * (2048 // n) <= 8


def test_pack_query_columns(spark, corpus, empty, library):
    rows = [(i, t) for i, (_, t) in enumerate(corpus)]  # ids that tell repeated rows apart
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.doc_tokens, r.sequence_id, r.offset) for r in pack(df, tokenizer_path(), 256).collect()]
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    assert check(got, want, 256) <= 0.02 * sum(map(len, want.values()))
    assert pack(empty, tokenizer_path()).collect() == []


def test_every_code_point_equals_the_library(library):
    """All of Unicode, between letters, after spaces and before digits."""
    bpe, fast = ByteBPE(tokenizer_path()), encoder(tokenizer_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 2048):
        text = "".join(f"a{chr(c)}b  {chr(c)} 1{chr(c)}" for c in points[i : i + 2048])
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == want
        assert fast(text).tolist() == want
