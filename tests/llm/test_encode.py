import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodeweave.llm.encode import cut_points, encode_corpus, repair
from lodeweave.llm.vocab import TOKENIZER_DIR, encode, encoder

SCHEMA = "doc_id long, text string, id int, whole string, piece string, ids string"


@pytest.fixture(scope="module")
def enc():
    return encoder(TOKENIZER_DIR)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], SCHEMA)
    return [(r.doc_id, r.ids) for r in encode_corpus(df, **kw).collect()]


def texts():
    rng = random.Random(3)
    words = ["alpha", "beta's", "  ", "\n\n", "I'll", "42", "naïve", "数据", "😀", "...", "<|endoftext|>", "\x00", "�", "x" * 30]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(30)]
    return [*out, "a" * 5000, "数" * 3000, " " * 4000, "\n" * 900 + "x", "word " * 2000, "", "   ", "<|endoftext|>"]


def test_ids_equal_whole_encoding(spark, enc):
    rows = [*enumerate(texts()), (900, None)]
    rows += [(1000 + i, t[:200] + " changed " + t[200:]) for i, t in enumerate(texts()[:10])]
    small = dict(mean_bytes=64, min_bytes=32, max_bytes=256)
    want = {i: enc.encode_ordinary(t or "") for i, t in rows}
    assert dict(run(spark, rows, **small)) == want
    assert dict(run(spark, rows)) == want


def test_repeated_rows_and_null_ids(spark, enc):
    rows = [(1, "same text"), (1, "same text"), (2, ""), (2, None), (None, "a"), (None, "b"), (3, "x " * 400), (3, "x " * 400)]
    got = sorted(run(spark, rows), key=str)
    assert [i for i, _ in got].count(1) == 1 and [i for i, _ in got].count(3) == 1 and [i for i, _ in got].count(None) == 2
    assert all(ids == [] for i, ids in got if i == 2)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_copies_share_chunks():
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(2000)).encode()
    data = np.frombuffer(base + b"CHANGED START " + base, np.uint8)
    n = len(base)
    a, b = cut_points(data, np.array([0, n]), np.array([n, len(data)]), 256, 64, 4096)
    first = {base[i:j] for i, j in zip([0, *a], [*a, n])}
    raw = data.tobytes()
    second = {raw[i:j] for i, j in zip([n, *b], [*b, len(raw)])}
    assert len(first & second) >= 0.9 * len(first)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(min_size=2, max_size=60), st.data())
def test_seams_are_repaired(enc, text, data):
    text = "Before it. " + text + " after it"
    cut = data.draw(st.integers(1, len(text) - 1))
    tokens = [enc.decode_single_token_bytes(i) for i in range(enc.max_token_value + 1)] if not hasattr(test_seams_are_repaired, "t") else test_seams_are_repaired.t
    test_seams_are_repaired.t = tokens
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    left, right = (encode(enc, t).astype(np.int32) for t in (text[:cut], text[cut:]))
    a, b = repair(enc, left, right, tokens)
    assert [*a.tolist(), *b.tolist()] == enc.encode_ordinary(text)
