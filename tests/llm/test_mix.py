import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeweave.llm.mix import flight, land, mix_sources
from lodeweave.llm.vocab import TOKENIZER_DIR, encoder


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 500)), min_size=1, max_size=80), st.integers(0, 9))
def test_flight_keeps_the_totals(units, seed):
    p, size = np.array([u[0] for u in units]), np.array([float(u[1]) for u in units])
    q = flight(p, size, np.random.default_rng(seed))
    assert ((q > 0) & (q < 1)).sum() <= 2 and q.min() >= 0 and q.max() <= 1
    assert abs(q.sum() - p.sum()) < 1e-6 * len(p) and abs(q @ size - p @ size) < 1e-6 * (1 + size.sum())
    assert set(land(q, size).tolist()) <= {0.0, 1.0}


def mixed(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*r, 1, 2.0) for r in docs], "doc_id long, text string, source string, size int, p double")
    t = spark.createDataFrame(targets, "source string, target_share double, max_uses int")
    uses, report = mix_sources(d, t, **kw)
    return {r.doc_id: r.uses for r in uses.collect()}, {r.source: r for r in report.collect()}


def test_shares_and_caps(spark):
    docs = [(i, "some words here " * (1 + i % 9), " Big " if i % 2 else "BIG") for i in range(300)]
    docs += [(1000 + i, "small source text " * 4, "small") for i in range(10)] + [(2000 + i, "unlisted", "other") for i in range(5)] + [(3000, "x", None), (3001, None, "big"), (3002, "", "big")]
    targets = [("big", 0.6, 2), ("small", 0.3, 3), ("absent", 0.1, 5)]
    enc = encoder(TOKENIZER_DIR)
    size = {i: len(enc.encode_ordinary(t or "")) for i, t, _ in docs}
    total = sum(size[i] for i, _, s in docs if s and s.strip().lower() in ("big", "small"))
    for block in (4096, 16):
        uses, report = mixed(spark, docs, targets, block=block)
        assert set(uses) == {i for i, _, s in docs if s and s.strip().lower() in ("big", "small")}
        assert {s for s, r in report.items() if r.short} == {"small", "absent"}
        assert all(uses[1000 + i] == 3 for i in range(10)) and max(uses.values()) <= 3
        big = sum(n * size[i] for i, n in uses.items() if i < 1000 or i > 3000)
        assert report["big"].used == big and abs(big - 0.6 * total) <= 2 * max(size.values())
        assert report["absent"].used == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_short_is_read_off_the_sample(spark, monkeypatch):
    docs = [(i, f"text {i} of the small source", "small") for i in range(9)] + [(100 + i, "other words here " * 9, "big") for i in range(50)]
    targets = [("small", 0.5, 2), ("big", 0.5, 1), ("blank", 0.1, 3), ("unwanted", 0.0, 3)]
    docs += [(500, None, "blank"), (501, "", "blank"), (600, "x", "unwanted")]
    assert {s for s, r in mixed(spark, docs, targets)[1].items() if r.short} == {"small", "blank"}
    # a flight that takes nothing leaves no source short: the rows come from the sample
    monkeypatch.setattr("lodeweave.llm.mix._fly", lambda last, seed: lambda key, rows: rows.assign(p=0.0))
    docs = [(i, f"text {i} of the small source", "small") for i in range(9)] + docs[9:]
    assert not mixed(spark, docs, [("big", 0.5, 1)])[1]["big"].short


def test_null_ids_are_documents_by_their_text(spark):
    docs = [(None, "one two three", "a"), (None, "four five six", "a"), (None, "one two three", "a"), (1, "x", "a"), (1, "x", "a")]
    _, report = mixed(spark, docs, [("a", 1.0, 1)])
    assert report["a"].documents == 3 and report["a"].used == report["a"].tokens == 7 and report["a"].share_of_total == 1


def test_fractions_next_to_whole_numbers():
    p = flight(np.full(500, 1 - 1e-12), np.arange(500.0), np.random.default_rng(1))
    assert land(p, np.arange(500.0)).sum() == 500


def test_empty_tables(spark):
    uses, report = mixed(spark, [], [("a", 0.5, 1)])
    assert uses == {} and report["a"].actual_share is None and not report["a"].short
    uses, report = mixed(spark, [(1, "x", "a")], [])
    assert uses == {} and report == {}
