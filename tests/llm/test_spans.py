import random

import numpy as np

import lodeweave.llm.spans as spans
from lodeweave.llm import queries
from lodeweave.llm.spans import pieces, portions, record_pairs, rolling, shared_stretches, span_classes

SCHEMA = "finding_id long, text string, quote string, id string, s string, sid long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def brute(rows, least):
    grams, fields = {}, {}
    for i, *fs in rows:
        for name, s in zip(("text", "quote"), fs):
            if i is not None and s is not None and len(s) >= least:
                fields.setdefault(i, {})[name] = s
                for k in range(len(s) - least + 1):
                    grams.setdefault(s[k : k + least], set()).add(i)
    pairs = {(a, b) for g in grams.values() for a in g for b in g if a < b}
    portions = {}
    for i, fs in fields.items():
        for name, s in fs.items():
            on = set()
            for k in range(len(s) - least + 1):
                if grams[s[k : k + least]] - {i}:
                    on |= set(range(k, k + least))
            portions[i, name] = len(on)
    return pairs, portions


def rows_with_repeats(seed, n):
    rng = random.Random(seed)
    stock = ["".join(rng.choices("abcdefgh é😀", k=rng.randint(15, 50))) for _ in range(6)]
    out = []
    for i in range(n):
        part = lambda: "".join(rng.choice([rng.choice(stock), "".join(rng.choices("abcdefgh ", k=rng.randint(1, 12)))]) for _ in range(rng.randint(0, 4)))
        out.append((i, part(), rng.choice([None, "", part()])))
    return out


def stretches(rows, least):
    """{(text of the field, start, length)}: runs of windows held by one set of strings of two or more records."""
    holders, grams = {}, {}
    for i, *fs in rows:
        for s in fs:
            if i is not None and s is not None and len(s) >= least:
                holders.setdefault(s, set()).add(i)
    for s in holders:
        for k in range(len(s) - least + 1):
            grams.setdefault(s[k : k + least], set()).add(s)
    out = set()
    for s in holders:
        start = last = None
        for k in range(len(s) - least + 2):
            held = frozenset(grams[s[k : k + least]]) if k + least <= len(s) else frozenset()
            if len(held) < 2 or len(set().union(*(holders[x] for x in held))) < 2:
                held = None
            if held != last:
                if last:
                    out.add((s, start, k - 1 - start + least))
                start, last = k, held
    return out


def run(spark, rows, least):
    found = shared_stretches(frame(spark, rows), "finding_id", ["text", "quote"], least=least)
    text = {(r[0], f): s for r in rows for f, s in zip(("text", "quote"), r[1:])}
    spans, by = set(), {}
    for r in span_classes(found)[0].collect():
        s = text[r.rep_id, r.rep_field]
        spans.add((s, r.start, r.length))
        by.setdefault(r.stretch, set()).add(s[r.start : r.start + r.length])
    assert spans == stretches(rows, least) and all(len(x) == 1 for x in by.values())
    return {tuple(r) for r in record_pairs(found).collect()}, {(r.id, r.field): r.shared for r in portions(found).collect()}


def test_against_brute_force(spark):
    rows = rows_with_repeats(1, 60)
    assert run(spark, rows, 20) == brute(rows, 20)


def test_small_pieces_full_bitmaps_and_small_blocks_give_the_same(spark, monkeypatch):
    rows = rows_with_repeats(2, 50)
    monkeypatch.setattr(spans, "BITS_MOST", 64)
    monkeypatch.setattr(spans, "BITS_LEAST", 64)
    monkeypatch.setattr(spans, "PAGE", 2)
    monkeypatch.setattr(spans, "BLOCK", 3)
    assert run(spark, rows, 20) == brute(rows, 20)


def test_one_passage_in_most_records(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    hot = word(40)
    rows = [(i, word(rng.randint(0, 30)) + hot + word(rng.randint(0, 30)), None) for i in range(300)] + [(1000 + i, word(60), hot) for i in range(20)]
    assert run(spark, rows, 30) == brute(rows, 30)


def test_long_strings_are_cut_into_overlapping_pieces():
    rng = random.Random(4)
    strings = ["".join(rng.choices("ab\U0001f600", k=n)) for n in (0, 5, 230, 64, 1, 100)]
    seen, points = {}, 0
    for p, row, pos, room, own in pieces(strings, 10, 20, step=60):
        points += len(p)
        h = rolling(p, 20) if len(p) >= 20 else []
        for i in np.flatnonzero((room >= 20) & own):
            assert seen.setdefault((int(row[i]), int(pos[i])), int(h[i])) == int(h[i])
    want = {(r, k): int(rolling(np.frombuffer(s[k : k + 20].encode("utf-32-le"), np.uint32), 20)[0]) for r, s in enumerate(strings) for k in range(len(s) - 19)}
    assert seen == want and points > sum(map(len, strings))


def test_dirt(spark):
    s = "the very same stretch of letters, long enough to count"
    rows = [(1, s, s), (1, s, s), (2, "x" + s, None), (3, None, ""), (4, s, "no"), (None, s, s), (5, s[:19], s[:19])]
    pairs, portions = run(spark, rows, 20)
    assert (pairs, portions) == brute(rows, 20) and pairs == {(1, 2), (1, 4), (2, 4)}


def test_own_fields_share_nothing_alone(spark):
    s = "the very same stretch of letters, long enough to count"
    assert run(spark, [(1, s, s + "!")], 20) == (set(), {(1, "text"): 0, (1, "quote"): 0})


def test_empty_table(spark):
    assert run(spark, [], 60) == (set(), {})


def test_rolling_hash_tells_windows_apart():
    x = np.frombuffer("abcabcabcdabcabcabc".encode("utf-32-le"), np.uint32)
    for width in (1, 2, 5, 9):
        h, t = rolling(x, width), "abcabcabcdabcabcabc"
        same = {}
        for k in range(len(t) - width + 1):
            same.setdefault(t[k : k + width], set()).add(int(h[k]))
        assert len(h) == len(t) - width + 1 and all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_members_give_all_fields_that_share(spark):
    rows = rows_with_repeats(3, 40)
    rows += [(100 + i, rows[1][1], rows[2][1]) for i in range(3)]  # equal strings
    found = shared_stretches(frame(spark, rows), "finding_id", ["text", "quote"], least=20)
    spans_, members = (x.collect() for x in span_classes(found))
    text = {(r[0], f): s for r in rows for f, s in zip(("text", "quote"), r[1:])}
    part = brute(rows, 20)[1]
    assert {(r.id, r.field) for r in members} >= {k for k, n in part.items() if n}
    for r in members:
        assert text[r.id, r.field] == text[r.rep_id, r.rep_field] and len(text[r.id, r.field]) == r.length
    assert {(r.rep_id, r.rep_field) for r in spans_} <= {(r.rep_id, r.rep_field) for r in members}


def test_queries_give_spans_and_short_fields(spark, tmp_path):
    s = "the very same stretch of letters, which is long enough to count as a case of it"
    rows = [(1, s, "short"), (2, "x" + s, None), (3, s, ""), (4, "other", None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/review_findings.parquet")
    run = lambda name: {tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    n = len(s)
    assert {r[1:] for r in run("p5_spans")} == {(1, "text", 0, n), (2, "text", 1, n)} and len({r[0] for r in run("p5_spans")}) == 1
    assert run("p5_members") == {(1, "text", 1, "text", n), (1, "text", 3, "text", n), (2, "text", 2, "text", n + 1)}
    assert run("p5_portions") == {(1, "text", n, n), (2, "text", n + 1, n), (3, "text", n, n), (1, "quote", 5, 0), (3, "quote", 0, 0), (4, "text", 5, 0)}
