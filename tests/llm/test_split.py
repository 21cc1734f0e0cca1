import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodeweave.llm.split import split_oversized, cut_paragraphs

SCHEMA = "chunk_id string, text string, id string, v int, words string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)


def run(spark, rows, limit, overlap):
    pieces, paragraphs = split_oversized(frame(spark, rows), limit=limit, overlap=overlap)
    lost = {(r[0], r[1]) for r in cut_paragraphs(pieces, paragraphs, limit).collect()}
    out = {}
    for r in pieces.orderBy("chunk_id", "index").collect():
        out.setdefault(r.chunk_id, []).append(r)
    return out, lost


def check(pieces, text, limit, overlap):
    words = text.split()
    assert [p["index"] for p in pieces] == list(range(len(pieces)))
    assert pieces[0].fresh_word == 0 and pieces[-1].end_word == len(words)
    for a, b in zip(pieces, pieces[1:]):
        assert b.fresh_word == a.end_word and b.start_word == max(0, b.fresh_word - overlap)
    for p in pieces:
        assert p.text.split() == words[p.start_word : p.end_word] and p.end_word - p.start_word <= limit


def greedy(stops, n, limit, overlap):
    """Cuts by the rule, one after the other; stops: {word: 2 paragraph, 1 sentence}."""
    cuts, b = [], 0
    while b < n:
        reach = b + limit if b == 0 else b + limit - overlap
        near = [(s, r) for s, r in stops.items() if b < s <= reach]
        if n <= reach:
            b = n
        else:
            top = [s for s, r in near if r == 2] or [s for s, r in near]
            b = max(top) if top else reach
        cuts.append(b)
    return cuts


def test_cuts_between_paragraphs_then_sentences_then_anywhere(spark):
    paragraph = " ".join(f"w{i}" for i in range(30))
    sentence = "One two three four five six seven eight nine ten. "
    rows = [("p", "\n\n".join([paragraph] * 5)), ("s", sentence * 12), ("h", " ".join(["word"] * 230)), ("short", "a b c")]
    got, lost = run(spark, rows, 70, 10)
    assert [p.end_word for p in got["p"]] == [60, 120, 150]
    assert [p.end_word for p in got["s"]] == [70, 120]
    assert [p.end_word for p in got["h"]] == [70, 130, 190, 230]
    assert "short" not in got and lost == {("s", 0), ("h", 0)}
    for i, t in rows[:3]:
        check(got[i], t, 70, 10)


def test_dirty_rows_and_line_ends(spark):
    body = " ".join(["x"] * 50)
    text = f"{body}\r\n \t\r\n{body}\r\r{body}\n　\n" + "y " * 60
    rows = [("a", text), ("a", text), ("n", None), ("e", ""), ("b", " \n "), (None, text)]
    got, lost = run(spark, rows, 55, 5)
    assert [p.end_word for p in got["a"]] == [50, 100, 150, 200, 210]
    assert lost >= {("a", 3)} and set(got) == {"a"}
    check(got["a"], text, 55, 5)


def test_cases_come_from_the_pieces(spark):
    pieces, paragraphs = split_oversized(frame(spark, [("h", "word " * 230)]), limit=70, overlap=10)
    assert cut_paragraphs(pieces, paragraphs, 70).count() == 1
    assert cut_paragraphs(pieces.filter("index = 0"), paragraphs, 70).count() == 0
    assert cut_paragraphs(pieces.limit(0), paragraphs, 70).count() == 0


def test_different_texts_of_one_id_are_all_split(spark):
    rows = [("a", "one " * 100), ("a", "two " * 150), ("a", "one " * 100), ("a", "three")]
    pieces, paragraphs = split_oversized(frame(spark, rows), limit=70, overlap=10)
    got = {}
    for r in pieces.orderBy("index").collect():
        got.setdefault(r.text_key, []).append(r)
    assert sorted(ps[-1].end_word for ps in got.values()) == [100, 150] and paragraphs.count() == 2
    for ps in got.values():
        check(ps, rows[0][1] if ps[-1].end_word == 100 else rows[1][1], 70, 10)
    assert [tuple(r) for r in cut_paragraphs(pieces, paragraphs, 70).collect()] == [("a", 0)]


def test_empty_table_and_bad_parameters(spark):
    pieces, paragraphs = split_oversized(frame(spark, []))
    assert pieces.count() == 0 and paragraphs.count() == 0
    with pytest.raises(ValueError):
        split_oversized(frame(spark, []), limit=10, overlap=10)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.lists(st.integers(1, 40), min_size=1, max_size=8), min_size=1, max_size=6), min_size=3, max_size=8))
def test_against_one_cut_at_a_time(spark, texts):
    rows, want = [], {}
    for k, paragraphs in enumerate(texts):
        stops, n, body = {}, 0, []
        for p in paragraphs:
            sentences = []
            for s in p:
                sentences.append("Start " + "mid " * (s - 1) + "end.")
                n += s + 1
                stops[n] = 1
            stops[n] = 2
            body.append(" ".join(sentences))
        stops.pop(n)
        rows.append((f"t{k}", "\n\n".join(body)))
        if n > 30:
            want[f"t{k}"] = greedy(stops, n, 30, 6)
    got, _ = run(spark, rows, 30, 6)
    assert {i: [p.end_word for p in ps] for i, ps in got.items()} == want
