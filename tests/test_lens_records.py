import pytest
from pyspark.sql import functions as F

from lodeweave.operators import records
from lodeweave.operators.lens import lens


def found(spark, text):
    df = spark.createDataFrame([(1, text, "x")], "id int, text string, line string")
    return sorted((r.line_no, r.severity, r.detail) for r in lens(df).collect())


BODY = "Intro [1].\nAs in [3,4] and [7–9].\nBad [42] twice [42].\n\nReferences\n1. A. doi: 10.1234/abc.\n2. B https://doi.org/10.1234/ABC\n3. C doi:11.5/x\n4. D\n"


def test_references(spark):
    got = found(spark, BODY)
    details = [d for _, _, d in got]
    assert [(n, d) for n, s, d in got if "cites" in d] == [(2, f"cites number {n} of a list of 4") for n in (7, 8, 9)] + [(3, "cites number 42 of a list of 4")]
    assert "11.5/x: no valid DOI" in details
    assert "10.1234/abc: listed before, in line 6" in details and len(got) == 6
    assert not found(spark, BODY.replace("References", "The references"))[1:] or all("cites" not in d for _, _, d in found(spark, BODY.replace("References", "The references")))


@pytest.mark.parametrize(("line", "n"), [
    ("levels of 1-Mar and Sep-2 rose", 2), ("Received 1-Mar 2024", 0), ("on 1-Mar-2024 we", 0), ("on 22-Mar we", 0), ("3-Aug rose", 0), ("2-September fell", 1), ("see 4-Dec (2019)", 0),
    ("the gene 2.31E+13 rose", 1), ("the gene 2.31E-13 rose", 0), ("2.31E+13 alone", 0), ("gene at 1.5E+06 cells/mL", 0),
    ("p = 0.000", 1), ("p = 0.0001", 0), ("P = 100 mM", 0), ("p > 1.2", 1), ("pH = 6.9", 0), ("p-value = 1.34", 1), ("p < 0", 0), ("P=2 h", 0),
    ("It consisted of A (50%), B (40%) and C (30%)", 1), ("peptone >95%, glucose >99%, salt 98%", 0), ("composed of A 88.83 ± 4.87%, B 5.1 ± 2%, C 6%", 0), ("It consisted of A (92.8%) and B (7.2%); of C (83%)", 0),
])
def test_lines(spark, line, n):
    assert len(found(spark, line)) == n


def test_lens_without_text(spark):
    assert found(spark, None) == [] and found(spark, "") == []


def test_swap_verdicts(spark):
    rows = [
        ("agree", 0, "SUPPORTS", [("z", "q1"), ("a", "q")]), ("agree", 1, "SUPPORTS", [("a", "q"), ("b", "q")]),
        ("differ", 0, "SUPPORTS", [("a", "one"), ("b", "first")]), ("differ", 1, "REFUTES", [("b", "second")]),
        ("one", 0, "REFUTES", [("a", "q")]), ("odd", 0, "MAYBE", [("a", "q")]), ("odd", 1, "NOT_ENOUGH_INFO", None),
    ]
    given = [("agree", ["b", "z", "a"]), ("differ", ["a", "b"]), ("one", ["a"]), ("odd", ["a"]), ("nothing", []), ("null", None)]
    got = {r.claim_id: (r.verdict, [tuple(s) for s in r.spans], r.swapped, r.swap_consistent) for r in records.swap_verdicts(
        spark.createDataFrame(rows, "claim_id string, ord int, verdict string, spans array<struct<chunk_id:string,quote:string>>"), spark.createDataFrame(given, "claim_id string, chunk_ids array<string>")).collect()}
    assert got == {
        "agree": ("SUPPORTS", [("b", "q"), ("z", "q1"), ("a", "q")], True, True),
        "differ": ("NOT_ENOUGH_INFO", [("b", "first"), ("b", "second")], True, False),  # by chunk, whatever is quoted of it
        "one": ("NOT_ENOUGH_INFO", [], True, False), "odd": ("NOT_ENOUGH_INFO", [], True, True),
        "nothing": ("NOT_ENOUGH_INFO", [], False, True), "null": ("NOT_ENOUGH_INFO", [], False, True),
    }


def test_arms_and_pooled_findings(spark):
    scores = spark.createDataFrame([("panel", "s", "e1", True, True), ("panel", "s", "e2", True, False), ("solo", "s", "e1", False, False)], "arm string, source string, error_id string, named boolean, detected boolean")
    spent = spark.createDataFrame([("panel", "s", 100), ("panel", "s", 100), ("solo", "s", 50)], "arm string, source string, tokens int")
    got = {r.arm: r for r in records.arm_results(scores, spent, "panel").collect()}
    assert got["panel"][2:] == (["e1"], ["e1", "e2"], ["e2"], 200, 1.0) and got["solo"][2:] == ([], [], ["e1"], 50, 0.25)
    f = spark.createDataFrame([("s", "a", 1, "x"), ("s", "a", 2, "x"), ("s", "a", 2, "y"), ("s", "a", 2, None)], "source string, arm string, sample int, text string")
    assert {tuple(r) for r in records.pooled_findings(f).collect()} == {("s", "a", "x", 2), ("s", "a", "y", 1)}


def test_consistency_gate(spark):
    rows = [("a", True, i < 6) for i in range(12)] + [("b", True, True)] * 3 + [("b", False, None)] * 20
    got = {r.source: (r.n, r.rate) for r in records.consistency(spark.createDataFrame(rows, "source string, swapped boolean, swap_consistent boolean")).collect()}
    assert got == {"a": (12, 0.5), "b": (3, None), None: (15, 0.6)}


def test_conflicts_ledger_budget(spark):
    s = spark.createDataFrame([("r", "d", "x", 4), ("r", "d", "y", 2), ("r", "e", "x", 1), ("r", "f", "x", 3), ("r", "f", "y", 4), ("r", "g", "x", None)], "run_id string, dimension string, reviewer string, score int")
    assert [tuple(r) for r in records.score_conflicts(s).collect()] == [("r", "d", 2, 2, 4)]
    calls = spark.createDataFrame([("r", 100, 5, 4096, "b"), ("r", 8000, 5, 8192, "a"), ("r", 50, 5, None, None)], "run_id string, prompt_tokens int, answer_tokens int, context int, source string")
    r = records.ledger(calls).first()
    assert (r.calls, r.largest_prompt, r.smallest_context, r.smallest_headroom, r.sources) == (3, 8000, 4096, 192, "a,b")
    cut = records.within_budget(spark.createDataFrame([("g", i, 10) for i in range(20)], "g string, i int, c int"), "g", ["i"], "c", 35)
    assert [x.i for x in cut.orderBy("i").collect()] == [0, 1, 2, 3]


def test_grounding_and_hygiene(spark):
    f = spark.createDataFrame([(1, "r", "v", "said", "big  cat", ["a", "a", "b", "zz"], 1), (2, "r", "v", "said", "", ["a"], 2), (3, "r", "v", " ", None, None, 3), (4, "r", "v", "x", None, None, 4)], "finding_id int, run_id string, reviewer string, text string, quote string, evidence_chunk_ids array<string>, created_at int")
    c = spark.createDataFrame([("a", "a big\ncat sat"), ("b", "none")], "chunk_id string, text string")
    got = {r.finding_id: (r.named, r.known, r.grounded) for r in records.grounding(f, c).collect()}
    assert got == {1: (3, 2, 1), 2: (1, 1, 0), 3: (0, 0, 0), 4: (0, 0, 0)}
    kept = {r.finding_id: (r.evidence, r.dropped_ids) for r in records.finding_hygiene(f, c, most=2).collect()}
    assert kept == {1: (["a", "b"], 1), 2: (["a"], 0)}
    scored = records.finding_hygiene(f.withColumn("score", F.when(F.col("finding_id") == 1, "9").otherwise("x")), c, most=2)
    assert {r.finding_id: r.score for r in scored.collect()} == {1: 5, 2: None}
    assert spark.range(1).select(records.clamp_score(F.lit("9")), records.clamp_score(F.lit("x")), records.clamp_score(F.lit("-2"))).first()[:] == (5, None, 1)


def test_planted_scores_and_collisions(spark):
    e = spark.createDataFrame([("s", "e1", "Dcr2", "The Dcr2 level rose."), ("s", "e2", "412%", "It was 412%.")], "source string, error_id string, token string, manuscript string")
    f = spark.createDataFrame([("s", "panel", "The Dcr2 level rose. I think dcr2 is wrong."), ("s", "solo", "It was 412%. Fine.")], "source string, arm string, text string")
    got = {(r.arm, r.error_id): (r.named, r.detected) for r in records.planted_scores(e, f).collect()}
    assert got == {("panel", "e1"): (True, True), ("panel", "e2"): (False, False), ("solo", "e1"): (False, False), ("solo", "e2"): (False, False)}
    t = spark.createDataFrame([("Met4",), ("nope",)], "token string")
    d = spark.createDataFrame([("d1", "the MET4 gene"), ("d1", "met4"), ("d2", "x met4y")], "doc_id string, text string")
    assert {r.token: r.documents for r in records.token_collisions(t, d).collect()} == {"Met4": 2, "nope": 0}


def test_latest_without_times(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, 5, "c"), (2, 4, "d"), (None, 9, "e"), (3, 1, "x"), (3, 1, "y")], "k long, t long, v string")
    got = {r.k: r.v for r in records.latest(rows, "k", "t").collect()}
    assert got.keys() == {1, 2, 3} and (got[1], got[2]) == ("a", "c")
    assert got[3] == {r.k: r.v for r in records.latest(rows.repartition(3), "k", "t").collect()}[3]
