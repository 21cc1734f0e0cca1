import pytest
from pyspark.sql import functions as F

from lodeweave.operators import review


def test_cases(spark):
    m = spark.createDataFrame([("10.1/a", "Title A", "Intro\n\nMethods\nWe grew cells\nfor days"), ("10.1/b", "Title B", "none")], "preprint_doi string, title string, body string")
    twins = spark.createDataFrame([("10.1/a", "P1"), ("10.1/b", "P9")], "preprint_doi string, pmcid string")
    cited = spark.createDataFrame([("10.1/a", d) for d in ("P1", "P2", "P3", "P7")], "preprint_doi string, doc_id string")
    stored = spark.createDataFrame([("P1",), ("P2",), ("P3",), ("P3",)], "doc_id string")
    cases, skipped = review.query_cases(m, twins, cited, stored)
    r = cases.first()
    assert (r.query, r.methods_query, r.relevant_docs, r.excluded_docs) == ("Title A", "Methods We grew cells for days", ["P2", "P3"], ["P1"])
    assert cases.count() == 1 and [x.preprint_doi for x in skipped.collect()] == ["10.1/b"]


def test_derived_queries(spark):
    m = spark.createDataFrame([("10.1/a", "Title A", "Intro\n Materials and methods\n" + "word " * 80), ("10.1/b", None, None)], "preprint_doi string, title string, body string")
    got = {(r.preprint_doi, r.nr): r.query for r in review.derived_queries(m).collect()}
    assert got["10.1/a", 0] == "Title A" and len(got["10.1/a", 1].split()) == 60 and got["10.1/a", 1].startswith("Materials and methods word")
    assert got["10.1/a", 2] == got["10.1/b", 0] == review.FIXED_QUERY and len(got) == 4


def test_claims_and_orders(spark):
    t = spark.createDataFrame([("m", 1, "Same claim here. Other one."), ("m", 0, "First of all. SAME claim here."), ("n", 0, None)], "id string, position int, text string")
    got = review.claims(t, "panel", 3).orderBy("claim_id").collect()
    assert [r.text for r in got] == ["First of all.", "SAME claim here.", "Other one."]
    assert [r.claim_id.split(":")[:2] for r in got] == [["panel", str(i)] for i in range(3)]
    assert spark.createDataFrame(got).select(review.claim_source(F.col("claim_id"))).distinct().first()[0] == "panel"
    e = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y")], "claim_id string, rank int, chunk_id string")
    assert {(r.ord, tuple(r.chunk_ids)) for r in review.both_orders(e).collect()} == {(0, ("x", "y")), (1, ("y", "x"))}


def test_every_sentence_is_a_claim(spark):
    rows = [("m", i, f"Claim number {i} stands here. Each says so.") for i in range(30)]
    got = review.claims(spark.createDataFrame(rows, "id string, position int, text string"), "panel").collect()
    assert sorted(int(r.claim_id.split(":")[1]) for r in got) == list(range(31))
    assert {r.text for r in got} == {f"Claim number {i} stands here." for i in range(30)} | {"Each says so."}


def test_answers_are_refused_under_exclusion(spark):
    q = spark.createDataFrame([(1, "sulfur")], "query_id int, text string")
    reports = spark.createDataFrame([(0, "sulfur metabolism"), (1, "rna")], "community_id int, text string")
    none = spark.createDataFrame([], "doc_id string")
    assert review.answer_prompts(q, reports, none, 1).first().prompt == "Question: sulfur\n[0] sulfur metabolism"
    with pytest.raises(ValueError):
        review.answer_prompts(q, reports, spark.createDataFrame([("d",)], "doc_id string"))
    row = spark.createDataFrame([("see [a] and [c]", ["a", "b", "c"])], "t string, ids array<string>")
    assert row.select(review.cited_ids(F.col("t"), F.col("ids"))).first()[0] == ["a", "c"]


def test_window_sources(spark):
    c = spark.createDataFrame([("native:model-a",), ("odd",), (None,)], "provider string")
    assert [r.window_source for r in review.window_sources(c).collect()] == ["requested", None, None]
