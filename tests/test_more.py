import json

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import text
from lodeweave.operators import planting, providers
from lodeweave.operators.records import planted_scores
from lodeweave.streaming.windows import event_counts, ingest

TEXT = "\n".join([
    "In this long line the gene Dcr1 is named among more than a dozen other plain words here",
    "Growth increased in all strains", "The effect held (p < 0.05) throughout", "Of these 45% survived",
    " ".join(f"w{i}" for i in range(30)), "no site",
])


def planted(spark, texts, **kw):
    df = spark.createDataFrame(texts, "doc_id string, text string")
    out, errors = planting.plant(df, **kw)
    return {r.doc_id: r for r in out.collect()}, sorted((tuple(r) for r in errors.collect()))


def test_planting(spark):
    out, errors = planted(spark, [("a", TEXT), ("e", ""), ("n", None)])
    assert {e[2] for e in errors} == set(planting.KINDS) and out["a"].skipped_kinds == []
    by = {e[2]: e for e in errors}
    assert by["gene_symbol_swap"][3:6] == ("Dcr1", "Dcr2", "Dcr2") and by["effect_direction_flip"][5] == "decreased in all"
    lines = out["a"].text.split("\n")
    assert lines[2] == "The effect held (p = 1.34) throughout" and lines[3] == "Of these 412% survived" and lines[4].endswith("7:e91188)") and lines[5] == "no site"
    assert out["e"].text == "" and out["n"].text is None and set(out["n"].skipped_kinds) == set(planting.KINDS)
    again = planted(spark, [("a", TEXT), ("e", ""), ("n", None)])
    assert again[1] == errors and again[0]["a"].text == out["a"].text


def test_one_line_may_serve_all_kinds(spark):
    line = " ".join(["The gene Dcr1 increased in all strains (p < 0.05) in 45% of the plants"] + [f"w{i}" for i in range(20)]) + " "
    out, errors = planted(spark, [("a", line)])
    assert [e[2] for e in errors] == sorted(planting.KINDS) and out["a"].skipped_kinds == [] and {e[6] for e in errors} == {1}
    assert out["a"].text.startswith("The gene Dcr2 decreased in all strains (p = 1.34) in 412% of the plants w0") and out["a"].text.endswith("w19" + planting.CITATION)
    assert {e[1].rsplit("-", 1)[1] for e in errors} == set("01234")


def test_planting_stays_in_its_window(spark):
    _, errors = planted(spark, [("a", TEXT)], window_words=23)
    assert {e[2] for e in errors} == {"gene_symbol_swap", "effect_direction_flip"}


def test_planted_errors_are_scored(spark):
    out, errors = planting.plant(spark.createDataFrame([("a", TEXT)], "doc_id string, text string"))
    e = errors.join(out.select("doc_id", F.col("text").alias("manuscript")), "doc_id").select(F.col("doc_id").alias("source"), "error_id", "token", "manuscript")
    f = spark.createDataFrame([("a", "one", "The value p = 1.34 is impossible. Growth decreased in all strains"), ("a", "two", "All good")], "source string, arm string, text string")
    got = {(r.arm, r.error_id.rsplit("-", 1)[0]): (r.named, r.detected) for r in planted_scores(e, f).collect()}
    assert got["one", "impossible_pvalue"] == (True, True) and got["one", "effect_direction_flip"] == (False, False) and got["two", "impossible_pvalue"] == (False, False)


def test_answers(spark):
    def chat(system, user, limit):
        return json.dumps({"user": user}) if user == "good" or (user == "long" and limit > 1024) else "cut off {"

    asked = providers.prompts(spark.createDataFrame([("s", u) for u in ("good", "long", "bad", "old", "good")], "system string, user string"), "m", 1024)
    recorded = asked.filter("user = 'old'").select("key", F.lit("{}").alias("answer"), F.lit(False).alias("truncated"))
    users = {r.key: r.user for r in asked.collect()}
    got = {users[r.key]: (r.truncated, r.calls) for r in providers.answer(asked, recorded, chat).collect()}
    assert got == {"good": (False, 1), "long": (False, 2), "bad": (True, 2), "old": (False, 0)}


def test_embeddings(spark):
    rows = providers.embed(spark.createDataFrame([("a b",), (None,), ("b a",)], "text string"), providers.hashed_embedding(8)).collect()
    assert rows[0].vector == rows[2].vector and rows[1].vector is None and abs(sum(x * x for x in rows[0].vector) - 1) < 1e-6


def test_reports_keep_their_identity(spark):
    tops = spark.createDataFrame([(5, 3, 1, "a", 2.0), (5, 3, 2, "b", 1.0)], "community_id int, size int, rank int, node string, degree double")
    lines = spark.createDataFrame([(5, ["a -[p]- b"])], "community_id int, lines array<string>")
    empty = spark.createDataFrame([], "key string, title string, summary string, truncated boolean")
    r = providers.reports(tops, lines, empty, 1.0).first()
    assert (r.community_id, r["size"], r.member_names, r.cached) == (5, 3, ["a", "b"], False) and "a, b" in r.summary


def test_report_counts(spark):
    made = spark.createDataFrame([(1.0, True, False), (1.0, False, False), (1.0, False, True), (3.0, True, True)], "resolution double, cached boolean, truncated boolean")
    assert {tuple(r) for r in providers.report_counts(made).collect()} == {(1.0, 3, 1, 2, 1), (3.0, 1, 1, 0, 1)}


def test_prompt_guards_and_quoted_sentences(spark):
    row = spark.createDataFrame([("x" * 600, 99, 100, "He said much. We say more.  ", "Then he said much. End.")], "user string, few int, enough int, text string, source string")
    got = row.select(text.was_cut(F.col("few"), F.lit(None), F.col("user")), text.was_cut(F.col("enough"), F.lit(""), F.col("user")), text.quoted_sentences(F.col("text"), F.col("source")), text.fitting(F.lit(8192), F.lit(5000))).first()
    assert tuple(got) == (True, False, 1, 8192)
    with pytest.raises(Exception, match="a window of 4096 for a call that needs 5000"):
        row.select(text.fitting(F.lit(4096), F.lit(5000))).collect()


def test_streaming_windows_and_ingest(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 0{h}:1{m}:00", t, float(m)) for h in range(5) for m in range(3) for t in "xy"], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    events.write.parquet(source)
    want = {tuple(r) for r in event_counts(events).collect()}
    stream = event_counts(spark.readStream.schema(events.schema).parquet(source))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("w").collect()} == want
    for _ in range(2):
        ingest(spark, source, events.schema, target, state)
    assert spark.read.parquet(target).count() == events.count()


def test_contract(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
