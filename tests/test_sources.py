import json

import pytest
from pyspark.sql import functions as F

from lodeweave.sources import corpus, files


def test_manifest_round_trip(spark, tmp_path):
    doc = {"pmcid": "P2", "version": 1, "md5": "m", "license_code": "CC0", "title": "T", "authors": ["A"], "doi": None, "citation": "c", "source_url": "u", "fetched_at": "2025-01-01", "forced_include": False}
    (tmp_path / "m.json").write_text(json.dumps({"name": "demo", "docs": [doc, {**doc, "pmcid": "P1"}]}, indent=1))
    got = files.read_manifest(spark, str(tmp_path / "m.json"))
    assert {(r.corpus, r.pmcid, r.doi) for r in got.collect()} == {("demo", "P1", None), ("demo", "P2", None)}
    files.write_manifest(got, str(tmp_path / "out"), "demo")
    again = files.read_manifest_lines(spark, str(tmp_path / "out"))
    assert again.columns == got.columns and sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_texts_need_every_document(spark, tmp_path):
    (tmp_path / "P1.txt").write_text("one\n")
    m = spark.createDataFrame([("P1",)], "pmcid string")
    assert [tuple(r) for r in files.read_complete(spark, m, str(tmp_path)).collect()] == [("P1", "one\n")]
    with pytest.raises(FileNotFoundError):
        files.read_complete(spark, spark.createDataFrame([("P1",), ("P2",)], "pmcid string"), str(tmp_path))


def test_named_corpora_and_collisions(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "P1.txt").write_text("one")
    (tmp_path / "m.json").write_text(json.dumps({"name": "demo", "docs": [{"pmcid": "P1"}]}))
    corpora = {"demo": (str(tmp_path / "m.json"), str(tmp_path / "t"))}
    assert [tuple(r) for r in files.read_corpus(spark, "demo", corpora).collect()] == [("P1", "one")]
    with pytest.raises(ValueError, match="unknown corpus 'x', known: demo"):
        files.read_corpus(spark, "x", corpora)
    files.write_collisions(spark.createDataFrame([("b", 2), ("a", 1)], "token string, documents long"), str(tmp_path / "c"))
    assert {tuple(r) for r in spark.read.schema("token string, documents long").json(str(tmp_path / "c")).collect()} == {("a", 1), ("b", 2)}


def test_manuscripts(spark):
    body = "First line\n\n# not a header\nlast"
    df = spark.createDataFrame([("m", {"Title": "T: x", "DOI": "10.1/x"}, body)], "doc_id string, header map<string,string>, body string")
    text = df.select("doc_id", files.render_manuscript(F.col("header"), F.col("body")).alias("text"))
    r = files.parse_manuscripts(text).first()
    assert (r.header, r.body) == ({"Title": "T: x", "DOI": "10.1/x"}, body)
    for bad in ("no header at all", "# Title: x\n---\nbody"):
        with pytest.raises(Exception, match="header"):
            files.parse_manuscripts(spark.createDataFrame([("m", bad)], "doc_id string, text string")).collect()


def test_articles(spark):
    xml = """<article><front><article-title>On <italic>x</italic></article-title><contrib contrib-type="author"><name><surname>Doe</surname><given-names>J</given-names></name></contrib></front>
    <body><sec><title>Intro</title><p>Text <xref>1</xref> here<fn>note</fn>.<disp-formula-group>x</disp-formula-group></p><fig-group><p>gone</p></fig-group><!-- no --><list><list-item><p>one</p><p>two</p></list-item></list>
    <boxed-text>direct <p>and inner</p></boxed-text></sec><sec><ref-list><p>gone</p></ref-list></sec></body></article>"""
    df = spark.createDataFrame([("a", xml), ("b", "<broken"), ("c", None)], "doc_id string, xml string")
    got = {r.doc_id: r for r in files.parse_articles(df).collect()}
    assert got["a"].title == "On x" and got["a"].authors == ["Doe J"] and got["a"].text == "Intro\n\nText 1 herenote.\n\nonetwo\n\ndirect and inner"
    assert got["b"].text is None and got["c"].title is None


def test_vector_store(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "chunk_id string, vector array<double>")
    files.save_vectors(v, str(tmp_path), "p")
    assert files.load_vectors(spark, str(tmp_path)).count() == 2
    spark.createDataFrame([("a", [1.0, 2.5]), ("b", None)], "chunk_id string, vector array<float>").write.mode("overwrite").parquet(f"{tmp_path}/vectors")
    with pytest.raises(ValueError, match="manifest"):
        files.load_vectors(spark, str(tmp_path))
    assert {tuple(r) for r in files.fresh(v, spark.createDataFrame([("a",), ("z",)], "chunk_id string")).collect()} == {("b", "store"), ("z", "chunks")}


def test_caches(spark):
    asked = spark.createDataFrame([("q1",), ("q2",)], "text string").withColumn("key", files.content_key(F.lit("model"), F.col("text")))
    cache = asked.filter("text = 'q1'").select("key", F.lit("yes").alias("answer"))
    have, miss = files.cached(asked, cache.union(cache))
    assert [r.answer for r in have.collect()] == ["yes"] and [r.text for r in miss.collect()] == ["q2"]
    assert files.replay(have.drop("answer"), cache).count() == 1
    with pytest.raises(Exception, match="nothing recorded"):
        files.replay(asked, cache).collect()


def test_graph_store(spark, tmp_path):
    n, e = spark.createDataFrame([("a", 1)], "node string, n int"), spark.createDataFrame([("a", "b", 0.25)], "src string, dst string, weight double")
    files.save_graph(n, e, str(tmp_path))
    assert [x.collect() for x in files.load_graph(spark, str(tmp_path))] == [n.collect(), e.collect()]


def test_corpus_rules(spark):
    names = ["CC BY", "cc-by", "CC BY 4.0", "CC0", "CC BY-NC", None]
    df = spark.createDataFrame([(f"P{i}", n) for i, n in enumerate(names)], "pmcid string, license_code string")
    assert {r.pmcid: r.accepted for r in corpus.gate(df).collect()} == {"P0": True, "P1": True, "P2": True, "P3": True, "P4": False, "P5": False}
    dois = ["https://doi.org/10.5555/AB", "doi: 10.5555/ab ", "10.5555/ab", "nope", None]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in dois], "d string").select(corpus.clean_doi(F.col("d"))).collect()]
    assert got == ["10.5555/ab"] * 3 + [None] * 2


def test_sync_outcomes_and_refusals(spark):
    pins = spark.createDataFrame([(p, "m") for p in "abcdefg"], "pmcid string, md5 string")
    local = spark.createDataFrame([("a", "m"), ("b", "old")], "pmcid string, md5 string")
    up = [("a", "new", "CC0", True, True), ("b", "m", "cc-by", False, True), ("c", "other", "CC0", None, True), ("d", "m", "CC BY-NC", False, True), ("e", "m", "CC0", True, True), ("f", "m", "CC0", False, None)]
    upstream = spark.createDataFrame(up, "pmcid string, md5 string, license_code string, is_retracted boolean, is_open_access boolean")
    got = {r.pmcid: r.outcome for r in corpus.sync(pins, local, upstream).collect()}
    assert got == {"a": "cached", "b": "fetched", "c": "md5_mismatch", "d": "license_refused", "e": "retracted_refused", "f": "license_refused", "g": "missing_upstream"} and set(got.values()) == set(corpus.OUTCOMES)
    assert {r.pmcid: r.reason for r in corpus.gate(upstream).collect()} == {"a": "retracted", "b": None, "c": None, "d": "licence CC BY-NC", "e": "retracted", "f": "no open access"}


def test_status_upsert_candidates(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "doc_id string, md5 string")
    s = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("e", "1")], "doc_id string, md5 string")
    assert {r.doc_id: r.outcome for r in corpus.status(m, s).collect()} == {"a": "ok", "b": "changed", "c": "unknown", "d": "missing", "e": "orphan"}
    assert {tuple(r) for r in corpus.upsert(m.filter("doc_id < 'c'"), s.filter("doc_id > 'a' and doc_id < 'd'"), "doc_id").collect()} == {("a", "1"), ("b", "2"), ("c", "1")}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "pmcid string")
    links = spark.createDataFrame([("P9", "P5"), ("P4", "P9"), ("P5", "P1"), ("P9", "P9")], "citing string, cited string")
    found = corpus.citation_candidates(ids("P9", "P9"), links, ids("P1", "P5", "P9", "P2"))
    assert {tuple(r) for r in found.collect()} == {("P9", 0, True), ("P4", 1, False), ("P5", 1, False), ("P1", 2, False), ("P2", 2, False)}
    assert {r.pmcid for r in corpus.within_target(found, 4).collect()} == {"P9", "P4", "P5", "P1"}
    assert {r.pmcid for r in corpus.within_target(found, 0).collect()} == {"P9"}
    t = spark.createDataFrame([("10.1/a", "P1")], "preprint_doi string, pmcid string")
    assert corpus.excluded_documents(t, t).first().doc_id == "P1"
    with pytest.raises(Exception, match="no twin"):
        corpus.excluded_documents(t, spark.createDataFrame([("10.1/b",)], "preprint_doi string")).collect()
