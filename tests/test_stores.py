"""The stores of the given formats over small tables with nulls, against SQL."""

import duckdb
import pytest

from lodeweave.plans import stores

TABLES = {
    "corpus_docs": ("""corpus string, pmcid string, version int, md5 string, license_code string, title string, authors array<string>, doi string, citation string, source_url string,
        fetched_at string, forced_include boolean""", [
        ("c", "P1", 1, "m", "CC0", " A <b> &  c ", ["Ann ", " "], "10.1/x", "z", "u", "2025-01-01", True),
        ("c", "P1", 1, "m", "CC0", " A <b> &  c ", ["Ann ", " "], "10.1/x", "z", "u", "2025-01-01", True),
        ("c", "P2", None, None, None, None, None, None, None, None, None, None),
        ("c", None, 2, "k", "CC BY", "t\n2", [], None, None, None, "02/03/2025", False)]),
    "documents": ("doc_id bigint, text string, pmcid string", [(1, "one\x0c &amp; <p>\n\n two\r\n\n\n\x85", "P1"), (2, "", "P2"), (3, None, "P1"), (None, "---\nx\n---\n", "P1"), (5, "y", None)]),
    "chunks": ("chunk_id string, text string", [("P1:0:a", "a b"), ("P1:0:a", "a b"), ("P1:1:b", "w " * 61), ("P2:0:c", " \n"), ("P2:1:d", None), (None, "x"), ("P2:2:e", "a b")]),
    "index_vectors": ("chunk_id string, vector array<float>", [("P1:0:a", [1.0, 2.0]), ("P1:0:a", [1.0, 2.0]), ("z", []), ("P2:0:c", None), (None, [0.5])]),
    "chunk_extractions": ("""chunk_id string, entities array<struct<name:string,type:string>>, relations array<struct<source:string,predicate:string,target:string>>, truncated boolean,
        recorded_at timestamp_ntz""", [
        ("P1:0:a", [("X", "chemical"), ("y ", "organism"), ("Z", "chemical")], [("x", "p", "Y")], False, None), ("P1:1:b", None, None, True, None), ("P2:2:e", [("w", "other")], [], None, None)]),
    "review_findings": ("finding_id bigint, severity string, text string, quote string, received_at timestamp_ntz", [(1, "minor", 'a "b"\n', None, None), (2, None, "{}", "q", None), (3, "", None, None, None)]),
}


@pytest.fixture(scope="module", params=["rows", "empty"])
def folder(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows if request.param == "rows" else [], schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", list(stores.QUERIES))
def test_stores(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(stores.ORACLES[name])
    got = stores.QUERIES[name](spark, folder).select(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_store_rows(spark, folder):
    n = stores.QUERIES["article_bodies"](spark, folder).count()
    assert n in (0, 4)
