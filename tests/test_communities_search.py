from lodeweave.plans import catalog


def folder_of_cliques(spark, path, cliques):
    """Each document has one chunk, which names the four entities of a clique of its own."""
    names = [[f"entity{c:02d}{x}" for x in "abcd"] for c in range(cliques)]
    ids = [f"D{c:02d}:0:aaaaaaaa" for c in range(cliques)]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    write("chunks", [(i, i[:3], 0, " ".join(n), None) for i, n in zip(ids, names)], "chunk_id string, doc_id string, index int, text string, ingested_at timestamp")
    links = [[(n[0], "binds", n[k]) for k in (1, 2, 3)] for n in names]
    entity = "entities array<struct<name:string,type:string>>, relations array<struct<source:string,predicate:string,target:string>>, truncated boolean, recorded_at timestamp"
    write("chunk_extractions", [(i, [(x, "chemical") for x in n], r, False, None) for i, n, r in zip(ids, names, links)], f"chunk_id string, {entity}")
    write("twins", [("10.1/a", 1, None, "PX", "about entity05b only"), ("10.1/b", 1, None, "PY", "about entity11c only")], "preprint_doi string, preprint_version int, published_doi string, pmcid string, title string")
    write("index_vectors", [(i, [1.0] * 64) for i in ids], "chunk_id string, vector array<float>")
    write("corpus_docs", [(d, 1, f"title {d}", [f"author {int(d[1:]) % 3}"]) for d in [i[:3] for i in ids]] + [("PX", 1, "x", ["author 2"]), ("PY", 1, "y", ["author 2"])], "pmcid string, version int, title string, authors array<string>")
    return ids


def test_search_expands_the_best_communities_only(spark, tmp_path):
    ids = folder_of_cliques(spark, tmp_path, 12)
    rows = catalog.QUERIES["graph_community_search"](spark, str(tmp_path)).collect()
    for query, own in (("PX", ids[5]), ("PY", ids[11])):
        got = {r["rank"]: r for r in rows if r.query_id == query}
        assert got[1].chunk_id == own and got[1].score > got[2].score
        assert len(got) == catalog.rank.TOP_COMMUNITIES < 10  # of 12 communities of one chunk each


def test_ladder_searches_the_communities(spark, tmp_path, monkeypatch):
    folder_of_cliques(spark, tmp_path, 12)
    seen = []
    search = catalog.rank.graph_global

    def spy(queries, reports, assignment, *rest):
        seen.append((reports.count(), assignment.groupBy("community_id").count().count()))
        return search(queries, reports, assignment, *rest)

    monkeypatch.setattr(catalog.rank, "graph_global", spy)
    monkeypatch.setattr(catalog, "_relevant", lambda spark, folder, index, cases: cases.select("query_id").crossJoin(index.select("doc_id")))
    got = catalog.QUERIES["ladder"](spark, str(tmp_path)).collect()
    assert seen == [(12, 12)] and "graph_global" in {r.ranker for r in got}
