import math
import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import community, graph, match, metrics, rank

EX = "chunk_id string, entities array<struct<name:string,type:string>>, relations array<struct<source:string,predicate:string,target:string>>, truncated boolean, recorded_at int"
G = "gene_or_protein"


def extraction(spark, rows):
    return spark.createDataFrame([(c, e, r, t, n) for n, (c, e, r, t) in enumerate(rows)], EX)


def build(spark, rows, excluded=()):
    x = extraction(spark, rows)
    x = graph.without_documents(x, spark.createDataFrame([(d,) for d in excluded], "doc_id string"))
    clean = graph.hygiene(graph.best_extractions(x))
    m, r = graph.mentions(clean), graph.relations(clean)
    return m, r, graph.edges(m, r)


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_merge(spark):
    rows = [("d1:0:x", [("Met4", G), ("A", "chemical")], [], False), ("d2:0:x", [("MET4", G), (" a ", "chemical"), ("B", "other")], [("Met4", "binds", "a"), ("B", "is", "b"), ("B", "of", "nobody")], False)]
    m, r, e = build(spark, rows)
    n = table(graph.nodes(m), "node")
    assert n["met4",].n_chunks == 2 and n["met4",].display_name == "MET4" and n["a",].node_type == "chemical"
    w = {k: v.weight for k, v in table(e, "src", "dst").items()}
    assert w == {("a", "met4"): 1.5, ("b", "met4"): 0.25, ("a", "b"): 0.25}
    assert table(graph.edge_predicates(r), "src", "dst")["a", "met4"].predicate == "binds"
    v = table(graph.node_variants(m), "node")["met4",]
    assert v.variants == {"Met4": 1, "MET4": 1} and v.types == {G: 2}


def test_hygiene_and_best_row(spark):
    rows = [("c", [("x", G)], None, True), ("c", [("x", G), ("y", "Protein"), (None, G), ("", G), ("z", None)], [("x", "p", "q")], False), ("c", None, None, True), ("d", None, None, None), (None, [("n", G)], [], False)]
    m, r, e = build(spark, rows)
    assert [tuple(x) for x in m.collect()] == [("c", "x", "x", G)] and r.count() == 0 and e.count() == 0


def test_exclusion_is_exact(spark):
    rows = [("keep:0:x", [("shared", G), ("mine", G)], [], False), ("twin:0:x", [("shared", G), ("only", G)], [("shared", "p", "only")], False)]
    m, _, full = build(spark, rows)
    _, _, run = build(spark, rows, ["twin"])
    gone = spark.createDataFrame([("twin",)], "doc_id string")
    assert {r.node for r in graph.live_nodes(m, gone).collect()} == {"shared", "mine"}
    assert {(r.src, r.dst) for r in run.collect()} == {("mine", "shared")} and full.count() == 2


def cliques(spark):
    rows, n = [], 0
    for c in "ab":
        for i in range(4):
            for j in range(i + 1, 4):
                rows.append((f"d{n}:0:x", [(f"{c}{i}", G), (f"{c}{j}", G)], [(f"{c}{i}", "p", f"{c}{j}")], False))
                n += 1
    rows.append((f"d{n}:0:x", [("a0", G), ("b0", G)], [], False))
    return build(spark, rows)


def test_communities(spark):
    m, r, e = cliques(spark)
    got = {x.node: x.community_id for x in community.communities(e, 1.0).collect()}
    assert got == {f"{c}{i}": k for k, c in enumerate("ab") for i in range(4)}
    assert {x.node: x.community_id for x in community.communities(e.repartition(3), 1.0).collect()} == got
    few, many = (community.communities(e, x).select("community_id").distinct().count() for x in (0.3, 3.0))
    assert many >= few
    a = spark.createDataFrame(list(got.items()), "node string, community_id int")
    two_m, inside = 2 * (12 * 1.25 + 0.25), 2 * 12 * 1.25
    assert community.modularity(e, a).first().modularity == pytest.approx(inside / two_m - 2 * (two_m / 2) ** 2 / two_m**2)
    assert community.communities(e.limit(0)).count() == 0
    tops = graph.top_members(a, e, top=2)
    assert {(x.community_id, x.node) for x in tops.collect()} == {(0, "a0"), (0, "a1"), (1, "b0"), (1, "b1")}
    assert table(graph.relation_lines(tops, e, r), "community_id")[0,].lines == ["a0 -[p]- a1"]
    stats = {(x.measure, x.resolution): x.value for x in graph.build_stats(spark.createDataFrame([("c", True), ("d", False)], "chunk_id string, truncated boolean"), m, e, {1.0: a}).collect()}
    assert stats == {("chunks", None): 2, ("truncated_chunks", None): 1, ("nodes", None): 8, ("edges", None): 13, ("communities", 1.0): 2}


def test_communities_hold_together(spark):
    """Two pairs under one name and no link between them become two communities."""
    links = graph.both_ways(spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("d", "e", 1.0)], "src string, dst string, weight double"))
    member = spark.createDataFrame([(x, "m") for x in "abcde"] + [("lone", "m")], "node string, community string")
    assert {x.node: x.community for x in community._connected(links, member).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "lone": "lone"}


def test_a_stop_before_nodes_are_still_warns(spark):
    _, _, e = cliques(spark)
    with pytest.warns(UserWarning, match="still move"):
        community.communities(e, 1.0, passes=2, still=-1.0, levels=1)


def test_communities_of_a_ring(spark):
    """Six cliques of five in a ring with one thin link each: no partition has more modularity than the cliques."""
    near = [(f"n{c}{i}", f"n{c}{j}", 1.0) for c in range(6) for i in range(5) for j in range(i + 1, 5)]
    ring = [tuple(sorted((f"n{c}0", f"n{(c + 1) % 6}1"))) + (0.25,) for c in range(6)]
    got = community.communities(spark.createDataFrame(near + ring, "src string, dst string, weight double"), 1.0).collect()
    assert len({x.community_id for x in got}) == 6 == len({(x.node[:2], x.community_id) for x in got})


def fixture(spark):
    chunks = spark.createDataFrame([("docA:0:x", "Met4 drives sulfur metabolism", "z"), ("docB:0:x", "RNA sequencing of strains", "z"), ("docTwin:0:x", "Met4 drives sulfur metabolism here", "z"), ("docE:0:x", "other words entirely", "z"), ("docC:0:x", " ", "z"), ("docD:0:x", None, "z")], "chunk_id string, text string, doc_id string")
    vectors = spark.createDataFrame([("docA:0:x", [1.0, 0.0, 0.0]), ("docB:0:x", [0.0, 1.0, 0.0]), ("docTwin:0:x", [0.9, 0.1, 0.0])], "chunk_id string, vector array<float>")
    rows = [("docA:0:x", [("Met4", G), ("sulfur metabolism", "process_or_phenotype")], [("Met4", "activates", "sulfur metabolism")], False), ("docTwin:0:x", [("Met4", G)], [], False), ("docB:0:x", [("RNA sequencing", "method_or_tool")], [], False)]
    return chunks, vectors, rows


def test_excluded_documents_never_surface(spark):
    chunks, vectors, rows = fixture(spark)
    gone = spark.createDataFrame([("docTwin",)], "doc_id string")
    index = rank.index_chunks(chunks, gone)
    m, _, e = build(spark, rows, ["docTwin"])
    q = spark.createDataFrame([(1, "Met4 sulfur metabolism", [2.0, 0.0, 0.0]), (2, "RNA sequencing", [0.0, 1.0, 0.0])], "query_id int, text string, vector array<double>")
    v = vectors.join(index.select("chunk_id"), "chunk_id", "left_semi")
    reports = spark.createDataFrame([(0, "Met4 and sulfur metabolism"), (1, "RNA sequencing")], "community_id int, text string")
    a = spark.createDataFrame([("met4", 0), ("sulfur metabolism", 0), ("rna sequencing", 1)], "node string, community_id int")
    lexical, dense = rank.bm25(index, q, 10), rank.vector_search(v, q, 10)
    every = {"bm25": lexical, "vector": dense, "rrf": rank.rrf([lexical, dense], 10), "local": rank.graph_local(q, m, e, index, 10), "blend": rank.graph_local(q, m, e, index, 10, vectors=v), "global": rank.graph_global(q, reports, a, m, index, 10)}
    for name, hits in every.items():
        rows_ = hits.collect()
        assert not [r for r in rows_ if "docTwin" in r.chunk_id], name
        first = {r.query_id: r.chunk_id for r in rows_ if r["rank"] == 1}
        assert first == {1: "docA:0:x", 2: "docB:0:x"}, name
    assert [tuple(r) for r in rank.exclusion_audit(chunks, gone).collect()] == [("docTwin", 1)]
    local = {r.query_id: r.score for r in every["local"].collect() if r["rank"] == 1}
    assert local[1] == 2.0 and {r.query_id: r.score for r in every["blend"].collect() if r["rank"] == 1}[1] == 3.0


def test_exclusion_that_does_nothing_raises(spark, monkeypatch):
    chunks, _, _ = fixture(spark)
    gone, unknown = (spark.createDataFrame([(d,)], "doc_id string") for d in ("docTwin", "elsewhere"))
    assert rank.excluding_index(chunks, gone).count() == 3 and rank.excluding_index(chunks, unknown).count() == 4
    whole = rank.index_chunks
    monkeypatch.setattr(rank, "index_chunks", lambda c, excluded=None: whole(c))
    with pytest.raises(ValueError, match="still in the index"):
        rank.excluding_index(chunks, gone)


def test_bm25_by_hand(spark):
    texts = {"a": "x y y", "b": "x z", "c": "w", "d": "v v"}
    index = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in rank.bm25(index, spark.createDataFrame([(1, "y x x"), (2, "nothing")], "query_id int, text string"), 4).collect()}
    n, avg = 4, 8 / 4
    df = {"x": 2, "y": 1, "z": 1, "w": 1, "v": 1}
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    def score(c, q):
        ts = texts[c].split()
        return sum(idf[t] * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in q)
    for c in texts:
        assert got[1, c] == pytest.approx(score(c, ["y", "x", "x"]), abs=1e-6) and got[2, c] == 0
    whole = rank.bm25(index, spark.createDataFrame([(1, "y x x"), (2, "nothing")], "query_id int, text string"), 3)
    assert [(r.query_id, r.chunk_id) for r in whole.orderBy("query_id", "rank").collect()] == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c")]
    assert rank.bm25(index.limit(0), spark.createDataFrame([(1, "x")], "query_id int, text string")).count() == 0


def test_tasks_send_their_best_of_each_query_only(spark):
    index = spark.createDataFrame([(f"c{i:03d}", "word " * (1 + i % 7) + f"w{i % 5}") for i in range(600)], "chunk_id string, text string").repartition(3)
    q = spark.createDataFrame([(i, f"word w{i}") for i in range(4)], "query_id int, text string")
    for k in (2, 50):
        hits = rank.bm25_hits(index, q, k)
        assert hits.count() <= 4 * k * (3 + 1)  # three tasks, and the first ids
        assert hits.filter("score <= 0").count() <= 4 * k
    v = spark.createDataFrame([(f"c{i:03d}", [float(i % 13), 1.0]) for i in range(600)], "chunk_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "query_id int, vector array<double>")
    assert rank.vector_hits(v, asked, 5).count() <= 4 * 5 * 3


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    index = spark.createDataFrame([(f"c{i:02d}", f"w{i % 5} w{i % 3} x") for i in range(40)], "chunk_id string, text string")
    q = spark.createDataFrame([(i, f"w{i} x") for i in range(6)], "query_id int, text string")
    v = spark.createDataFrame([(f"c{i:02d}", [float(i % 7), 1.0]) for i in range(40)], "chunk_id string, vector array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "query_id int, vector array<double>")
    run = lambda: ({tuple(r) for r in rank.bm25(index, q, 7).collect()}, {tuple(r) for r in rank.vector_search(v, asked, 7).collect()})
    want = run()
    monkeypatch.setattr(rank, "QUERY_TERMS", 3)
    monkeypatch.setattr(rank, "QUERIES", 2)
    monkeypatch.setattr(rank, "CELLS", 20)
    assert run() == want and len(want[0]) == len(want[1]) == 42


def test_terms_are_found_in_one_pass(spark):
    q = spark.createDataFrame([(1, "The budding yeast, and its ABC genes of soil")], "query_id int, text string")
    assert {r.term for r in rank.query_terms(q).collect()} == {"budding yeast", "abc genes", "soil", "budding", "yeast,", "genes"}
    nodes = spark.createDataFrame([("budding yeast cell",), ("abc",), ("topsoil",), ("yeast",), ("none",)], "node string")
    edge = spark.createDataFrame([], "src string, dst string, weight double")
    assert {r.node for r in rank.matched_nodes(q, nodes, edge).collect()} == {"budding yeast cell", "topsoil"}
    for block in (1, 100):
        got = match.holding(spark.createDataFrame([(1, "abcab"), (2, None), (3, "")], "i int, t string"), "t", spark.createDataFrame([("ab",), ("bc",), ("",), (None,), ("ab",), ("x",)], "w string"), "w", block=block)
        assert sorted((r.i, r.word) for r in got.collect()) == [(1, "ab"), (1, "bc")]


def test_document_ranking_and_depth(spark):
    hits = spark.createDataFrame([(1, f"d{i // 3}:{i}:x", i + 1) for i in range(300)], "query_id int, chunk_id string, rank int")
    r = rank.doc_ranking(hits).collect()
    assert len(r) == 30 and {x.doc_id: x.doc_rank for x in r}["d29"] == 30
    assert [tuple(x) for x in rank.depth_reached(hits).collect()] == [(1, 30, 120)]
    assert [tuple(x) for x in rank.depth_reached(hits, depth=90).collect()] == [(1, 90, 480)]
    assert [tuple(x) for x in rank.depth_reached(hits, depth=200).collect()] == [(1, 100, 2000)]


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc_id string, doc_rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "c"), (1, "d")], "query_id int, doc_id string")
    both = {r.query_id: r for r in metrics.case_metrics(ranking, relevant, spark.createDataFrame([(1,), (2,)], "query_id int"), 3).collect()}
    m = both[1]
    assert both[2][1:] == (0, 0, 0, 0.0, 0.0, 0.0)
    ideal = sum(1 / math.log2(i + 2) for i in range(3))
    assert (m.relevant, m.found) == (3, 2) and m.recall == round(2 / 3, 6) and m.ndcg == round((1 + 0.5) / ideal, 6)
    assert {(r.doc_id, r.doc_rank) for r in metrics.per_item_hits(ranking, relevant).collect()} == {("a", 1), ("c", 3), ("d", None)}
    case = lambda n: spark.createDataFrame([("r", n, 1, 1, 0.5, 1.0, 0.25)], "ranker string, relevant int, found int, found_3k int, recall double, ceiling double, ndcg double")
    assert metrics.ladder(case(10).union(case(9))).first().recall is None
    r = metrics.ladder(case(10).union(case(10)).union(spark.createDataFrame([("r", 0, 0, 0, 0.0, 0.0, 0.0)], case(1).schema))).first()
    assert (r.cases, r.recall, r.ceiling, r.share_of_ceiling) == (3, round(1 / 3, 6), round(2 / 3, 6), 0.5)  # all cases count, shares need a ceiling


def test_ladder_rounds_halfway_means_alike_in_every_order(spark):
    ceilings = [0.0, 0.123457, 0.135135, 0.135135, 0.136986, 0.140845, 0.142857, 0.144928, 0.163934, 0.185185, 0.185185, 0.188679, 0.192308, 0.192308, 0.2, 0.2, 0.208333, 0.263158, 0.322581, 0.344828, 0.344828, 0.357143, 0.416667, 0.555556]
    rows = [(str(seed), 2, 1, 1, 0.0, c, 0.0) for seed in range(20) for c in random.Random(seed).sample(ceilings, len(ceilings))]
    cases = spark.createDataFrame(rows, "ranker string, relevant long, found long, found_3k long, recall double, ceiling double, ndcg double").coalesce(1)
    assert {r.ceiling for r in metrics.ladder(cases).collect()} == {0.220002}  # the mean is 0.2200015
