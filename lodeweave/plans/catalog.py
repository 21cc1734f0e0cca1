"""Queries of the core operators over the given tables, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, community, graph, lens, metrics, planting, rank, records, review
from ..session import materialize
from ..sources import corpus
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _index(spark, folder, excluded=None):
    return rank.index_chunks(table(spark, folder, "chunks"), excluded)


def _items(spark, folder):
    """One query per evaluation item."""
    return table(spark, folder, "eval_items").filter("text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text")).withColumnRenamed("item_id", "query_id")


def _excluded(spark, folder):
    return table(spark, folder, "twins").select(F.col("pmcid").alias("doc_id")).distinct()


def _clean(spark, folder, exclude=False):
    records_ = table(spark, folder, "chunk_extractions")
    if exclude:
        records_ = graph.without_documents(records_, _excluded(spark, folder))
    return graph.hygiene(graph.best_extractions(records_))


def _graph(spark, folder, exclude=False):
    clean = materialize(_clean(spark, folder, exclude), "extractions")
    m, r = graph.mentions(clean), graph.relations(clean)
    return m, r, graph.edges(m, r)


def _type_assignment(m):
    """A fixed assignment for the queries that SQL checks: nodes by their type."""
    number = F.create_map(*[F.lit(x) for i, t in enumerate(graph.ENTITY_TYPES) for x in (t, i)])
    return graph.nodes(m).select("node", F.element_at(number, F.col("node_type")).alias("community_id"))


def _reports(assignment, edge):
    tops = graph.top_members(assignment, edge)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]), " ")
    return tops.groupBy("community_id").agg(names.alias("text"))


def _communities(edge):
    """(assignment, reports) of the communities of the graph."""
    assignment = materialize(community.communities(edge, 1.0), "assignment")
    return assignment, materialize(_reports(assignment, edge), "reports")


@query
def sanitize_findings(spark, folder):
    each = table(spark, folder, "chunks").select("chunk_id", F.explode(tx.screened_lines(F.col("text"))).alias("l")).filter(F.size("l.kinds") > 0)
    return each.select("chunk_id", F.col("l.line_no").cast("long").alias("line_no"), F.explode("l.kinds").alias("k")).select("chunk_id", "line_no", "k.kind", "k.detail").distinct()


@query
def sanitize_text(spark, folder):
    return table(spark, folder, "chunks").filter("text IS NOT NULL").select("chunk_id", tx.short_hash(tx.sanitize(F.col("text")), 32).alias("clean_hash")).distinct()


@query
def chunk_words(spark, folder):
    t = F.col("text")
    return _index(spark, folder).select("chunk_id", tx.n_words(t).cast("long").alias("n_words"), F.size(tx.tokens(t)).cast("long").alias("n_tokens"), F.size(F.array_distinct(tx.tokens(t))).cast("long").alias("n_terms"))


@query
def chunk_ids(spark, folder):
    """Ids as they are made now against those stored: where a text has drifted they differ."""
    rows = table(spark, folder, "chunks").filter("text IS NOT NULL").select("chunk_id", tx.chunk_id(F.col("doc_id"), F.col("index"), F.col("text")).alias("fresh_id")).distinct()
    return rows.select("chunk_id", "fresh_id", (F.col("chunk_id") == F.col("fresh_id")).alias("same"))


@query
def term_statistics(spark, folder):
    ts = _index(spark, folder).select("chunk_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return ts.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query
def sentence_counts(spark, folder):
    return _index(spark, folder).select("chunk_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"))


@query
def chunk_documents(spark, folder):
    docs = table(spark, folder, "documents").filter("doc_id IS NOT NULL")
    return chunking.chunk_documents(docs, target_words=120, min_tail_words=20).select("chunk_id", "doc_id", "index", "text")


@query
def prompt_windows(spark, folder):
    need = tx.tokens_upper_bound(F.lit("Extract the entities."), F.col("text"), 1024)
    return _index(spark, folder).select("chunk_id", need.cast("long").alias("tokens_bound"), tx.window_for(need).cast("long").alias("window"))


@query
def bm25_batch(spark, folder):
    return rank.bm25(materialize(_index(spark, folder), "index"), _items(spark, folder), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@query
def vector_batch(spark, folder):
    """Every row of embeddings whose id is divisible by 50 against all rows."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return rank.vector_search(rows, asked, 10, key="vec_id").select("query_id", "vec_id", "score", F.col("rank").cast("long"))


def _cases(spark, folder):
    """(query_id, text, vector): a case per twin, its title as text, the vector of its first chunk that has one."""
    t = table(spark, folder, "twins").groupBy("pmcid").agg(F.min("title").alias("text"))
    v = _vectors(spark, folder).withColumn("pmcid", tx.doc_of(F.col("chunk_id"))).join(F.broadcast(t.select("pmcid")), "pmcid", "left_semi").groupBy("pmcid").agg(F.min_by("vector", "chunk_id").alias("vector"))
    return t.join(v, "pmcid", "left").withColumnRenamed("pmcid", "query_id")


def _vectors(spark, folder):
    v = table(spark, folder, "index_vectors").filter((F.size("vector") == 64) & F.col("chunk_id").isNotNull())
    return v.groupBy("chunk_id").agg(F.min("vector").alias("vector"))


def _case_rankings(spark, folder, k):
    out = _excluded(spark, folder)
    index = materialize(_index(spark, folder, out), "index")
    cases = materialize(_cases(spark, folder), "cases")
    vectors = _vectors(spark, folder).join(index.select("chunk_id"), "chunk_id", "left_semi")
    lexical = rank.bm25(index, cases.select("query_id", "text"), k)
    dense = rank.vector_search(vectors, cases.select("query_id", "vector"), k)
    return index, cases, vectors, lexical, dense


@query
def rrf_hybrid(spark, folder):
    *_, lexical, dense = _case_rankings(spark, folder, 20)
    return rank.rrf([lexical, dense], 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


def _relevant(spark, folder, index, cases):
    docs = corpus.latest_documents(table(spark, folder, "corpus_docs"))
    near = corpus.shared_authors(docs, cases.select("query_id", F.col("query_id").alias("pmcid")))
    return near.join(index.select("doc_id").distinct(), "doc_id", "left_semi")


@query
def case_metrics(spark, folder):
    index, cases, _, lexical, _ = _case_rankings(spark, folder, 2000)
    ranked = rank.doc_ranking(lexical)
    return metrics.case_metrics(ranked, _relevant(spark, folder, index, cases), cases)


@query
def doc_ranking(spark, folder):
    *_, lexical, _ = _case_rankings(spark, folder, 2000)
    return rank.doc_ranking(lexical).select("query_id", "doc_id", F.col("doc_rank").cast("long"))


@query
def depth_reached(spark, folder):
    *_, lexical, _ = _case_rankings(spark, folder, 2000)
    return rank.depth_reached(lexical).select("query_id", F.col("documents").cast("long"), F.col("chunk_depth").cast("long"))


@query
def ladder(spark, folder):
    """All five rankers over all cases at equal document depth."""
    index, cases, vectors, lexical, dense = _case_rankings(spark, folder, 2000)
    m, _, edge = _graph(spark, folder, exclude=True)
    edge = materialize(edge, "edges")
    assignment, reports = _communities(edge)
    rankers = {
        "bm25": lexical,
        "vector": dense,
        "rrf": rank.rrf([lexical, dense], 2000),
        "graph_local": rank.graph_local(cases, m, edge, index, 2000, vectors=vectors),
        "graph_global": rank.graph_global(cases.select("query_id", "text"), reports, assignment, m, index, 2000),
    }
    return _ladder(rankers, _relevant(spark, folder, index, cases), cases)


def _ladder(rankers, relevant, cases):
    relevant = materialize(relevant, "relevant")
    parts = [metrics.case_metrics(rank.doc_ranking(r), relevant, cases).withColumn("ranker", F.lit(name)) for name, r in rankers.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return metrics.ladder(every)


@query
def ladder_of_indexes(spark, folder):
    """The ladder of the three rankers that need no graph."""
    index, cases, _, lexical, dense = _case_rankings(spark, folder, 2000)
    lexical, dense = materialize(lexical, "lexical"), materialize(dense, "dense")
    return _ladder({"bm25": lexical, "vector": dense, "rrf": rank.rrf([lexical, dense], 2000)}, _relevant(spark, folder, index, cases), cases)


@query
def exclusion_audit(spark, folder):
    return rank.exclusion_audit(table(spark, folder, "chunks"), _excluded(spark, folder))


@query
def graph_nodes(spark, folder):
    m, _, _ = _graph(spark, folder)
    return graph.nodes(m)


@query
def graph_edges(spark, folder):
    return _graph(spark, folder)[2]


@query
def graph_exclusion_delta(spark, folder):
    """Edges whose weight differs in the graph built without the excluded documents; gone ones have weight 0."""
    full, kept = _graph(spark, folder)[2], _graph(spark, folder, exclude=True)[2]
    both = full.select("src", "dst", F.col("weight").alias("full_weight")).join(kept.select("src", "dst", F.col("weight").alias("run_weight")), ["src", "dst"], "left").fillna(0.0, ["run_weight"])
    return both.filter("full_weight <> run_weight")


@query
def lost_nodes(spark, folder):
    m, _, _ = _graph(spark, folder)
    return m.select("node").distinct().join(graph.live_nodes(m, _excluded(spark, folder)), "node", "left_anti")


@query
def node_spellings(spark, folder):
    """How often each node is spelled and typed how."""
    each = graph.node_variants(_graph(spark, folder)[0])
    flat = lambda c: each.select("node", F.lit(c).alias("kind"), F.explode(c).alias("value", "n"))
    return flat("variants").unionByName(flat("types"))


@query
def edge_predicates(spark, folder):
    return graph.edge_predicates(_graph(spark, folder)[1])


@query
def build_stats(spark, folder):
    clean = _clean(spark, folder)
    m, _, edge = _graph(spark, folder)
    return graph.build_stats(clean, m, edge).drop("resolution")


@query
def relation_lines(spark, folder):
    m, r, edge = _graph(spark, folder)
    lines = graph.relation_lines(graph.top_members(_type_assignment(m), edge), edge, r)
    return lines.select("community_id", F.explode("lines").alias("line"))


@query
def top_members(spark, folder):
    m, _, edge = _graph(spark, folder)
    return graph.top_members(_type_assignment(m), edge).select("community_id", F.col("size").cast("long"), F.col("rank").cast("long"), "node", "degree")


@query
def largest_groups(spark, folder):
    m, _, _ = _graph(spark, folder)
    return graph.largest_communities(_type_assignment(m)).select("community_id", F.col("size").cast("long"))


@query
def graph_local_search(spark, folder):
    out = _excluded(spark, folder)
    m, _, edge = _graph(spark, folder, exclude=True)
    return rank.graph_local(_cases(spark, folder), m, edge, _index(spark, folder, out), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@query
def graph_global_search(spark, folder):
    out = _excluded(spark, folder)
    m, _, edge = _graph(spark, folder, exclude=True)
    assignment = materialize(_type_assignment(m), "assignment")
    reports = materialize(_reports(assignment, edge), "reports")
    found = rank.graph_global(materialize(_cases(spark, folder).select("query_id", "text"), "cases"), reports, assignment, m, _index(spark, folder, out), 10)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@query
def graph_community_search(spark, folder):
    """As graph_global_search, over the reports of the communities of the graph."""
    out = _excluded(spark, folder)
    m, _, edge = _graph(spark, folder, exclude=True)
    assignment, reports = _communities(materialize(edge, "edges"))
    found = rank.graph_global(materialize(_cases(spark, folder).select("query_id", "text"), "cases"), reports, assignment, m, _index(spark, folder, out), 10)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


@query
def ranked_reports(spark, folder):
    """The eight best community reports of each case by BM25+."""
    m, _, edge = _graph(spark, folder, exclude=True)
    reports = materialize(_reports(materialize(_type_assignment(m), "assignment"), edge), "reports")
    best = rank.bm25_plus(reports, materialize(_cases(spark, folder).select("query_id", "text"), "cases"))
    return best.select("query_id", F.col("community_id").cast("long"), "score", F.col("rank").cast("long"))


@query
def communities(spark, folder):
    _, _, edge = _graph(spark, folder)
    return community.communities(materialize(edge, "edges"), 1.0)


@query
def community_modularity(spark, folder):
    edge = materialize(_graph(spark, folder)[2], "edges")
    parts = [community.modularity(edge, community.communities(edge, r), r).withColumn("resolution", F.lit(r)) for r in community.RESOLUTIONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def latest_documents(spark, folder):
    return corpus.latest_documents(table(spark, folder, "corpus_docs")).select("pmcid", "version", corpus.license_key(F.col("license_code")).alias("license"), "title", F.coalesce(F.size("authors"), F.lit(0)).cast("long").alias("n_authors"))


@query
def license_gate(spark, folder):
    return corpus.gate(table(spark, folder, "corpus_docs").select("pmcid", "license_code").distinct())


def _first_copies(spark, folder):
    """(pmcid, md5): the row of a document that was fetched first, the copy that is stored."""
    docs = table(spark, folder, "corpus_docs").filter("pmcid IS NOT NULL")
    return docs.groupBy("pmcid").agg(F.min_by("md5", F.struct("version", corpus.fetch_date(F.col("fetched_at")).alias("date"), F.coalesce("md5", F.lit("")).alias("md5"))).alias("md5"))


@query
def corpus_status(spark, folder):
    """The latest versions of the corpus table against the first copies of those documents that have chunks."""
    want = corpus.latest_documents(table(spark, folder, "corpus_docs")).select(F.col("pmcid").alias("doc_id"), "md5")
    chunked = table(spark, folder, "chunks").filter("doc_id IS NOT NULL").select("doc_id").distinct()
    have = chunked.join(_first_copies(spark, folder).withColumnRenamed("pmcid", "doc_id"), "doc_id", "left")
    return corpus.status(want, have)


def _sync(spark, folder):
    """First copies are pinned; what has chunks is stored in its latest form; upstream has the latest of all."""
    latest = corpus.latest_documents(table(spark, folder, "corpus_docs"))
    chunked = table(spark, folder, "chunks").select(F.col("doc_id").alias("pmcid")).distinct()
    return corpus.sync(_first_copies(spark, folder), latest.select("pmcid", "md5").join(chunked, "pmcid", "left_semi"), latest)


@query
def sync_outcomes(spark, folder):
    return _sync(spark, folder)


@query
def outcome_counts(spark, folder):
    return _sync(spark, folder).groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"))


@query
def candidate_list(spark, folder):
    """Twins as seeds, authors in common as links, all other documents as topical finds, up to a thousand that aren't forced."""
    latest = corpus.latest_documents(table(spark, folder, "corpus_docs"))
    seeds = table(spark, folder, "twins").select("pmcid").distinct()
    links = corpus.shared_authors(latest, seeds.select(F.col("pmcid").alias("query_id"), "pmcid")).select(F.col("query_id").alias("citing"), F.col("doc_id").alias("cited"))
    found = corpus.citation_candidates(seeds, links, latest.filter(corpus.refusal(latest).isNull()).select("pmcid"))
    return corpus.within_target(found, 1000).select("pmcid", F.col("class").cast("long"), "forced")


@query
def upserted_documents(spark, folder):
    """First copies with the rows of later versions put in their place."""
    first = _first_copies(spark, folder)
    later = corpus.latest_documents(table(spark, folder, "corpus_docs")).filter("version > 1").select("pmcid", "md5")
    return corpus.upsert(first, later, "pmcid")


@query
def excluded_by_preprint(spark, folder):
    twins = table(spark, folder, "twins")
    return corpus.excluded_documents(twins, twins.select("preprint_doi"))


def _manuscripts(spark, folder):
    """(preprint_doi, title, body): a twin with the longest text of its document."""
    longest = F.struct(F.length("text"), "text")
    body = table(spark, folder, "documents").filter("pmcid is not null and text is not null").groupBy("pmcid").agg(F.max_by("text", longest).alias("body"))
    return table(spark, folder, "twins").groupBy("preprint_doi").agg(F.min_by("title", "pmcid").alias("title"), F.min("pmcid").alias("pmcid")).join(body, "pmcid", "left").select("preprint_doi", "title", "body")


@query
def query_cases(spark, folder):
    """Cases of the twins; documents with an author in common count as cited."""
    twins = table(spark, folder, "twins").select("preprint_doi", "pmcid").distinct()
    cited = corpus.shared_authors(corpus.latest_documents(table(spark, folder, "corpus_docs")), twins.select(F.col("preprint_doi").alias("query_id"), "pmcid"))
    cases, _ = review.query_cases(_manuscripts(spark, folder), twins, cited.withColumnRenamed("query_id", "preprint_doi"), _index(spark, folder).select("doc_id"))
    return cases.select("preprint_doi", "query", F.array_join("relevant_docs", ",").alias("relevant"), F.array_join("excluded_docs", ",").alias("excluded"))


@query
def derived_queries(spark, folder):
    return review.derived_queries(_manuscripts(spark, folder)).select("preprint_doi", F.col("nr").cast("long"), "query")


@query
def planted_errors(spark, folder):
    """Errors planted into every document, one of each kind that finds a place in its first 900 words."""
    docs = table(spark, folder, "documents").filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return planting.plant(docs, window_words=900)[1]


@query
def planted_detection(spark, folder):
    """Which planted errors the findings of each model name and assert, for documents that findings cite, by model and document."""
    docs = table(spark, folder, "documents").filter("pmcid is not null and text is not null").groupBy("pmcid").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    f = _findings(spark, folder).filter("model is not null").select(F.col("model").alias("arm"), "text", F.explode("evidence_chunk_ids").alias("c")).select("arm", "text", tx.doc_of(F.col("c")).alias("source")).distinct()
    cited = docs.join(f.select(F.col("source").alias("pmcid")).distinct(), "pmcid", "left_semi").withColumnRenamed("pmcid", "doc_id")
    planted, errors = planting.plant(cited, window_words=900)
    e = materialize(errors, "errors").join(planted.select("doc_id", F.col("text").alias("manuscript")), "doc_id").select(F.col("doc_id").alias("source"), "error_id", "token", "manuscript")
    return records.planted_scores(materialize(e, "scored"), f)


@query
def attribution(spark, folder):
    return corpus.attribution(corpus.latest_documents(table(spark, folder, "corpus_docs")))


@query
def related_by_author(spark, folder):
    return corpus.shared_authors(corpus.latest_documents(table(spark, folder, "corpus_docs")), table(spark, folder, "twins").select(F.col("pmcid").alias("query_id"), "pmcid").distinct())


def _findings(spark, folder):
    return records.latest(table(spark, folder, "review_findings"), "finding_id", "received_at")


@query
def span_grounding(spark, folder):
    return records.grounding(_findings(spark, folder), _index(spark, folder))


@query
def finding_hygiene(spark, folder):
    kept = records.finding_hygiene(_findings(spark, folder), _index(spark, folder))
    return kept.select("finding_id", F.size("evidence").cast("long").alias("n_evidence"), F.col("dropped_ids").cast("long"))


@query
def own_prose_residue(spark, folder):
    """What a finding says beyond its own quote: sentences of its text that aren't in the quote."""
    f = _findings(spark, folder).filter("text IS NOT NULL")
    return f.select("finding_id", F.length(tx.own_prose(F.col("text"), F.coalesce("quote", F.lit("")))).cast("long").alias("own_chars"), F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"), tx.quoted_sentences(F.col("text"), F.coalesce("quote", F.lit(""))).cast("long").alias("quoted"))


def _scored(spark, folder):
    level = F.lower(F.trim("severity"))
    score = F.when(level == "minor", 4).when(level == "major", 2).when(level == "critical", 1)
    return _findings(spark, folder).select("run_id", "dimension", "reviewer", score.alias("score"))


@query
def cut_prompts(spark, folder):
    """Findings whose words, taken for a server's count of tokens, are too few for their characters."""
    f = _findings(spark, folder)
    return f.select("finding_id", tx.was_cut(tx.n_words(F.col("text")) + tx.n_words(F.col("quote")), F.col("text"), F.col("quote")).alias("cut"))


@query
def score_conflicts(spark, folder):
    return records.score_conflicts(_scored(spark, folder)).select("run_id", "dimension", "reviewers", F.col("lowest").cast("long"), F.col("highest").cast("long"))


def _calls(spark, folder):
    need = tx.tokens_upper_bound(F.col("text"), F.col("quote"), 512).cast("long")
    answer = tx.n_words(F.col("text")).cast("long")
    return _findings(spark, folder).select("run_id", "finding_id", "created_at", need.alias("prompt_tokens"), answer.alias("answer_tokens"), tx.window_for(need).cast("long").alias("context"), F.split_part("model", F.lit(":"), F.lit(1)).alias("source"))


@query
def ledger_stats(spark, folder):
    return records.ledger(_calls(spark, folder))


@query
def budget_cut(spark, folder):
    cut = records.within_budget(_calls(spark, folder), "run_id", ["created_at", "finding_id"], "prompt_tokens", 4000)
    return cut.select("run_id", "finding_id", "spent_before", F.col("nr").cast("long"))


@query
def grounded_rates(spark, folder):
    """Share of findings whose quote an evidence chunk holds, by reviewer and overall; rates of few are withheld."""
    g = records.grounding(_findings(spark, folder), _index(spark, folder)).filter("named > 0")
    v = g.join(_findings(spark, folder).select("finding_id", F.col("reviewer").alias("source")), "finding_id").select("source", F.lit(True).alias("swapped"), (F.col("grounded") > 0).alias("swap_consistent"))
    return records.consistency(v)


@query
def run_records(spark, folder):
    return review.run_records(_findings(spark, folder), _index(spark, folder), _scored(spark, folder), _calls(spark, folder))


@query
def finding_claims(spark, folder):
    """The distinct sentences of each run's findings as claims."""
    texts = _findings(spark, folder).select(F.col("run_id").alias("id"), F.col("finding_id").alias("position"), "text")
    return review.claims(texts, "panel")


@query
def verdicts(spark, folder):
    """Each finding with evidence as a claim, judged in both orders by a rule that reads only the first chunk that exists: it supports a
    claim whose quote stands there, and can't tell otherwise."""
    f = _findings(spark, folder).filter("evidence_chunk_ids is not null").select(F.col("finding_id").alias("claim_id"), "quote", F.array_distinct("evidence_chunk_ids").alias("chunk_ids"))
    ranked = f.select("claim_id", F.posexplode("chunk_ids").alias("rank", "chunk_id")).join(_index(spark, folder).select("chunk_id", "text"), "chunk_id")
    held = ranked.join(f.select("claim_id", "quote"), "claim_id").select("claim_id", "rank", "chunk_id", "quote", F.coalesce((tx.squeeze(F.col("quote")) != "") & F.contains(tx.squeeze(F.col("text")), tx.squeeze(F.col("quote"))), F.lit(False)).alias("holds"))
    row = F.struct("chunk_id", "quote", "holds")
    ends = held.groupBy("claim_id").agg(F.min_by(row, "rank").alias("first"), F.max_by(row, "rank").alias("last"))
    judged = ends.select("claim_id", F.posexplode(F.array("first", "last")).alias("ord", "x"))
    spans = F.when(F.col("x.holds"), F.array(F.struct("x.chunk_id", "x.quote")))
    judged = judged.select("claim_id", "ord", F.when(F.col("x.holds"), records.SUPPORTS).otherwise(records.OPEN).alias("verdict"), spans.alias("spans"))
    out = records.swap_verdicts(judged, f)
    return out.select("claim_id", "verdict", F.array_join(F.transform("spans", lambda x: x["chunk_id"]), ",").alias("cited"), "swapped", "swap_consistent")


@query
def pooled_findings(spark, folder):
    """The findings of a reviewer over all its runs, each text once."""
    f = _findings(spark, folder)
    return records.pooled_findings(f.select(F.col("dimension").alias("source"), F.col("reviewer").alias("arm"), F.col("run_id").alias("sample"), "text")).select("source", "arm", "text", "samples")


@query
def token_collisions(spark, folder):
    """In how many corpus documents a twin's whole title stands, and each of its words."""
    titles = table(spark, folder, "twins").select(F.trim("title").alias("title"))
    token = titles.select(F.explode(F.array_append(F.split("title", " "), F.col("title"))).alias("token")).filter("token <> ''").distinct()
    return records.token_collisions(token, _index(spark, folder).select("doc_id", "text"))


@query
def lens_findings(spark, folder):
    return lens.lens(_index(spark, folder), "chunk_id").withColumnRenamed("id", "chunk_id")


@query
def reference_checks(spark, folder):
    """The rule checks over a bibliography of each author: a line for every row of the corpus table, fetched again or not, with its DOI as given."""
    docs = table(spark, folder, "corpus_docs").filter("pmcid is not null")
    rows = docs.select(F.explode(F.array_distinct("authors")).alias("author"), "pmcid", "version", F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce(tx.squeeze(F.col("title")), F.lit("")).alias("title")).distinct()
    entries = rows.groupBy("author").agg(F.array_sort(F.collect_list(F.struct("pmcid", "version", "doi", "title"))).alias("e"))
    lines = F.transform("e", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["title"], F.lit(" doi: "), x["doi"]))
    texts = entries.select("author", F.concat(F.lit("As said in ["), (F.size("e") + 1).cast("string"), F.lit("].\nReferences\n"), F.array_join(lines, "\n")).alias("text"))
    return lens.lens(texts, "author").select(F.col("id").alias("author"), F.col("line_no").cast("long").alias("line_no"), "check", "severity", "detail")


@query
def citation_dois(spark, folder):
    """The DOI in a document's citation against its own, both normalised."""
    inside = F.lower(F.rtrim(F.trim(F.regexp_extract("citation", lens.DOI, 1)), F.lit(lens.DOI_END)))
    rows = table(spark, folder, "corpus_docs").select("pmcid", F.when(inside != "", inside).alias("cited"), corpus.clean_doi(F.col("doi")).alias("own")).distinct()
    return rows.select("pmcid", "cited", "own", (F.col("cited") == F.col("own")).alias("same"))


@query
def event_windows(spark, folder):
    """Events by type and hour, late rows and all; the streaming form of it is in streaming.windows."""
    return table(spark, folder, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
