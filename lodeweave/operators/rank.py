"""Five rankers over an index of chunks, each for a whole table of queries at once.

Queries are (query_id, text); rankings are (query_id, chunk_id, score, rank), rank from 1 by score, then
chunk_id. Scores are rounded to six digits before they are ranked, so the order of a sum of floats
doesn't show. Queries are the small side: every join goes from their terms to postings of those terms.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_of, node_key, tokens
from ..session import broadcast_if_small, materialize
from .graph import both_ways
from .match import holding

K1, B, EPSILON, DELTA = 1.5, 0.75, 0.25, 1.0
RRF_K, NEIGHBOUR_DAMP, TOP_COMMUNITIES = 60, 0.5, 8
#: Query terms, and query vectors, that go to the tasks at a time.
QUERY_TERMS, QUERIES = 2_000_000, 20_000
#: Scores a task holds at once.
CELLS = 4_000_000
#: Words that end a candidate term: articles, pronouns, prepositions, conjunctions, auxiliaries.
FUNCTION_WORDS = (
    "a", "an", "the", "this", "that", "these", "those", "it", "its", "we", "our", "they", "their", "which", "who", "what",
    "of", "in", "on", "at", "by", "for", "from", "to", "into", "with", "without", "within", "between", "during", "after", "before", "under", "over", "through", "via",
    "and", "or", "but", "nor", "than", "as", "if", "when", "while", "because", "how", "not", "no",
    "is", "are", "was", "were", "be", "been", "has", "have", "had", "can", "may", "does", "do",
)


def index_chunks(chunks: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(chunk_id, doc_id, text), one row per chunk_id with words in it; excluded documents' chunks left out."""
    rows = chunks.filter(F.col("text").rlike(r"(?U)\S") & F.col("chunk_id").isNotNull()).select("chunk_id", "text")
    if excluded is not None:
        rows = rows.withColumn("doc_id", doc_of(F.col("chunk_id"))).join(excluded.select("doc_id").distinct(), "doc_id", "left_anti")
    rows = rows.groupBy("chunk_id").agg(F.min("text").alias("text"))
    return rows.select("chunk_id", doc_of(F.col("chunk_id")).alias("doc_id"), "text")


def exclusion_audit(chunks: DataFrame, excluded: DataFrame) -> DataFrame:
    """(doc_id, dropped_chunks) of the documents whose chunks an exclusion really drops."""
    return index_chunks(chunks).join(excluded.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("dropped_chunks"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", item: str = "chunk_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), item))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


class Best:
    """The best k rows of each query that a task has seen: by score, ties by name."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.held: list[tuple] = []
        self.loose, self.room = 0, max(100_000, 2 * k * queries)

    def add(self, query: np.ndarray, names: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.floor[query]
        self.held.append((query[keep], names[keep], score[keep]))
        self.loose += len(self.held[-1][0])
        if self.loose > self.room:
            self.cut()

    def cut(self) -> tuple:
        if not self.held:
            return ()
        query, names, score = (np.concatenate(x) for x in zip(*self.held))
        by = np.lexsort((names, -score, query))
        query, names, score = query[by], names[by], score[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor[query[last]] = score[last]
        top = place < self.k
        self.held, self.loose = [(query[top], names[top], score[top])], 0
        return self.held[0]

    def batches(self, ids: pa.Array, key: str, kind: pa.DataType):
        """What is held, as (query_id, key, score)."""
        got = self.cut()
        for s in range(0, len(got[0]) if got else 0, 100_000):
            query, names, score = (x[s : s + 100_000] for x in got)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(names.tolist(), kind), pa.array(score)], ["query_id", key, "score"])


def _blocks(queries: DataFrame, size: int, rows: int) -> list[Column]:
    """Conditions that cut queries into parts of about `size` queries each, and of as many as `rows` allows."""
    n = max(1, -(-queries.select("query_id").distinct().count() // max(1, size)), rows)
    return [F.pmod(F.xxhash64("query_id"), F.lit(n)) == b for b in range(n)]


def bm25(texts: DataFrame, queries: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """Okapi BM25. Negative idf becomes EPSILON times the mean idf of all terms (0 where that is negative, too); a term repeated in a query
    counts again. Where fewer than k chunks match, the ranking goes on with score 0 in order of id.
    An empty index gives no rows.
    """
    return top_k(bm25_hits(texts, queries, k, key), k, item=key)


def bm25_hits(texts: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score): of every task at most its k best chunks of each query, and the first k ids with every query.

    Document frequencies are one grouping over the corpus. The query terms with their weights go to every task as lists of
    queries per term, a block of queries at a time; a task scores its chunks against all queries of the block
    and sends k of each at its end, so neither postings nor scores of whole rankings are shuffled.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    sized = texts.select(key, tokens(F.col("text")).alias("ts"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("avg_size")).first()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {texts.schema[key].dataType.simpleString()}, score double"
    if not stats.n:
        return texts.sparkSession.createDataFrame([], schema)
    df = sized.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = materialize(df.select("term", (F.log(F.lit(stats.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")), "idf")
    mean = max(raw.agg(F.avg("idf")).first()[0] or 0.0, 0.0)
    known = materialize(asked.join(raw, "term").withColumn("idf", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf"))), "known")
    first = np.array([r[0] for r in texts.select(key).orderBy(key).limit(k).collect()])
    context = texts.sparkSession.sparkContext
    parts = []
    for part in _blocks(queries, CELLS // k, -(-known.count() // QUERY_TERMS)):
        ids = queries.filter(part).select("query_id").distinct().orderBy("query_id").toArrow().column(0).combine_chunks()
        weights = context.broadcast((_term_lists(known.filter(part).toArrow(), ids), ids, first))
        parts.append(texts.select(key, "text").mapInArrow(_bm25_task(weights, stats.avg_size, k, key), schema))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _term_lists(known: pa.Table, ids: pa.Array) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each term the queries that hold it, by place in ids, and their weights."""
    place = {v: i for i, v in enumerate(ids.to_pylist())}
    terms: dict[str, list] = {}
    for q, t, n, w in zip(*(known.column(c).to_pylist() for c in ("query_id", "term", "times", "idf"))):
        terms.setdefault(t, []).append((place[q], n * w * (K1 + 1)))
    return {t: tuple(map(np.array, zip(*sorted(x)))) for t, x in terms.items()}


def _bm25_task(weights, avg_size: float, k: int, key: str):
    def run(batches):
        lists, ids, first = weights.value
        word, every, kind = re.compile("[a-z0-9]+").findall, np.arange(len(ids)), None
        best, first = Best(len(ids), k), set(first.tolist())
        for batch in batches:
            kind = batch.column(0).type
            names = np.array(batch.column(0).to_pylist())
            got: list[tuple] = []
            for r, text in enumerate(batch.column(1).to_pylist()):
                found = word((text or "").lower())
                base = K1 * (1 - B + B * len(found) / avg_size) if avg_size else K1
                met = [(lists[t], n / (n + base)) for t, n in Counter(found).items() if t in lists]
                score = np.zeros(0)
                if met:  # sums of the queries that are met, whichever way is shorter
                    q, w = np.concatenate([x[0] for x, _ in met]), np.concatenate([x[1] * f for x, f in met])
                    if 4 * len(q) < len(ids):
                        at, q = np.unique(q, return_inverse=True)
                        score = np.bincount(q, w)
                    else:
                        score = np.bincount(q, w, len(ids))
                        at = np.flatnonzero(score > 0)
                        score = score[at]
                if names[r] in first:
                    score, at = np.bincount(at, score, len(ids)) if len(score) else np.zeros(len(ids)), every
                if len(score):
                    got.append((at, np.full(len(at), r), np.maximum(np.round(score, 6), 0)))
            if got:
                q, r, score = (np.concatenate(x) for x in zip(*got))
                best.add(q, names[r], score)
        yield from best.batches(ids, key, kind)

    return run


def bm25_plus(reports: DataFrame, queries: DataFrame, k: int = TOP_COMMUNITIES, key: str = "community_id") -> DataFrame:
    """BM25+ over reports (key, text): every known query term adds DELTA times its idf to every report; all are ranked."""
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    sized = reports.select(key, tokens(F.col("text")).alias("ts"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("avg_size"))
    df = sized.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", F.log((F.col("n") + 1) / F.col("df")))
    base = known.groupBy("query_id").agg(F.sum(F.col("idf") * F.col("times") * DELTA).alias("base"))
    tf = sized.select(key, F.size("ts").alias("size"), F.explode("ts").alias("term")).groupBy("term", key, "size").agg(F.count(F.lit(1)).alias("tf"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avg_size"))
    gain = tf.join(broadcast_if_small(known), "term").groupBy("query_id", key).agg(F.sum(F.col("idf") * F.col("times") * F.col("tf") * (K1 + 1) / norm).alias("gain"))
    best = gain.join(base, "query_id").select("query_id", key, F.round(F.col("gain") + F.col("base"), 6).alias("score"))
    best = top_k(best, k, item=key).drop("rank")
    spare = reports.select(key).orderBy(key).limit(2 * k)
    fill = base.select("query_id", F.round("base", 6).alias("score")).crossJoin(F.broadcast(spare)).join(best.select("query_id", key), ["query_id", key], "left_anti")
    return top_k(best.unionByName(fill.select("query_id", key, "score")), k, item=key)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, in order of position."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """Cosine of normalised queries (query_id, vector) with the stored vectors as they are: (query_id, key, score, rank).

    The queries go to every task, a block at a time; a task keeps k per query, and only those are shuffled. Stored vectors of
    another length than the queries and with nulls are left out; queries of different lengths raise.
    """
    return top_k(vector_hits(vectors, queries, k, key), k, item=key)


def vector_hits(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score): of every task at most its k best rows of each query."""
    asked = queries.filter(F.size("vector") > 0).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *vectors.schema.fields]}
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {kinds[key]}, score double"
    dims = [r[0] for r in asked.select(F.size("vector")).distinct().limit(2).collect()]
    if len(dims) != 1:
        if not dims:
            return vectors.sparkSession.createDataFrame([], schema)
        raise ValueError("query vectors of different lengths")
    stored = vectors.filter((F.size("vector") == dims[0]) & ~F.exists("vector", lambda x: x.isNull())).select(key, F.col("vector").cast("array<double>").alias("vector"))
    parts = []
    for part in _blocks(asked, min(QUERIES, CELLS // k), 1):
        block = asked.filter(part).orderBy("query_id").toArrow()
        q = block.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims[0])
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, norm, out=q.copy(), where=norm > 0)
        parts.append(stored.mapInArrow(_vector_task(vectors.sparkSession.sparkContext.broadcast((q, block.column("query_id").combine_chunks())), k, key), schema))
    return _union(parts)


def _vector_task(asked, k: int, key: str):
    def run(batches):
        q, ids = asked.value
        best, kind = Best(len(q), k), None
        step = max(16, min(4096, CELLS // max(1, len(q))))
        for batch in batches:
            kind = batch.column(0).type
            names = np.array(batch.column(0).to_pylist())
            for at in range(0, batch.num_rows, step):
                part = batch.column(1).slice(at, step)
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                score = np.round(q @ x.T, 6)
                floor = best.floor
                if score.shape[1] > k:
                    floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
                i, j = np.nonzero(score >= floor[:, None])
                best.add(i, names[at + j], score[i, j])
        yield from best.batches(ids, key, kind)

    return run


def rrf(rankings: list[DataFrame], k: int = 10, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (60 + rank) over the rankings."""
    every = rankings[0].select("query_id", key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", key, "rank"))
    return top_k(every.groupBy("query_id", key).agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 6).alias("score")), k, item=key)


def candidate_terms(text: Column) -> Column:
    """Stand-in for noun phrases: the distinct runs of words between function words and punctuation, of three characters or more with a letter."""
    plain = F.regexp_replace(node_key(text), r"[^\p{L}\p{N} -]|\b(?:" + "|".join(FUNCTION_WORDS) + r")\b", "|")
    return F.array_distinct(F.filter(F.transform(F.split(plain, r"\|"), lambda t: F.trim(t)), lambda t: (F.length(t) >= 3) & t.rlike(r"\p{L}")))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): candidate terms and the white-space tokens of four characters or more, punctuation attached."""
    plain = F.filter(F.split(node_key(F.col("text")), " "), lambda t: F.length(t) >= 4)
    return queries.select("query_id", F.explode(F.array_distinct(F.concat(candidate_terms(F.col("text")), plain))).alias("term"))


def matched_nodes(queries: DataFrame, live: DataFrame, edge: DataFrame) -> DataFrame:
    """(query_id, node, weight): live nodes equal to a query term or holding it (four characters or more) weigh 1;
    their live neighbours half their edge over the seed's heaviest edge; a node keeps the most.

    All terms are looked for in one pass over the nodes.
    """
    terms = query_terms(queries)
    held = holding(live.select("node"), "node", terms, "term").filter((F.col("node") == F.col("word")) | (F.length("word") >= 4))
    seeds = materialize(held.join(terms.withColumnRenamed("term", "word"), "word").select("query_id", "node").distinct(), "seeds")
    # the heaviest edge counts dead neighbours, too
    scaled = both_ways(edge)
    heaviest = scaled.groupBy("node").agg(F.max("weight").alias("most"))
    bonus = seeds.join(scaled, "node").join(heaviest, "node").select("query_id", F.col("other").alias("node"), (NEIGHBOUR_DAMP * F.col("weight") / F.col("most")).alias("weight"))
    bonus = bonus.join(live, "node", "left_semi")
    return seeds.withColumn("weight", F.lit(1.0)).unionByName(bonus).groupBy("query_id", "node").agg(F.max("weight").alias("weight"))


def graph_local(queries: DataFrame, mentioned: DataFrame, edge: DataFrame, index: DataFrame, k: int = 10, *, vectors: DataFrame | None = None) -> DataFrame:
    """Chunks by the summed weights of their matched nodes; with vectors (chunk_id, vector) and query vectors,
    the cosine is added for chunks that have votes."""
    held = mentioned.select("chunk_id", "node").distinct().join(index.select("chunk_id"), "chunk_id", "left_semi")
    weight = matched_nodes(queries, held.select("node").distinct(), edge)
    votes = weight.join(held, "node").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score"))
    if vectors is not None:
        q = F.col("qv").cast("array<double>")
        norm = F.sqrt(dot(q, q))
        asked = queries.select("query_id", F.col("vector").alias("qv"))
        both = votes.join(vectors.select("chunk_id", "vector"), "chunk_id", "left").join(broadcast_if_small(asked), "query_id", "left")
        cosine = F.when(norm > 0, dot(q, F.col("vector")) / norm).otherwise(0.0)
        votes = both.select("query_id", "chunk_id", (F.col("score") + F.coalesce(cosine, F.lit(0.0))).alias("score"))
    return top_k(votes.withColumn("score", F.round("score", 6)), k)


def graph_global(queries: DataFrame, reports: DataFrame, assignment: DataFrame, mentioned: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """Chunks of the live members of the eight best reports (community_id, text), by the summed report scores."""
    best = bm25_plus(reports, queries).filter("score > 0").select("query_id", "community_id", "score")
    held = mentioned.select("chunk_id", "node").distinct().join(index.select("chunk_id"), "chunk_id", "left_semi")
    # members per chunk and community first, so that a query meets each chunk once
    inside = held.join(assignment, "node").groupBy("community_id", "chunk_id").agg(F.count(F.lit(1)).alias("members"))
    votes = inside.join(broadcast_if_small(best), "community_id").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("score") * F.col("members")), 6).alias("score"))
    return top_k(votes, k)


def doc_ranking(hits: DataFrame, depth: int = 30) -> DataFrame:
    """(query_id, doc_id, doc_rank): documents by their first hit, at most `depth`."""
    first = hits.groupBy("query_id", doc_of(F.col("chunk_id")).alias("doc_id")).agg(F.min("rank").alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return first.withColumn("doc_rank", rank).filter(F.col("doc_rank") <= depth).select("query_id", "doc_id", "doc_rank")


def depth_reached(hits: DataFrame, depth: int = 30, start: int = 120, most: int = 2000) -> DataFrame:
    """(query_id, documents, chunk_depth): the least of start, 2 start, 4 start, ... up to most at which `depth` documents are met."""
    first = hits.groupBy("query_id", doc_of(F.col("chunk_id")).alias("doc_id")).agg(F.min("rank").alias("first"))
    nr = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    need = first.withColumn("nr", nr).groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"), F.max(F.when(F.col("nr") == depth, F.col("first"))).alias("need"))
    step = F.when(F.col("need").isNull(), F.lit(most))
    size = start
    while size < most:
        step = step.when(F.col("need") <= size, F.lit(size))
        size *= 2
    return need.select("query_id", F.least("documents", F.lit(depth)).alias("documents"), step.otherwise(F.lit(most)).alias("chunk_depth"))


def excluding_index(chunks: DataFrame, excluded: DataFrame) -> DataFrame:
    """index_chunks without the excluded documents; raises where a document of them is in the chunks and yet the index keeps as many."""
    whole, kept = index_chunks(chunks), index_chunks(chunks, excluded)
    present = whole.join(excluded.select("doc_id").distinct(), "doc_id", "left_semi")
    if not present.isEmpty() and not kept.join(excluded.select("doc_id").distinct(), "doc_id", "left_semi").isEmpty():
        raise ValueError("documents to be excluded are still in the index")
    return kept
