"""Review runs as data: query cases, claims with ids, evidence order, the record of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_words, lines, sentences, short_hash, squeeze
from . import records
from .rank import bm25_plus

#: A line that opens the part on methods.
METHODS_HEADING = r"(?iU)^\s*(?:(?:materials\s+and\s+)?methods|experimental)"
#: Asked of every manuscript beside its own queries.
FIXED_QUERY = "statistical analysis quantification replication controls"
# Where a recorded window size came from, by the provider's first part.
WINDOW_SOURCES = {"native": "requested", "openai": "loaded", "anthropic": "fixed"}


def methods_lead(text: Column, words: int = 60) -> Column:
    """The first words from the methods heading on, the heading included; null where there is none."""
    at = lines(text)
    place = F.array_position(F.transform(at, lambda x: x.rlike(METHODS_HEADING)), True)
    rest = squeeze(F.array_join(F.slice(at, place, F.size(at)), " "))
    return F.when(place > 0, first_words(rest, words))


def derived_queries(manuscripts: DataFrame) -> DataFrame:
    """(preprint_doi, nr, query) of manuscripts (preprint_doi, title, body): the title, the methods lead where there is one, the fixed query."""
    asked = F.array_compact(F.array(F.col("title"), methods_lead(F.col("body")), F.lit(FIXED_QUERY)))
    return manuscripts.select("preprint_doi", F.posexplode(asked).alias("nr", "query"))


def query_cases(manuscripts: DataFrame, twins: DataFrame, cited: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, skipped) of manuscripts (preprint_doi, title, body) for relevance cited (preprint_doi, doc_id).

    A case keeps its title as query, the documents cited and stored but not excluded, and its own twins as
    excluded; manuscripts whose twin isn't stored are skipped, since their exclusion would exclude nothing.
    """
    own = twins.join(stored.select(F.col("doc_id").alias("pmcid")).distinct(), "pmcid", "left_semi").groupBy("preprint_doi").agg(F.array_sort(F.collect_set("pmcid")).alias("excluded_docs"))
    near = cited.join(stored.select("doc_id").distinct(), "doc_id", "left_semi").join(twins.select("preprint_doi", F.col("pmcid").alias("doc_id")), ["preprint_doi", "doc_id"], "left_anti")
    near = near.groupBy("preprint_doi").agg(F.array_sort(F.collect_set("doc_id")).alias("relevant_docs"))
    cases = manuscripts.join(own, "preprint_doi").join(near, "preprint_doi", "left")
    none = F.array().cast("array<string>")
    cases = cases.select("preprint_doi", F.col("title").alias("query"), methods_lead(F.col("body")).alias("methods_query"), F.coalesce("relevant_docs", none).alias("relevant_docs"), "excluded_docs")
    return cases, manuscripts.join(own, "preprint_doi", "left_anti").select("preprint_doi", F.lit("its twin isn't stored").alias("reason"))


def claims(texts: DataFrame, source: str, most: int | None = None) -> DataFrame:
    """(claim_id, source, text): the distinct sentences of texts (id, position, text), upper and lower case alike, in
    order; with `most` only the first so many of each id. Ids are source:number:hash of the text."""
    each = texts.select("id", "position", F.posexplode(sentences(F.col("text"))).alias("at", "s")).withColumn("s", squeeze(F.col("s"))).filter("s <> ''")
    key = F.regexp_replace(F.lower("s"), "ß", "ss")
    first = each.withColumn("nr", F.row_number().over(Window.partitionBy("id", key).orderBy("position", "at"))).filter("nr = 1")
    kept = first.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("position", "at")) - 1)
    if most is not None:
        kept = kept.filter(F.col("i") < most)
    return kept.select("id", F.concat_ws(":", F.lit(source), F.col("i").cast("string"), short_hash(F.col("s"))).alias("claim_id"), F.lit(source).alias("source"), F.col("s").alias("text"))


def claim_source(claim_id: Column) -> Column:
    return F.split_part(claim_id, F.lit(":"), F.lit(1))


def both_orders(evidence: DataFrame) -> DataFrame:
    """(claim_id, ord, chunk_ids): a claim's evidence (claim_id, rank, chunk_id) forwards and backwards."""
    listed = evidence.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    return listed.select("claim_id", F.posexplode(F.array(F.col("ids"), F.reverse("ids"))).alias("ord", "chunk_ids"))


def answer_prompts(queries: DataFrame, reports: DataFrame, excluded: DataFrame, top: int = 4) -> DataFrame:
    """(query_id, prompt) over the best reports; refused while any document is excluded, since reports are of the whole corpus."""
    if not excluded.isEmpty():
        raise ValueError("reports describe the whole corpus: no answers while documents are excluded")
    best = bm25_plus(reports, queries, top).join(reports, "community_id")
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "community_id", "text"))), lambda x: F.concat(F.lit("["), x["community_id"].cast("string"), F.lit("] "), x["text"])), "\n")
    return best.groupBy("query_id").agg(block.alias("reports")).join(queries, "query_id").select("query_id", F.concat(F.lit("Question: "), "text", F.lit("\n"), "reports").alias("prompt"))


def cited_ids(answer: Column, ids: Column) -> Column:
    """Which of the ids an answer names, in their order."""
    return F.filter(ids, lambda i: F.contains(answer, F.concat(F.lit("["), i, F.lit("]"))))


def window_sources(calls: DataFrame) -> DataFrame:
    """Calls with where their window size came from, by the provider's name before the colon; null for an unknown one."""
    known = F.create_map(*[F.lit(x) for kv in WINDOW_SOURCES.items() for x in kv])
    return calls.withColumn("window_source", F.element_at(known, F.split_part("provider", F.lit(":"), F.lit(1))))


def run_records(findings: DataFrame, chunks: DataFrame, scores: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, findings, dropped_ids, grounded, conflicts, calls, prompt_tokens, largest_prompt): one row per run."""
    kept = records.finding_hygiene(findings, chunks).groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"), F.sum("dropped_ids").alias("dropped_ids"))
    held = findings.select("finding_id", "run_id").join(records.grounding(findings, chunks), "finding_id").groupBy("run_id").agg(F.count_if(F.col("grounded") > 0).alias("grounded"))
    torn = records.score_conflicts(scores).groupBy("run_id").agg(F.count(F.lit(1)).alias("conflicts"))
    spent = records.ledger(calls).select("run_id", "calls", "prompt_tokens", "largest_prompt")
    return spent.join(kept, "run_id", "left").join(held, "run_id", "left").join(torn, "run_id", "left").fillna(0, ["findings", "dropped_ids", "grounded", "conflicts"]).select("run_id", "findings", "dropped_ids", "grounded", "conflicts", "calls", "prompt_tokens", "largest_prompt")
