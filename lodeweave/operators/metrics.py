"""Ranking metrics over (query_id, doc_id, doc_rank) and (query_id, doc_id) relevance, with the sample-size gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_RELEVANT = 20


def per_item_hits(ranking: DataFrame, relevant: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each relevant document with its rank, null where it was missed."""
    return relevant.join(ranking, [*(by or ["query_id"]), "doc_id"], "left").select(*(by or ["query_id"]), "doc_id", "doc_rank")


def case_metrics(ranking: DataFrame, relevant: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, relevant, found, found_3k, recall, ceiling, ndcg) at k of every case (query_id); binary relevance.
    A case without relevant documents scores 0 throughout."""
    hits = per_item_hits(ranking, relevant)
    gain = F.when(F.col("doc_rank") <= k, 1 / F.log2(F.col("doc_rank") + 1.0)).otherwise(0.0)
    met = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.count_if(F.col("doc_rank") <= k).alias("found"), F.count_if(F.col("doc_rank") <= 3 * k).alias("found_3k"), F.sum(gain).alias("dcg"))
    case = cases.select("query_id").distinct().join(met, "query_id", "left").fillna(0, ["relevant", "found", "found_3k", "dcg"])
    n = F.least(F.col("relevant"), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    share = lambda x: F.round(F.coalesce(F.try_divide(x, F.col("relevant")), F.lit(0.0)), 6)
    return case.select("query_id", "relevant", "found", "found_3k", share(F.col("found")).alias("recall"), share(n).alias("ceiling"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def ladder(cases: DataFrame, by: str = "ranker", least: int = LEAST_RELEVANT) -> DataFrame:
    """One row per ranker: counts, and macro averages over all its cases, null where fewer than `least` relevant documents stand
    behind them. The share of the ceiling is averaged over the cases that have one. Averages are taken in decimals, so that a mean
    halfway between two last digits is rounded up whatever the order of the cases."""
    enough = F.sum("relevant") >= least
    exact = lambda c: F.round(F.avg(c.cast("decimal(20,12)")), 6).cast("double")
    rate = lambda c, name: F.when(enough, F.coalesce(exact(c), F.lit(0.0))).alias(name)
    share = F.when(F.col("ceiling") > 0, F.col("recall") / F.col("ceiling"))
    return cases.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), F.sum("relevant").alias("relevant"), F.sum("found").alias("found"), F.sum("found_3k").alias("found_3k"), rate(F.col("recall"), "recall"), rate(F.col("ceiling"), "ceiling"), rate(F.col("ndcg"), "ndcg"), rate(share, "share_of_ceiling"))
