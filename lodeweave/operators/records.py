"""Aggregates over review records: grounding, verdicts, conflicts, call accounting, budgets, planted-error scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import asserting, names_token, own_prose, squeeze
from .match import holding

SUPPORTS, REFUTES, OPEN = "SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO"


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the latest by `order`, a null before all others, of equal ones that with the greatest hash; rows without a key are dropped."""
    every = F.struct(*[F.col(c) for c in records.columns])
    last = F.struct(F.col(order), F.xxhash64(*[F.col(c) for c in records.columns]))
    return records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(every, last).alias("r")).select("r.*")


def clamp_score(score: Column) -> Column:
    """1 to 5; null where it is no number."""
    number = score.cast("string").try_cast("int")
    return F.when(number.isNotNull(), F.greatest(F.least(number, F.lit(5)), F.lit(1)))


def finding_hygiene(findings: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """(run_id, reviewer, finding_id, evidence, dropped_ids, score): of each reviewer the first `most` findings with a text,
    evidence restricted to known chunk ids, the others counted, the score from 1 to 5 (null without a column of that name,
    or where it is no number). known: (chunk_id)."""
    order = Window.partitionBy("run_id", "reviewer").orderBy("created_at", "finding_id")
    kept = findings.filter(F.col("text").rlike(r"(?U)\S")).withColumn("nr", F.row_number().over(order)).filter(F.col("nr") <= most)
    ids = kept.select("finding_id", F.explode("evidence_chunk_ids").alias("chunk_id")).distinct()
    good = ids.join(known.select("chunk_id"), "chunk_id", "left_semi").groupBy("finding_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("evidence"))
    score = clamp_score(F.col("score")) if "score" in findings.columns else F.lit(None).cast("int")
    out = kept.select("run_id", "reviewer", "finding_id", score.alias("score"), F.size(F.array_distinct(F.coalesce("evidence_chunk_ids", F.array().cast("array<string>")))).alias("named")).join(good, "finding_id", "left")
    evidence = F.coalesce("evidence", F.array().cast("array<string>"))
    return out.select("run_id", "reviewer", "finding_id", evidence.alias("evidence"), (F.col("named") - F.size(evidence)).alias("dropped_ids"), "score")


def grounding(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """(finding_id, named, known, grounded): chunks a finding names, those that exist, those that hold its quote.

    Quote and text are compared with white space squeezed; blank quotes are grounded nowhere.
    """
    ids = findings.select("finding_id", "quote", F.explode_outer(F.array_distinct("evidence_chunk_ids")).alias("chunk_id"))
    joined = ids.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id", "left")
    quote = squeeze(F.col("quote"))
    held = (quote != "") & F.contains(squeeze(F.col("chunk_text")), quote)
    return joined.groupBy("finding_id").agg(F.count("chunk_id").alias("named"), F.count("chunk_text").alias("known"), F.count_if(held).alias("grounded"))


def swap_verdicts(judgements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, verdict, spans, swapped, swap_consistent) of every claim of evidence (claim_id, chunk_ids in the order given)
    from judgements (claim_id, ord 0/1, verdict, spans array<struct<chunk_id, quote>>).

    Orders that agree keep the verdict and the spans of both; that disagree give NOT_ENOUGH_INFO and the spans of chunks both
    cite. A verdict that is none, or lacks, is NOT_ENOUGH_INFO without spans. Spans come once each, in the order of the
    evidence, then of the judgements. A claim without evidence isn't judged: it stays open, not swapped, and consistent.
    """
    none = F.array().cast("array<struct<chunk_id:string,quote:string>>")
    side = lambda n, c: F.first(F.when(F.col("ord") == n, F.col(c)), ignorenulls=True)
    both = judgements.groupBy("claim_id").agg(side(0, "verdict").alias("v0"), side(1, "verdict").alias("v1"), side(0, "spans").alias("s0"), side(1, "spans").alias("s1"))
    rows = evidence.select("claim_id", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("order")).join(both, "claim_id", "left")
    told = lambda v: F.coalesce(F.col(v).isin(SUPPORTS, REFUTES, OPEN), F.lit(False))
    rows = rows.select("claim_id", "order", *[F.when(told(f"v{n}"), F.col(f"v{n}")).otherwise(OPEN).alias(f"v{n}") for n in (0, 1)], *[F.when(told(f"v{n}"), F.coalesce(f"s{n}", none)).otherwise(none).alias(f"s{n}") for n in (0, 1)])
    swapped, same = F.size("order") > 0, F.col("v0") == F.col("v1")
    cites = lambda s: F.transform(s, lambda x: x["chunk_id"])
    shared = F.array_intersect(cites("s0"), cites("s1"))
    kept = F.array_distinct(F.filter(F.concat("s0", "s1"), lambda x: same | F.array_contains(shared, x["chunk_id"])))
    place = lambda x: F.coalesce(F.nullif(F.array_position("order", x["chunk_id"]), F.lit(0)), F.size("order") + 1)
    ranked = F.array_sort(F.transform(kept, lambda x, i: F.struct(place(x).alias("place"), i.alias("i"), x.alias("span"))))
    spans = F.when(swapped, F.transform(ranked, lambda x: x["span"])).otherwise(none)
    return rows.select("claim_id", F.when(swapped & same, F.col("v0")).otherwise(OPEN).alias("verdict"), spans.alias("spans"), swapped.alias("swapped"), (~swapped | same).alias("swap_consistent"))


def consistency(verdicts: DataFrame, source: str = "source", least: int = 10) -> DataFrame:
    """(source, n, rate) for each source and, with null, overall; only swapped rows count, rates of fewer than `least` are null."""
    view = verdicts.filter("swapped").select(F.col(source).alias("source"), F.col("swap_consistent").cast("int").alias("c"))
    out = view.groupingSets([["source"], []], "source").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("rate"), F.grouping_id().alias("g"))
    return out.select("source", "n", F.round(F.when(F.col("n") >= least, F.col("rate")), 6).alias("rate"), (F.col("g") == 1).alias("overall"))


def score_conflicts(scores: DataFrame, gap: int = 2) -> DataFrame:
    """(run_id, dimension, reviewers, lowest, highest) where two or more reviewers' scores lie `gap` or more apart."""
    each = scores.filter("score IS NOT NULL").groupBy("run_id", "dimension", "reviewer").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    out = each.groupBy("run_id", "dimension").agg(F.count(F.lit(1)).alias("reviewers"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"))
    return out.filter((F.col("reviewers") >= 2) & (F.col("highest") - F.col("lowest") >= gap))


def ledger(calls: DataFrame, by: str = "run_id") -> DataFrame:
    """Call accounting: counts, the largest prompt, the smallest window and headroom of a call, distinct sources sorted.

    calls: (by, prompt_tokens, answer_tokens, context, source); calls without a known context have no headroom.
    """
    headroom = F.col("context") - F.col("prompt_tokens")
    return calls.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("answer_tokens").alias("answer_tokens"), F.max("prompt_tokens").alias("largest_prompt"), F.min("context").alias("smallest_context"), F.min(headroom).alias("smallest_headroom"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def within_budget(samples: DataFrame, by: str, order: list[str], cost: str, budget: int, most: int = 12) -> DataFrame:
    """The samples that are drawn while less than the budget is spent, at most `most` per group, with what was spent before."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return samples.withColumns({"spent_before": before, "nr": F.row_number().over(w)}).filter((F.col("spent_before") < budget) & (F.col("nr") <= most))


def planted_scores(errors: DataFrame, findings: DataFrame) -> DataFrame:
    """(arm, source, error_id, named, detected): whether a finding of an arm names the planted token and whether one asserts it, for
    every arm of a source and every error of it.

    errors: (source, error_id, token, manuscript); findings: (source, arm, text). Sentences copied from the
    manuscript are taken out first, once for each finding. Errors are few; each finding meets those of its own source.
    """
    errors = errors.withColumn("m", F.xxhash64("manuscript"))
    own = findings.join(errors.select("source", "m", "manuscript").dropDuplicates(["source", "m"]), "source").select("arm", "source", "m", own_prose(F.col("text"), F.col("manuscript")).alias("prose"))
    told = own.withColumn("told", asserting(F.col("prose"))).join(errors.select("source", "m", "error_id", "token"), ["source", "m"])
    hit = lambda c: F.coalesce(F.max(c), F.lit(False))
    detected = F.exists("told", lambda s: names_token(s, F.col("token")))
    return told.groupBy("arm", "source", "error_id").agg(hit(names_token(F.col("prose"), F.col("token"))).alias("named"), hit(detected).alias("detected"))


def arm_results(scores: DataFrame, spent: DataFrame, reference_arm: str) -> DataFrame:
    """(arm, source, detected, named, missed, tokens, budget_share): error ids of planted_scores by outcome, sorted; tokens of
    spent (arm, source, tokens) and their share of what the reference arm spent on the source, null where it spent nothing."""
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("error_id"))))
    told = scores.groupBy("arm", "source").agg(ids(F.col("detected")).alias("detected"), ids(F.col("named")).alias("named"), ids(~F.col("detected")).alias("missed"))
    used = spent.groupBy("arm", "source").agg(F.sum("tokens").alias("tokens"))
    base = used.filter(F.col("arm") == reference_arm).select("source", F.col("tokens").alias("base"))
    out = told.join(used, ["arm", "source"], "left").join(base, "source", "left")
    return out.select("arm", "source", "detected", "named", "missed", "tokens", F.round(F.try_divide("tokens", "base"), 6).alias("budget_share"))


def pooled_findings(samples: DataFrame) -> DataFrame:
    """(source, arm, text, samples): the findings of all samples of an arm, each text once, with how many samples gave it."""
    return samples.filter("text is not null").groupBy("source", "arm", "text").agg(F.count_distinct("sample").alias("samples"))


def token_collisions(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(token, documents): in how many documents a token stands, upper and lower case alike; all are looked for in one pass over each text."""
    each = tokens.select("token", F.lower("token").alias("word")).distinct()
    hit = holding(texts.select("doc_id", F.lower("text").alias("text")), "text", each, "word").select("word", "doc_id").distinct()
    return each.join(hit.groupBy("word").agg(F.count(F.lit(1)).alias("documents")), "word", "left").fillna(0, ["documents"]).select("token", "documents")
