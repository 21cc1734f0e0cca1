"""Seams for models: answers come from a function over requests, or from a recorded table.

A chat function maps (system, user) to an answer text, an embedding function a list of texts to a list of
vectors. They run once per Arrow batch in the tasks; what is recorded is never asked again.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_object, tokens_upper_bound, window_for
from ..sources.files import cached, content_key


def prompts(requests: DataFrame, model: str, answer_tokens: int) -> DataFrame:
    """Requests (system, user) with the key of their answer, an upper bound of their tokens and the window they need."""
    need = tokens_upper_bound(F.col("system"), F.col("user"), answer_tokens)
    return requests.withColumns({"key": content_key(F.lit(model), F.col("system"), F.col("user"), F.lit(str(answer_tokens))), "tokens_bound": need, "window": window_for(need)})


def answer(requests: DataFrame, recorded: DataFrame, chat: Callable[[str, str, int], str], *, answer_tokens: int = 1024) -> DataFrame:
    """(key, answer, truncated, calls) of requests with a key. Answers that are no JSON object are asked for once
    more with twice the tokens; if that is none either, they are kept as truncated."""
    _, missing = cached(requests, recorded)
    ask = missing.dropDuplicates(["key"]).select("key", "system", "user")

    def call(limit: int):
        @F.arrow_udf("string")
        def told(system: pa.Array, user: pa.Array) -> pa.Array:
            return pa.array([chat(s, u, limit) for s, u in zip(system.to_pylist(), user.to_pylist())], pa.string())

        return told("system", "user")

    first = ask.withColumn("answer", call(answer_tokens)).withColumn("ok", parse_object(F.col("answer")).isNotNull())
    again = first.filter("not ok").select("key", "system", "user").withColumn("answer", call(2 * answer_tokens)).withColumn("ok", parse_object(F.col("answer")).isNotNull())
    fresh = first.filter("ok").select("key", "answer", F.lit(False).alias("truncated"), F.lit(1).alias("calls"))
    fresh = fresh.unionByName(again.select("key", "answer", (~F.col("ok")).alias("truncated"), F.lit(2).alias("calls")))
    old = recorded.dropDuplicates(["key"]).join(requests.select("key").distinct(), "key", "left_semi").select("key", "answer", "truncated", F.lit(0).alias("calls"))
    return old.unionByName(fresh)


def embed(texts: DataFrame, function: Callable[[list[str]], list[list[float]]], text_col: str = "text") -> DataFrame:
    """The texts with `vector`, one call of the function per batch; null texts have none."""
    @F.arrow_udf("array<float>")
    def vectors(column: pa.Array) -> pa.Array:
        rows = column.to_pylist()
        got = iter(function([t for t in rows if t is not None]))
        return pa.array([next(got) if t is not None else None for t in rows], pa.list_(pa.float32()))

    return texts.withColumn("vector", vectors(text_col))


def hashed_embedding(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An offline stand-in for an embedding model: signed counts of hashed words, normalised."""
    def function(texts: list[str]) -> list[list[float]]:
        import math
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x10000 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return function


def reports(tops: DataFrame, lines: DataFrame, recorded: DataFrame, resolution: float, model: str = "template") -> DataFrame:
    """(community_id, resolution, size, member_names, title, summary, truncated, cached): prose of the recorded report
    with the same members and relations, else a template; identity always from the live community."""
    members = tops.groupBy("community_id").agg(F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("member_names"))
    live = members.join(lines, "community_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    live = live.withColumn("key", content_key(F.lit(model), F.array_join("member_names", "\n"), F.array_join("lines", "\n")))
    prose = recorded.dropDuplicates(["key"]).select("key", F.col("title").alias("t"), F.col("summary").alias("s"), F.col("truncated").alias("cut"))
    got = live.join(prose, "key", "left")
    title = F.concat(F.lit("Community around "), F.get("member_names", F.lit(0)))
    summary = F.concat(F.lit("Members: "), F.array_join(F.slice("member_names", 1, 10), ", "), F.lit("."))
    return got.select("community_id", F.lit(resolution).alias("resolution"), "size", "member_names", F.coalesce("t", title).alias("title"), F.coalesce("s", summary).alias("summary"), F.coalesce("cut", F.lit(False)).alias("truncated"), F.col("t").isNotNull().alias("cached"))


def report_counts(made: DataFrame) -> DataFrame:
    """One row for each resolution: reports, those from the record, those made anew, truncated ones."""
    return made.groupBy("resolution").agg(F.count(F.lit(1)).alias("reports"), F.count_if("cached").alias("cached"), F.count_if(~F.col("cached")).alias("generated"), F.count_if("truncated").alias("truncated"))
