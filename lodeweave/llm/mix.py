"""Problem 7: mix sources to target shares of the tokens by the cube method.

Each document of a source is wanted `rate` times, the same number for all. The whole part is given to
each; the fraction becomes an inclusion probability that the flight phase moves through the null-space
of two constraints (documents and tokens of the sample stay what they are expected to be) until at most
two fractions are left in a block. The leftovers of all blocks fly again, level by level, and the last
few are landed by trying all roundings. Blocks are tasks; a hot source has many of them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .vocab import TOKENIZER_DIR, encode, encoder

EPS = 1e-9
TRIM = r"(?U)^\s+|\s+$"


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move p to 0 or 1, three units at a time, keeping sum(p) and sum(p * size); two may stay fractional."""
    p = p.astype(float).copy()
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    active: list[int] = []
    draws = rng.random(2 * len(p) + 8)
    turn = 0
    for i in rng.permutation(np.flatnonzero((p > EPS) & (p < 1 - EPS))).tolist():
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            v = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if v[0] == v[1] == v[2] == 0:
                v = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(active, v) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(active, v) if x)
            step = up if draws[turn % len(draws)] * (up + down) < down else -down
            turn += 1
            for k, x in zip(active, v):
                p[k] = min(1.0, max(0.0, p[k] + step * x))
                if p[k] < EPS or p[k] > 1 - EPS:
                    p[k] = round(p[k])
            active = [k for k in active if 0 < p[k] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last few fractions so that tokens, then documents, stray least."""
    left = np.flatnonzero((p > 0) & (p < 1))
    best = min(itertools.product((0, 1), repeat=len(left)), key=lambda x: (abs(float(np.dot(np.array(x) - p[left], size[left]))), abs(sum(x) - p[left].sum())))
    p = p.copy()
    p[left] = best
    return p


def _count_udf(folder: str, name: str):
    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        enc = encoder(folder, name)
        return pa.array([len(encode(enc, t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return tokens


def _fly(last: bool, seed: int):
    def block(key, rows):
        rows = rows.sort_values(["id", "text_key"], kind="stable", na_position="first")
        p, size = rows["p"].to_numpy(float), rows["size"].to_numpy(float)
        p = flight(p, size, np.random.default_rng([seed, abs(hash_key(key))]))
        return rows.assign(p=land(p, size) if last else p)

    return block


def hash_key(key) -> int:
    """A number for a group's key that doesn't change from run to run."""
    out = 0
    for ch in "|".join(map(str, key)).encode():
        out = (out * 1099511628211 + ch) & 0x7FFFFFFF
    return out


def sized_documents(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, folder: str, tokenizer: str) -> DataFrame:
    """(id, text_key, source, size) of the documents of listed sources, each (id, text) once; sources are trimmed and lower-cased."""
    name = F.lower(F.regexp_replace(source_col, TRIM, ""))
    listed = broadcast_if_small(targets.select("source").distinct())
    kept = docs.select(F.col(id_col).alias("id"), name.alias("source"), F.col(text_col).alias("text")).join(listed, "source", "left_semi")
    return kept.select("id", F.xxhash64("text").alias("text_key"), "source", _count_udf(folder, tokenizer)("text").alias("size")).dropDuplicates(["id", "text_key", "source"])


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, block: int = 4096, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(uses, report). uses: (id, source, size, uses) of each document of a listed source, 0 included.

    report: one row per listed source with its target and the tokens `wanted`, target_share of the total that all
    listed documents have once; the tokens `used`; share_of_total, used over that total, and actual_share, used over
    all that was used, which is less where sources are short; and `short`, read off the sample: every document is in it
    max_uses times and the tokens used are still under those wanted. Null and unlisted sources are left out; null and
    empty texts have size 0; a source without documents is reported with 0 and is short if anything is wanted of it. Null or
    negative shares count as 0, null max_uses as 1. Of a source listed twice the larger share counts. Rows repeated with
    the same id and text are one document; rows with a null id are documents of their own, one per text.
    """
    goals = targets.select(F.lower(F.regexp_replace("source", TRIM, "")).alias("source"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_uses").cast("long"), F.lit(1)).alias("max_uses"))
    goals = goals.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_uses")).alias("g")).select("source", "g.*")
    sized = materialize(sized_documents(docs, goals, id_col, text_col, source_col, folder, tokenizer), "sizes")
    held = sized.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    total = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    plan = goals.join(held, "source", "left").crossJoin(F.broadcast(total)).fillna(0, ["tokens", "documents"])
    want = F.col("target_share") * F.col("total")
    plan = plan.withColumn("wanted", want)
    most_often = F.col("max_uses").cast("double")
    rate = F.when(want <= 0, 0.0).when(F.col("tokens") == 0, most_often).otherwise(F.least(want / F.greatest("tokens", F.lit(1)), most_often))
    plan = materialize(plan.withColumn("rate", rate).withColumn("blocks", F.ceil(F.col("documents") / block)), "plan")
    fields = "id " + sized.schema["id"].dataType.simpleString() + ", text_key long, source string, size long, p double"
    work = sized.join(broadcast_if_small(plan.select("source", "rate")), "source").select("id", "text_key", "source", "size", (F.col("rate") % 1).alias("p"))
    most = plan.agg(F.coalesce(F.max("documents"), F.lit(0))).first()[0]
    done, level = [], 0
    while True:
        last = most <= block
        blocks = max(1, -(-most // block))
        salt = F.pmod(F.xxhash64("id", "text_key", F.lit(level)), F.lit(blocks)) if not last else F.lit(0)
        flown = work.filter("p > 0 and p < 1").withColumn("b", salt).groupBy("source", "b").applyInPandas(_fly(last, seed + level), fields + ", b long")
        flown = materialize(flown.drop("b"), f"flight{level}")
        done.append(work.filter("p <= 0 or p >= 1"))
        if last:
            done.append(flown)
            break
        work, most, level = flown, 3 * blocks, level + 1
    picked = done[0]
    for part in done[1:]:
        picked = picked.unionByName(part)
    base = broadcast_if_small(plan.select("source", F.floor("rate").alias("base")))
    uses = picked.join(base, "source").select("id", "source", "size", (F.col("base") + F.col("p").cast("long")).alias("uses"))
    used = uses.groupBy("source").agg(F.sum(F.col("uses") * F.col("size")).alias("used"), F.sum("uses").alias("document_uses"), F.max("uses").alias("most_uses"), F.min("uses").alias("least_uses"))
    report = plan.drop("rate", "blocks").join(used, "source", "left").fillna(0, ["used", "document_uses", "most_uses"])
    spent = F.coalesce(F.col("least_uses") >= F.col("max_uses"), F.lit(True))
    report = report.withColumn("short", spent & (F.col("used") < F.col("wanted"))).withColumn("share_of_total", F.try_divide("used", "total")).drop("least_uses")
    everything = used.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("everything"))
    report = report.crossJoin(F.broadcast(everything)).withColumn("actual_share", F.try_divide("used", "everything")).drop("everything")
    return uses.withColumnRenamed("id", id_col), report
