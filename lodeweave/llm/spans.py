"""Problem 5: long exact spans shared between records, by fixed-block anchors.

Strings are cut into blocks of half the wanted length that don't overlap; any shared span of that length
holds a whole block of either string. Every rolling window probes the blocks by hash, and blocks that stand
in no other string are put aside. Around the blocks that are left hits are extended by the windows of the whole length,
which meet exactly where a span is shared; consecutive ones are a maximal repeat. A block that stands
in a million strings so costs a million rows, not their pairs.

Only windows whose hash may be that of a block leave their task: the blocks' hashes are held in a bitmap of
bounded size, which every task gets. Where it fills up more windows pass it; the result stays the same.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Code points that are hashed at once.
STEP = 1 << 19
#: Bits of a bitmap: at least, at most, and for each block.
BITS_LEAST, BITS_MOST, BITS_EACH = 1 << 16, 1 << 28, 32
#: Bytes of a bitmap that travel as one row.
PAGE = 1 << 16
#: Records of a class that are paired in one piece.
BLOCK = 512
#: Factors of the two independent hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def rolling(points: np.ndarray, width: int, factor: int = FACTORS[0]) -> np.ndarray:
    """A 64-bit hash of every window of `width` code points."""
    part, size = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    out, done = None, 0
    left = width
    with np.errstate(over="ignore"):
        while left:  # by the binary digits of width, from the lowest
            if left & 1:
                if out is None:
                    out, done = part, size
                else:
                    n = len(points) - done - size + 1
                    out = out[:n] * np.uint64(pow(factor, size, 1 << 64)) + part[done : done + n]
                    done += size
            left >>= 1
            if left:
                part = part[:-size] * np.uint64(pow(factor, size, 1 << 64)) + part[size:]
                size *= 2
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def pieces(strings: list[str], block: int, least: int, step: int = STEP):
    """(points, row, pos, room, own) of strings put together, about `step` code points at a time.

    For each point: its string, its place there, how many points follow up to the end of the piece, itself
    included, and whether a window that starts here is counted in this piece. Long strings are cut into
    several pieces, which overlap by more than a window and a block.
    """
    step -= step % block
    held: list[tuple[int, int, str]] = []

    def pack():
        size = np.array([len(s) for _, _, s in held])
        points = np.frombuffer("".join(s for _, _, s in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        local = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
        return points, np.repeat([r for r, _, _ in held], size), local + np.repeat([o for _, o, _ in held], size), np.repeat(size, size) - local, local < step

    n = 0
    for row, s in enumerate(strings):
        for o in range(0, max(1, len(s)), step):
            held.append((row, o, s[o : o + step + least + block]))
            n += len(held[-1][2])
            if n >= step:
                yield pack()
                held, n = [], 0
    if held:
        yield pack()


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def passes(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap."""
    one, two = ((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in _probes(h, 8 * len(marks)))
    return (one & two).astype(bool)


def _pages(hashes, bits: int):
    """Marks the hashes of a task's batches in one bitmap and sends its pages."""
    def run(batches):
        marks = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for h in hashes(batch):
                for at in _probes(h, bits):
                    np.bitwise_or.at(marks, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        page = min(PAGE, len(marks))
        some = np.flatnonzero(marks.reshape(-1, page).any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([marks[i * page : (i + 1) * page].tobytes() for i in some], pa.binary())], ["page", "marks"])

    return run


def _bitmap(df: DataFrame, hashes, bits: int):
    """The bitmap of the hashes of all rows, as a broadcast variable: pages are merged in tasks, bits / 8 bytes reach the driver."""
    def merged(key, group):
        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("marks").to_pylist()])
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([out.tobytes()], pa.binary())})

    got = df.mapInArrow(_pages(hashes, bits), "page int, marks binary").groupBy("page").applyInArrow(merged, "page int, marks binary").toArrow()
    marks, page = np.zeros(bits // 8, np.uint8), min(PAGE, bits // 8)
    for i, x in zip(*(c.to_pylist() for c in got.columns)):
        marks[i * page : (i + 1) * page] = np.frombuffer(x, np.uint8)
    return df.sparkSession.sparkContext.broadcast(marks)


def _heads(block: int, least: int):
    """(n, s) batches to the hashes of the blocks."""
    def hashes(batch):
        for points, _, pos, room, own in pieces(batch.column(1).to_pylist(), block, least):
            if len(points) >= block:
                yield rolling(points, block)[np.flatnonzero((pos % block == 0) & (room >= block) & own)]

    return hashes


def _hits(block: int, least: int, blocks):
    """(n, s) to (h, n, head): the blocks of every string, and its windows that may be blocks, each hash once a piece."""
    def run(batches):
        marks = blocks.value
        for batch in batches:
            names = batch.column(0).to_numpy()
            for points, row, pos, room, own in pieces(batch.column(1).to_pylist(), block, least):
                if len(points) < block:
                    continue
                h = rolling(points, block)
                at = np.flatnonzero((room >= block)[: len(h)] & own[: len(h)])
                at = at[passes(marks, h[at])]
                head = pos[at] % block == 0
                by = np.lexsort((~head, h[at], row[at]))
                at, head = at[by], head[by]
                fresh = np.r_[True, (row[at][1:] != row[at][:-1]) | (h[at][1:] != h[at][:-1])][: len(at)]
                at, head = at[fresh], head[fresh]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(names[row[at]]), pa.array(head)], ["h", "n", "head"])

    return run


def _grams(block: int, least: int, shared):
    """(n, s, lo, hi) to (g, g2, n, pos, fresh, lo, hi): the windows of the whole length in which every block may stand in another
    string; fresh marks the first place of each in its string."""
    def run(batches):
        marks = shared.value
        for batch in batches:
            found = []
            for points, row, pos, room, own in pieces(batch.column(1).to_pylist(), block, least):
                if len(points) < least:
                    continue
                h, bad = rolling(points, block), np.zeros(len(points), np.int64)
                heads = np.flatnonzero((pos % block == 0) & (room >= block))
                bad[heads] = ~passes(marks, h[heads])
                count = np.r_[0, np.cumsum(bad)]
                at = np.flatnonzero((room >= least) & own)
                at = at[count[at + least - block + 1] == count[at]]
                if len(at):
                    found.append((row[at], pos[at], *(rolling(points, least, f)[at] for f in FACTORS)))
            if not found:
                continue
            row, pos, g, g2 = (np.concatenate(x) for x in zip(*found))
            by = np.lexsort((pos, g2, g, row))
            row, pos, g, g2 = row[by], pos[by], g[by], g2[by]
            fresh = np.r_[True, (row[1:] != row[:-1]) | (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(g2.view(np.int64)), batch.column(0).take(take), pa.array(pos.astype(np.int32)), pa.array(fresh), batch.column(2).take(take), batch.column(3).take(take)], ["g", "g2", "n", "pos", "fresh", "lo", "hi"])

    return run


def _runs(least: int):
    @F.arrow_udf("array<struct<start:int,length:int,c1:bigint,c2:bigint>>")
    def runs(places: pa.Array) -> pa.Array:
        """Consecutive windows of one class as one stretch."""
        flat = places.flatten()
        row = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy())
        pos, c1, c2 = (flat.field(k).to_numpy() for k in range(3))
        by = np.lexsort((pos, row))
        row, pos, c1, c2 = row[by], pos[by], c1[by], c2[by]
        new = np.r_[True, (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])][: len(row)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(row)][: len(first)] - 1
        made = pa.StructArray.from_arrays([pa.array(x) for x in (pos[first].astype(np.int32), (pos[last] - pos[first] + least).astype(np.int32), c1[first], c2[first])], ["start", "length", "c1", "c2"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(places) + 1)).astype(np.int32)), made)

    return runs


class Shared(NamedTuple):
    """strings: (n, s, lo, hi, rep) of every different field of at least `least` code points, lo and hi its least and greatest
    record, rep its least (id, field); holders: (n, id, field, length); runs: (n, runs) with the stretches of a string
    (start, length, c1, c2) that strings of other records hold, of which (c1, c2) names the set."""

    strings: DataFrame
    holders: DataFrame
    runs: DataFrame


def shared_stretches(records: DataFrame, id_col: str, fields: list[str], *, least: int = 60) -> Shared:
    """The stretches of `least` or more consecutive code points that different records share within one field each.

    A stretch ends where the set of strings that hold its windows changes, so it is a maximal exact repeat of that set.
    Null ids, null and shorter fields share nothing; repeated rows change nothing; other columns are left out.
    Windows of the whole length are compared by two independent hashes, 128 bits together.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("s")) for f in fields])).alias("x")
    rows = records.select(F.col(id_col).alias("id"), each).select("id", "x.field", "x.s").filter(F.col("id").isNotNull() & (F.length("s") >= least))
    keyed = rows.select(F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2"), "s", "id", "field")
    once = keyed.groupBy("k1", "k2").agg(F.first("s").alias("s"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(F.struct("id", "field")).alias("rep"))
    strings = materialize(once.withColumn("n", F.monotonically_increasing_id()), "strings")
    holders = keyed.drop("s").join(strings.select("k1", "k2", "n", F.length("s").alias("length")), ["k1", "k2"]).select("n", "id", "field", "length").distinct()

    block = (least + 1) // 2
    kind = strings.schema["lo"].dataType.simpleString()
    text = strings.select("n", "s", "lo", "hi")
    size = strings.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0] // block
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (BITS_EACH * size).bit_length()))
    blocks = _bitmap(text, _heads(block, least), bits)
    hits = text.select("n", "s").mapInArrow(_hits(block, least, blocks), "h long, n long, head boolean")
    met = hits.groupBy("h").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.max("head").alias("head")).filter("first < last and head")
    shared = _bitmap(met.select("h"), lambda batch: [batch.column(0).to_numpy().view(np.uint64)], bits)
    grams = text.mapInArrow(_grams(block, least, shared), f"g long, g2 long, n long, pos int, fresh boolean, lo {kind}, hi {kind}")
    grams = materialize(grams, "grams")
    name = lambda seed: F.bit_xor(F.when(F.col("fresh"), F.xxhash64(F.lit(seed), "n")))
    sets = grams.groupBy("g", "g2").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), name(1).alias("c1"), name(2).alias("c2"))
    sets = sets.filter("first < last and lo < hi").select("g", "g2", "c1", "c2")
    places = grams.select("g", "g2", "n", "pos").join(sets, ["g", "g2"]).groupBy("n").agg(F.collect_list(F.struct("pos", "c1", "c2")).alias("places"))
    return Shared(strings, holders, materialize(places.select("n", _runs(least)("places").alias("runs")), "runs"))


def record_pairs(found: Shared) -> DataFrame:
    """(a, b), a < b: each pair of records that share a stretch, once.

    Records are gathered by class, the set of strings that hold a window; a class is paired in blocks, so that a
    large one is spread over many tasks.
    """
    sets = found.runs.select("n", F.explode("runs").alias("r")).select("r.c1", "r.c2", "n").distinct()
    ids = found.holders.select("n", "id").distinct()
    many = found.strings.filter("lo < hi").select(F.col("n").alias("c1"), F.lit(None).cast("long").alias("c2"), "n")
    members = sets.unionByName(many).join(ids, "n").select(F.xxhash64("c1", F.coalesce("c2", F.lit(0))).alias("k1"), F.xxhash64(F.lit(1), "c1", F.coalesce("c2", F.lit(0))).alias("k2"), "id").distinct()
    members = materialize(members, "members")
    parts = members.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("k1", "k2", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    blocks = members.join(parts, ["k1", "k2"]).groupBy("k1", "k2", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("x")).agg(F.collect_list("id").alias("xs"))
    # every block goes to the pairs of blocks it is part of
    at = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sent = blocks.withColumn("y", at).select("k1", "k2", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "xs")
    side = lambda c: F.flatten(F.collect_list(F.when(F.col("x") == F.col(c), F.col("xs"))))
    met = sent.groupBy("k1", "k2", "i", "j").agg(side("i").alias("as"), side("j").alias("bs"))
    both = met.select("i", "j", F.explode("as").alias("a"), "bs").select("i", "j", "a", F.explode("bs").alias("b")).filter("i < j or a < b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def span_classes(found: Shared) -> tuple[DataFrame, DataFrame]:
    """(spans, members) with each class of equal fields told once, by its least holder.

    spans: (stretch, rep_id, rep_field, start, length): every stretch with each class that holds it; stretch is the hash of its text.
    members: (rep_id, rep_field, id, field, length) for every field of a string that shares a stretch with another
    record; a class of several records is itself a shared stretch, the whole string.
    """
    texts = found.runs.join(found.strings, "n")
    cut = texts.select("s", "rep", F.explode("runs").alias("r"))
    spans = cut.select(F.substring(F.sha2(F.substring("s", F.col("r.start") + 1, F.col("r.length")), 256), 1, 32).alias("stretch"), F.col("rep.id").alias("rep_id"), F.col("rep.field").alias("rep_field"), "r.start", "r.length")
    held = found.strings.join(found.runs.select("n", F.lit(True).alias("in")), "n", "left").filter("in or lo < hi").select("n", "rep")
    members = found.holders.join(held, "n").select(F.col("rep.id").alias("rep_id"), F.col("rep.field").alias("rep_field"), "id", "field", "length")
    return spans, members


def portions(found: Shared) -> DataFrame:
    """(id, field, length, shared) for every field of at least `least` code points: how many of its code points stand in a
    stretch that some other record holds, too."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    stop = lambda r: r["start"] + r["length"]
    union: Column = F.aggregate("runs", zero, lambda acc, r: F.struct((acc["sum"] + F.greatest(stop(r) - F.greatest(acc["end"], r["start"]), F.lit(0))).alias("sum"), F.greatest(acc["end"], stop(r)).alias("end")), lambda acc: acc["sum"])
    covered = found.strings.select("n", (F.col("lo") < F.col("hi")).alias("many")).join(found.runs.select("n", union.alias("sum")), "n", "left")
    rows = found.holders.join(covered, "n")
    return rows.select("id", "field", "length", F.when(F.col("many"), F.col("length")).otherwise(F.coalesce("sum", F.lit(0))).alias("shared"))


def short_fields(records: DataFrame, id_col: str, fields: list[str], least: int) -> DataFrame:
    """(id, field, length, shared) of the fields of fewer than `least` code points, which share nothing; null ids and fields left out."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.length(F.col(f).cast("string")).alias("length")) for f in fields])).alias("x")
    rows = records.select(F.col(id_col).alias("id"), each).select("id", "x.field", "x.length").filter(F.col("id").isNotNull() & (F.col("length") < least))
    return rows.distinct().withColumn("shared", F.lit(0))
