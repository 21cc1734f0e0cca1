"""Problem 4: items that appear together more often than chance, by stripes.

Items get codes, hashes that are proven to be different. Each task folds its records into stripes, an
associative array of neighbours per item, and sends each stripe once, as two arrays. Arrays of
one item are merged by key, those of a hot item in parts by neighbour; pairs are then held
against the counts of their items by the log-likelihood ratio.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WHITE = r"\p{IsWhite_Space}+"
#: Records that hold an item from which its stripe is merged in parts, at least; the hot items are at most PARTED.
HOT, PARTED = 100_000, 10_000
STRIPE = "a long, part int, items array<long>, counts array<long>"


def clean_name(name: Column) -> Column:
    """Trimmed, white space runs as one blank, lower case; blank as null."""
    out = F.lower(F.trim(F.regexp_replace(name, WHITE, " ")))
    return F.when(out != "", out)


def folded(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs as one, in order of (a, b), with their counts added up."""
    by = np.lexsort((b, a))
    a, b, counts = a[by], b[by], counts[by]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    return a[first], b[first], np.add.reduceat(counts, first) if len(first) else counts


def _pairs(baskets: pa.Array):
    """All pairs of the items of each record, about a million at a time; the items of a record stand in order of their codes."""
    flat, sizes = baskets.flatten().to_numpy(), baskets.value_lengths().to_numpy().astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 1]).tolist():
        at = begins[sizes == size]
        for i in range(size - 1):  # the i-th item with those behind it
            rows = max(1, 1_000_000 // (size - 1 - i))
            for s in range(0, len(at), rows):
                here = at[s : s + rows]
                yield np.repeat(flat[here + i], size - 1 - i), flat[(here[:, None] + np.arange(i + 1, size)).ravel()]


def _stripes(cells: int, hot: dict[int, int]):
    """Folds the records of a task into stripes; sends them when they hold over `cells` neighbours, and at the end."""
    codes, parts = (np.array(x, np.int64) for x in (sorted(hot), [hot[c] for c in sorted(hot)]))

    def stripes(a, b, n):
        part = np.zeros(len(a), np.int32)
        if len(codes):
            at = np.minimum(np.searchsorted(codes, a), len(codes) - 1)
            part = np.where(codes[at] == a, b % parts[at], 0).astype(np.int32)
            by = np.lexsort((part, a))
            a, b, n, part = a[by], b[by], n[by], part[by]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])][: len(a)])
        off = pa.array(np.append(first, len(a)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(part[first]), pa.ListArray.from_arrays(off, pa.array(b)), pa.ListArray.from_arrays(off, pa.array(n))], ["a", "part", "items", "counts"])

    def fold(batches):
        held, loose, size = (np.zeros(0, np.int64),) * 3, [], 0
        for batch in batches:
            for a, b in _pairs(batch.column(0)):
                loose.append((a, b, np.ones(len(a), np.int64)))
                size += len(a)
                if size >= cells:
                    held, loose, size = folded(*(np.concatenate(x) for x in zip(held, *loose))), [], 0
                    if len(held[0]) >= cells:
                        yield stripes(*held)
                        held = (np.zeros(0, np.int64),) * 3
        held = folded(*(np.concatenate(x) for x in zip(held, *loose)))
        if len(held[0]):
            yield stripes(*held)

    return fold


def _merge(least: int):
    """Merges the arrays of each (a, part); the stripes come sorted by it. Only the last key of a batch waits for more."""
    def merged(a, b, n):
        a, b, n = folded(a, b, n)
        keep = n >= least
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, n)], ["ca", "cb", "n_ab"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(2).value_lengths().to_numpy()
            a, part = np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes)
            b, n = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            last = (a[-1], part[-1])
            open_ = int(np.argmax((a == last[0]) & (part == last[1])))
            if open_ or key != last:
                if held or open_:
                    yield merged(*(np.concatenate(x) for x in zip(*held, (a[:open_], b[:open_], n[:open_]))))
                held = []
            held, key = [folded(*(np.concatenate(x) for x in zip(*held, (a[open_:], b[open_:], n[open_:]))))], last
        if held:
            yield merged(*held[0])

    return run


def llr(n11: Column, na: Column, nb: Column, n: Column) -> Column:
    """Log-likelihood ratio of a 2 x 2 table of records."""
    def term(k: Column, row: Column, col: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(0.0)

    n11, na, nb, n = (c.cast("double") for c in (n11, na, nb, n))
    return 2 * (term(n11, na, nb) + term(na - n11, na, n - nb) + term(nb - n11, n - na, nb) + term(n - na - nb + n11, n - na, n - nb))


def together(records: DataFrame, id_col: str, items: Column, *, least: int = 1, cells: int = 2_000_000, hot: int = HOT) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n, lift, llr) of every pair with a < b by code point in at least `least` records.

    `items` is an array column of names, cleaned by clean_name; a record is all rows of one id and each
    name counts once in it. Null and blank names, null lists, rows with a null id and records without a name
    are left out. `cells` bounds what a task holds before it sends its stripes; the stripes of items of more than `hot`
    records are merged in parts.
    """
    named = records.select(F.col(id_col).alias("id"), F.filter(F.transform(items, clean_name), lambda x: x.isNotNull()).alias("names")).filter(F.col("id").isNotNull() & (F.size("names") > 0))
    baskets = named.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    baskets = materialize(baskets.select("names"), "baskets")
    counted = baskets.select(F.explode("names").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count"))
    seed = 0
    while True:  # a second round only where two items have one code
        code = lambda x: F.xxhash64(F.lit(seed), x)
        single = materialize(counted.withColumn("code", code(F.col("item"))), "items")
        sums = single.agg(F.count(F.lit(1)).alias("items"), F.count_distinct("code").alias("codes"), F.sum("count").alias("names")).first()
        if sums["items"] == sums.codes:
            break
        seed += 1
    total = baskets.agg(F.count(F.lit(1)).alias("n"))
    # at most PARTED items hold so many of all names
    many = max(hot, (sums.names or 0) // PARTED)
    parted = {r.code: r.parts for r in single.filter(F.col("count") > many).select("code", F.ceil(F.col("count") / many).cast("int").alias("parts")).collect()}
    coded = baskets.filter(F.size("names") > 1).select(F.array_sort(F.transform("names", code)).alias("codes"))
    stripes = coded.mapInArrow(_stripes(cells, parted), STRIPE)
    pairs = stripes.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(_merge(least), "ca long, cb long, n_ab long")
    side = lambda x: single.filter(F.col("count") >= least).select(F.col("code").alias(f"c{x}"), F.col("item").alias(x), F.col("count").alias(f"n_{x}"))
    out = pairs.join(side("a"), "ca").join(side("b"), "cb").crossJoin(F.broadcast(total))
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    out = out.select(pick("a", "b"), pick("b", "a"), "n_ab", pick("n_a", "n_b"), pick("n_b", "n_a"), "n")
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("a", "b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), llr(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")).alias("llr"))
