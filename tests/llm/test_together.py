import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeweave.llm import queries
from lodeweave.llm.together import _merge, together

SCHEMA = "chunk_id string, entities array<struct<name:string,type:string>>, a string, n int, items string"


def frame(spark, rows):
    return spark.createDataFrame([(c, None if e is None else [(x, "t") for x in e], "z", 1, "q") for c, e in rows], SCHEMA)


def test_against_brute_force(spark):
    rows = [("r1", ["A", " b ", "B", None, ""]), ("r1", ["c"]), ("r2", ["a", "B  b", "b b", "C"]), ("r3", ["c", "a"]), ("r3", ["c", "a"]), ("r4", None), ("r5", []), ("r6", [None]), ("r7", ["solo"])]
    for i in range(40):
        rows.append((f"h{i}", ["hot", f"n{i % 5}", f"m{i % 3}"]))
    records = {}
    for c, e in rows:
        for x in e or []:
            name = " ".join((x or "").split()).lower()
            if name:
                records.setdefault(c, set()).add(name)
    one, two = Counter(), Counter()
    for v in records.values():
        one.update(v)
        two.update(combinations(sorted(v), 2))
    for least, cells, hot in ((1, 400_000, 100_000), (3, 7, 10)):
        got = {(r.a, r.b): r for r in together(frame(spark, rows), "chunk_id", F.col("entities.name"), least=least, cells=cells, hot=hot).collect()}
        assert {k: r.n_ab for k, r in got.items()} == {k: n for k, n in two.items() if n >= least}
        for (a, b), r in got.items():
            assert (r.n_a, r.n_b, r.n) == (one[a], one[b], len(records))
            k = [[r.n_ab, one[a] - r.n_ab], [one[b] - r.n_ab, len(records) - one[a] - one[b] + r.n_ab]]
            rows_, cols = [sum(x) for x in k], [sum(x) for x in zip(*k)]
            want = 2 * sum(k[i][j] * math.log(k[i][j] * r.n / (rows_[i] * cols[j])) for i in (0, 1) for j in (0, 1) if k[i][j])
            assert abs(r.llr - want) < 1e-6


def test_rows_without_an_id_are_no_record(spark):
    rows = [(None, ["a", "b"]), (None, ["c"]), ("r", ["a", "b"])]
    got = together(frame(spark, rows), "chunk_id", F.col("entities.name")).collect()
    assert [(r.a, r.b, r.n_ab, r.n) for r in got] == [("a", "b", 1, 1)]


def test_arrays_of_a_key_are_merged_over_batches():
    rng = np.random.default_rng(2)
    want = Counter()
    batches = []
    for a, part in sorted({(int(x), int(y)) for x, y in rng.integers(0, 5, (40, 2))}):
        for _ in range(rng.integers(1, 4)):
            items = rng.choice(20, rng.integers(1, 6), replace=False)
            counts = rng.integers(1, 4, len(items))
            want.update({(a, int(b)): int(n) for b, n in zip(items, counts) if b % 5 == part})
            keep = items % 5 == part
            batches.append(([a], [part], [items[keep].tolist()], [counts[keep].tolist()]))
    parts = [pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int32()), pa.array(i, pa.list_(pa.int64())), pa.array(c, pa.list_(pa.int64()))], ["a", "part", "items", "counts"]) for a, p, i, c in batches if i[0]]
    got = [tuple(r.values()) for b in _merge(2)(iter(parts)) for r in b.to_pylist()]
    assert {(a, b): n for a, b, n in got} == {k: n for k, n in want.items() if n >= 2} and len(got) == len(set((a, b) for a, b, _ in got))


def test_empty_table(spark):
    assert together(frame(spark, []), "chunk_id", F.col("entities.name")).count() == 0


def test_query_gives_every_pair(spark, tmp_path):
    rows = [("r1", ["a", "b"]), *[(f"h{i}", ["c", "d"]) for i in range(8)], *[(f"z{i}", [f"e{i}"]) for i in range(90)]]
    frame(spark, rows).write.parquet(f"{tmp_path}/chunk_extractions.parquet")
    got = {(r.a, r.b): (r.n_ab, r.lift) for r in queries.QUERIES["p4_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (1, 99.0), ("c", "d"): (8, 99 / 8)}
    assert [tuple(r) for r in queries.QUERIES["p4_found"](spark, str(tmp_path)).collect()] == [("c", "d")]
