"""Which texts hold which words: all words are looked for in one pass over each text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that go to every task at a time.
WORDS = 200_000


def holding(texts: DataFrame, text_col: str, words: DataFrame, word_col: str, *, block: int = WORDS) -> DataFrame:
    """The rows of texts with every word of words they hold, once each, as column `word`.

    Texts and words are compared as they are. Null texts hold nothing, null and empty words stand nowhere. Words go to the tasks in
    blocks of about `block`, each built into one automaton there, so texts are read once for each block whatever the words.
    """
    some = words.select(F.col(word_col).cast("string").alias("word")).filter("word <> ''").distinct()
    blocks = max(1, -(-some.count() // block))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    at = texts.columns.index(text_col)
    out = None
    for b in range(blocks):
        part = some if blocks == 1 else some.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b)
        few = texts.sparkSession.sparkContext.broadcast([r[0] for r in part.collect()])
        found = texts.mapInArrow(_scan(few, at), f"{schema}, word string")
        out = found if out is None else out.unionByName(found)
    return out


def _scan(few, at: int):
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in few.value:
            automaton.add_word(w, w)
        if not few.value:
            return
        automaton.make_automaton()
        for batch in batches:
            rows, held = [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                if text:
                    got = sorted({w for _, w in automaton.iter(text)})
                    rows += [i] * len(got)
                    held += got
            if rows:
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(held, pa.string())], [*batch.schema.names, "word"])

    return run
