"""Problem 3: passages of held-out evaluation texts in a training corpus, by a positional inverted index.

Texts become normalised words. Postings (document, position, term with the words on one side of it) are kept of the
terms that are the rarest of some test window, counted over the whole corpus; they meet the positions
these terms have in the test items, and the lists are intersected outwards from there, one offset at a
time, until the shared run of words ends. Every window of `window` words holds its rarest term, so no
exact passage is missed, and stop words are never posted. A term met with its neighbours is no hot key
unless the passage itself stands everywhere.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, broadcast_if_small, materialize

WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


NOT_ASCII = re.compile("[^\x00-\x7f]+")


class _Context(Exception):
    """A run of characters can't be told without those around it."""


@functools.cache
def _patterns():
    drop = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf")))
    return re.compile("[" + re.escape(drop) + "]"), re.compile(r"[\W_]+")


@functools.lru_cache(100_000)
def _run_words(run: str) -> str | None:
    """The words of a run without ASCII, blanks between; null where it hangs on what stands before or behind it."""
    drop, other = _patterns()
    rest = drop.sub("", run)
    if rest and unicodedata.combining(rest[0]):  # may be one character with the letter before
        return None
    rest = unicodedata.normalize("NFKC", rest)
    return None if "\u03a3" in rest else other.sub(" ", rest.lower())  # a sigma ends a word in a form of its own


def _known(found: re.Match) -> str:
    out = _run_words(found.group())
    if out is None:
        raise _Context
    return out


def normal_words(text: str | None) -> str | None:
    """Words of a text between single blanks: no Cf characters, NFKC, lower case, runs of letters and digits."""
    if not text:
        return text
    if not text.isascii():
        try:
            text = NOT_ASCII.sub(_known, text)
        except _Context:
            drop, other = _patterns()
            return other.sub(" ", unicodedata.normalize("NFKC", drop.sub("", text)).lower()).strip()
    return b" ".join(text.encode().translate(WORDS).split()).decode()


def _normal(text: Column) -> Column:
    @F.arrow_udf("string")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array(map(normal_words, texts.to_pylist()), pa.string())

    return words(text)


def normalised(text: Column) -> Column:
    """normal_words of a text; ASCII texts stay in the JVM."""
    ascii_ = F.octet_length(text) == F.length(text)
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(ascii_, plain).otherwise(_normal(F.when(~ascii_, text)))


def _before(words: Column, pos: Column, reach: int | Column) -> Column:
    """Up to `reach` words before the word at pos (from 0), the nearest first."""
    return F.reverse(F.slice(words, F.greatest(pos - reach + 1, F.lit(1)), F.least(pos, F.lit(reach) if isinstance(reach, int) else reach)))


def _after(words: Column, pos: Column, reach: int | Column) -> Column:
    return F.slice(words, pos + 2, F.lit(reach) if isinstance(reach, int) else reach)


def _run(a: Column, b: Column) -> Column:
    """How many elements of two arrays agree from the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def _phrases(words: Column, pos: Column, half: int) -> Column:
    """Hashes of the word at pos with the `half` words before it and with those behind it, where there are so many."""
    sides = [F.when(F.size(x) == half, F.xxhash64(F.lit(i), F.get(words, pos), x)) for i, x in enumerate((_before(words, pos, half), _after(words, pos, half)))]
    return F.array_compact(F.array(*sides))


def leaked_passages(corpus: DataFrame, items: DataFrame, doc_col: str, text_col: str, item_col: str, item_text_col: str, *, window: int = 12, near: int | None = None) -> DataFrame:
    """(doc, item, words): the documents holding `window` or more consecutive words of an item, and the longest run found.

    With `near`, a proximity match counts too: at least `window` words of the item stand at their offsets within `near`
    words of an anchor, though others between them differ; where that is more than the run it is `words`. The anchor itself, the
    rarest word of a window of the item that the corpus has, must stand there. Null documents, null item ids and
    null, empty or short texts match nothing; repeated rows change nothing. Other columns are left out.
    """
    text = corpus.select(F.col(doc_col).alias("doc"), normalised(F.col(text_col)).alias("norm")).filter("doc is not null and norm <> ''")
    text = materialize(text.withColumn("n", F.monotonically_increasing_id()), "words").select("n", "doc", F.split("norm", " ").alias("words"))
    test = items.select(F.col(item_col).alias("item"), normalised(F.col(item_text_col)).alias("norm")).distinct().select("item", F.split("norm", " ").alias("words"))
    test = materialize(test.filter(F.col("item").isNotNull() & (F.size("words") >= window)).withColumn("v", F.xxhash64("words")), "tests")

    places = test.select("item", "v", F.size("words").alias("n"), F.posexplode("words").alias("pos", "term"))
    terms = broadcast_if_small(places.select("term").distinct())
    counts = text.select(F.explode("words").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ahead = Window.partitionBy("item", "v").orderBy("pos").rowsBetween(0, window - 1)
    # a window with a term the corpus lacks can't match exactly; in a proximity match others stand for it
    seen = F.col("df").isNotNull() if near is not None else F.lit(True)
    rarest = places.join(broadcast_if_small(materialize(counts, "counts")), "term", "left").withColumn("rarest", F.min(F.when(seen, F.struct(F.coalesce("df", F.lit(0)).alias("df"), "pos"))).over(ahead))
    anchors = rarest.filter(F.col("pos") + window <= F.col("n")).select("item", "v", "rarest.*").filter("df > 0").select("item", "v", "pos").distinct()
    anchors = materialize(anchors.join(test, ["item", "v"]).select("item", "v", F.col("pos").alias("at"), F.get("words", "pos").alias("term"), F.col("words").alias("item_words")), "anchors")

    # of a run as long as the window half stands on one side of its anchor: postings are met by anchor and half
    keys = (lambda words, pos: _phrases(words, pos, window // 2)) if near is None else (lambda words, pos: F.array(F.xxhash64(F.get(words, pos))))
    asked = anchors.select("item", "v", "at", F.explode(keys(F.col("item_words"), F.col("at"))).alias("key"))
    tokens = text.select("n", "words", F.posexplode("words").alias("pos", "term"))
    posted = anchors.select("term").distinct()
    if posted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # phrases are made of the few postings that are kept
        postings = tokens.join(F.broadcast(posted), "term", "left_semi").select("n", "pos", F.explode(keys(F.col("words"), F.col("pos"))).alias("key"))
    else:  # the words around don't travel
        postings = tokens.select("n", "pos", "term", keys(F.col("words"), F.col("pos")).alias("keys")).join(posted, "term", "left_semi").select("n", "pos", F.explode("keys").alias("key"))
    met = postings.join(broadcast_if_small(asked), "key").select("n", "pos", "item", "v", "at").distinct()
    met = materialize(met, "met")
    full = text.join(broadcast_if_small(met), "n").join(broadcast_if_small(test.withColumnRenamed("words", "item_words")), ["item", "v"])
    w, iw, size = F.col("words"), F.col("item_words"), F.size("item_words")
    run = F.lit(1) + _run(_before(w, F.col("pos"), size), _before(iw, F.col("at"), size)) + _run(_after(w, F.col("pos"), size), _after(iw, F.col("at"), size))
    if near is not None:
        agree = [F.size(F.filter(F.zip_with(cut(w, F.col("pos"), near), cut(iw, F.col("at"), near), lambda x, y: x == y), lambda x: F.coalesce(x, F.lit(False)))) for cut in (_before, _after)]
        run = F.greatest(run, F.lit(1) + agree[0] + agree[1])
    # the filter stands after the aggregate, else it would move into the join and end its code generation
    return full.select("doc", "item", run.alias("words")).groupBy("doc", "item").agg(F.max("words").alias("words")).filter(F.col("words") >= window)
