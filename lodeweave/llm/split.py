"""Problem 2: cut oversized texts at natural boundaries by pointer doubling.

The boundaries of a text are the ends of its paragraphs and sentences, in words. Each is joined to its
farthest legal successor: the last paragraph end within reach, else the last sentence end, else a cut
at the limit. The successor table is squared until one step covers the longest text, and the tables,
applied to the start from the largest step down, give all cuts of all texts at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WORD = r"[^\p{IsWhite_Space}]+\p{IsWhite_Space}*"
PARAGRAPH_END = r"(?:\r\n|\r(?!\n)|\n)\p{IsWhite_Space}*?(?:\r\n|\r|\n)\p{IsWhite_Space}*$"
#: A word that ends a sentence; abbreviations and initials don't.
SENTENCE_END = r"""[.!?。！？]["'\)\]”’]*\p{IsWhite_Space}*$"""
NO_SENTENCE_END = r"(?i)^[\(\[\"']*(?:\p{L}|e\.g|i\.e|etc|cf|al|vs|fig|figs|eq|ref|refs|dr|mr|mrs|ms|prof|no|approx|ca|resp)\.\p{IsWhite_Space}*$"
SENTENCE_START = r"""^["'\(\[“‘]*[\p{Lu}\p{N}\p{Lo}]"""
LINE_END = r"[\r\n]"


def _words(text):
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def boundaries(texts: DataFrame, limit: int) -> DataFrame:
    """texts over the limit with their words and boundaries, stops (pos, rank: 2 paragraph, 1 sentence)."""
    long = texts.filter(F.length("text") > 2 * limit).withColumn("words", _words("text")).filter(F.size("words") > limit)
    before, here = lambda i: F.get("words", i - 1), lambda i: F.get("words", i)
    paragraph = lambda i: before(i).rlike(PARAGRAPH_END)
    sentence = lambda i: (before(i).rlike(SENTENCE_END) & ~before(i).rlike(NO_SENTENCE_END) & here(i).rlike(SENTENCE_START)) | before(i).rlike(LINE_END)
    inner = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(i.alias("pos"), F.when(paragraph(i), 2).when(sentence(i), 1).otherwise(0).alias("rank")))
    return long.withColumn("stops", F.filter(inner, lambda s: s["rank"] > 0))


def successors(marks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(id, v, pos, nxt): each boundary's farthest legal successor; hard cuts inside long sentences are boundaries, too.

    marks: (id, v, pos, rank, n) with the start (0) and the end (n).
    """
    def farthest(marks: DataFrame, reach: int) -> list:
        w = Window.partitionBy("id", "v").orderBy("pos").rangeBetween(1, reach)
        return [F.max(F.when(F.col("rank") >= r, F.col("pos"))).over(w) for r in (3, 2, 1)]

    first, later = farthest(marks, limit), farthest(marks, limit - overlap)
    nxt = F.when(F.col("pos") == 0, F.coalesce(*first)).otherwise(F.coalesce(*later))
    known = marks.withColumn("nxt", nxt).withColumn("ahead", F.lead("pos").over(Window.partitionBy("id", "v").orderBy("pos")))
    # where no boundary is within reach: cuts at the limit until one is, all from this one place
    start = F.col("pos") + F.when(F.col("pos") == 0, limit).otherwise(limit - overlap)
    hard = known.filter("nxt is null and pos < n").select("id", "v", "n", F.explode(F.sequence(start, F.col("ahead") - 1, F.lit(limit - overlap))).alias("pos"))
    every = marks.unionByName(hard.select("id", "v", "pos", F.lit(0).alias("rank"), "n"))
    first, later = farthest(every, limit), farthest(every, limit - overlap)
    # the last of equals: a paragraph end, a sentence end, at last a hard cut
    w = lambda reach: F.max("pos").over(Window.partitionBy("id", "v").orderBy("pos").rangeBetween(1, reach))
    nxt = F.when(F.col("pos") == 0, F.coalesce(*first, w(limit))).otherwise(F.coalesce(*later, w(limit - overlap)))
    return every.select("id", "v", "pos", nxt.alias("nxt")).filter("nxt is not null")


def split_oversized(texts: DataFrame, id_col: str = "chunk_id", text_col: str = "text", *, limit: int = 900, overlap: int = 60) -> tuple[DataFrame, DataFrame]:
    """(pieces, paragraphs) of the texts with more than `limit` words; the others need no cut and give no rows.

    pieces: (id, text_key, index, start_word, fresh_word, end_word, text); each has at most `limit` words and, after
    the first, begins with the last `overlap` words before fresh_word. Their fresh parts follow each other
    without gap. paragraphs: (id, text_key, para_no, start_word, end_word).
    A word is a run of characters that aren't Unicode white space; the white space between words is kept,
    that at the ends of a piece dropped. Null ids, null and short texts give no rows; repeated rows give one result.
    Different texts under one id are split each by itself; text_key, a hash of the whole text, tells them apart.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to limit - 1")
    base = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    cut = boundaries(base, limit).withColumn("v", F.xxhash64("text")).groupBy("id", "v").agg(F.first(F.struct("words", "stops")).alias("x"))
    cut = materialize(cut.select("id", "v", "x.words", "x.stops", F.size("x.words").alias("n")), "oversized")
    ends = F.concat(F.array(F.struct(F.lit(0).alias("pos"), F.lit(3).alias("rank"))), "stops", F.array(F.struct(F.col("n").alias("pos"), F.lit(2).alias("rank"))))
    marks = cut.select("id", "v", "n", F.explode(ends).alias("s")).select("id", "v", "s.pos", F.when(F.col("s.pos") == F.col("n"), 3).otherwise(F.col("s.rank")).alias("rank"), "n")
    step = materialize(successors(marks, limit, overlap), "step")
    longest = cut.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    tables = [step]
    # two steps in a row pass more than limit - overlap words, so there are fewer than this many
    while 1 << len(tables) < 2 * longest // (limit - overlap) + 2:
        a, b = tables[-1], tables[-1].select("id", "v", F.col("pos").alias("nxt"), F.col("nxt").alias("far"))
        tables.append(materialize(a.join(b, ["id", "v", "nxt"]).select("id", "v", "pos", F.col("far").alias("nxt")), "step"))
    reached = cut.select("id", "v", F.lit(0).alias("pos"), F.lit(0).alias("index"))
    for k in reversed(range(len(tables))):
        jump = reached.join(tables[k], ["id", "v", "pos"]).select("id", "v", F.col("nxt").alias("pos"), (F.col("index") + (1 << k)).alias("index"))
        reached = materialize(reached.unionByName(jump), "reached")
    cuts = reached.join(step, ["id", "v", "pos"]).withColumnsRenamed({"pos": "fresh_word", "nxt": "end_word"})
    cuts = cuts.withColumn("start_word", F.greatest(F.col("fresh_word") - overlap, F.lit(0)))
    body = F.rtrim(F.array_join(F.slice("words", F.col("start_word") + 1, F.col("end_word") - F.col("start_word")), ""))
    body = F.regexp_replace(body, r"\p{IsWhite_Space}+$", "")
    pieces = cuts.join(cut.select("id", "v", "words"), ["id", "v"]).select(F.col("id").alias(id_col), F.col("v").alias("text_key"), "index", "start_word", "fresh_word", "end_word", body.alias("text"))
    breaks = F.concat(F.array(F.lit(0)), F.transform(F.filter("stops", lambda s: s["rank"] == 2), lambda s: s["pos"]), F.array(F.col("n")))
    paragraphs = cut.select("id", "v", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(breaks) - 1), lambda i: F.struct(F.get(breaks, i - 1).alias("start_word"), F.get(breaks, i).alias("end_word")))).alias("para_no", "p"))
    return pieces, paragraphs.select(F.col("id").alias(id_col), F.col("v").alias("text_key"), "para_no", "p.*")


def cut_paragraphs(pieces: DataFrame, paragraphs: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """(id, para_no) of the paragraphs over the limit, each told by a piece that begins inside of it; ids and numbers once."""
    begun = pieces.select(id_col, "text_key", F.col("fresh_word").alias("cut"))
    inside = paragraphs.filter(F.col("end_word") - F.col("start_word") > limit).join(begun, [id_col, "text_key"])
    return inside.filter("start_word < cut and cut < end_word").select(id_col, "para_no").distinct()
