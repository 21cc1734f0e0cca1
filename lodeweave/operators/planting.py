"""Planting known errors into manuscripts.

Sites of each kind are found by regular expressions over lines; which are taken is drawn by a hash of seed,
document and place, so the same text gets the same errors on any number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, n_words

# The five kinds in their order, what is put in place, and the words a direction is flipped between.
GENE_SWAP, FLIP, P_ABOVE_ONE, FALSE_CITATION, PERCENT_ABOVE = KINDS = ("gene_symbol_swap", "effect_direction_flip", "impossible_pvalue", "fabricated_citation", "impossible_percentage")
FLIPS = {"increased": "decreased", "decreased": "increased", "higher": "lower", "lower": "higher", "upregulated": "downregulated", "downregulated": "upregulated"}
FALSE_P, FALSE_PERCENT, FALSE_AUTHOR = "p = 1.34", "412%", "Hollingsworth"
CITATION = " (Hollingsworth and Vance, 2019, Nat. Metab. 7:e91188)"

#: Where each kind may stand: a capital, letters and a short number; a word of FLIPS; a small p-value; a percentage under a hundred.
SITES = {
    GENE_SWAP: r"\b((?:[A-Z][a-z]{2}|[A-Z]{2,6})\d{1,2})\b",
    FLIP: r"(?i)\b(" + "|".join(FLIPS) + r")\b",
    P_ABOVE_ONE: r"(?i)\b(p\s*[=<]\s*0\.\d+)\b",
    PERCENT_ABOVE: r"\b(\d{1,2}(?:\.\d)?%)",
}
#: Words a line must have more of, where a kind asks for running text.
LEAST_WORDS = {GENE_SWAP: 12, FALSE_CITATION: 25}


def _sites(kind: str, line: Column) -> Column:
    """What a kind would replace in a line; empty where it has no site."""
    found = F.regexp_extract(line, SITES[kind], 1) if kind in SITES else F.lit(" ")
    return F.when(n_words(line) > LEAST_WORDS[kind], found).otherwise("") if kind in LEAST_WORDS else found


def _replacement(kind: str, old: Column) -> Column:
    if kind == GENE_SWAP:  # the next number of the family
        return F.concat(F.regexp_replace(old, r"\d+$", ""), (F.regexp_extract(old, r"(\d+)$", 1).try_cast("int") + 1).cast("string"))
    if kind == FLIP:
        return F.element_at(F.create_map(*[F.lit(x) for pair in FLIPS.items() for x in pair]), F.lower(old))
    return F.lit({P_ABOVE_ONE: FALSE_P, FALSE_CITATION: CITATION, PERCENT_ABOVE: FALSE_PERCENT}[kind])


def _edit(state: Column, site: Column) -> Column:
    """The line so far and the errors in it, with the error of one more site, if that still stands in the line."""
    now, old = state["now"], site["original"]
    is_ = lambda kind: site["kind"] == kind
    new = F.coalesce(*[F.when(is_(k), _replacement(k, old)) for k in KINDS])
    at = F.when(is_(FALSE_CITATION), F.length(F.rtrim(now)) + 1).otherwise(F.instr(now, old))
    behind = F.when(is_(FALSE_CITATION), "").otherwise(F.substring(now, at + F.length(old), F.length(now)))
    # a direction with the two words behind it, as the word alone stands in many texts
    phrase = F.trim(F.concat_ws(" ", new, F.array_join(F.slice(F.regexp_extract_all(behind, F.lit(r"(\S+)"), 1), 1, 2), " ")))
    token = F.when(is_(FLIP), phrase).when(is_(FALSE_CITATION), FALSE_AUTHOR).otherwise(new)
    error = F.struct(site["kind"].alias("kind"), F.trim(old).alias("original"), F.trim(new).alias("replacement"), token.alias("token"))
    done = F.struct(F.concat(F.substring(now, F.lit(1), at - 1), new, behind).alias("now"), F.array_append(state["errors"], error).alias("errors"))
    return F.when(at > 0, done).otherwise(state)


def plant(texts: DataFrame, *, per_kind: int = 1, window_words: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(planted texts (doc_id, text, skipped_kinds), errors (doc_id, error_id, kind, original, replacement, token, line_no)).

    Each kind takes at most per_kind lines within the first window_words words, the first line in any case; a line may serve several
    kinds, one after the other in the order of KINDS, and a kind whose site an earlier one has taken away passes. Null and
    empty texts come out as they are, with every kind skipped.
    """
    rows = texts.select("doc_id", F.posexplode(lines(F.col("text"))).alias("i", "line"))
    within = rows
    if window_words is not None:
        upto = F.sum(n_words(F.col("line"))).over(Window.partitionBy("doc_id").orderBy("i"))
        within = rows.withColumn("upto", upto).filter((F.col("upto") <= window_words) | (F.col("i") == 0))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _sites(k, F.col("line")).alias("original")) for k in KINDS]))
    sites = within.select("doc_id", "i", each.alias("s")).select("doc_id", "i", "s.*").filter("original <> ''")
    drawn = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(F.xxhash64(F.lit(seed), "doc_id", "kind", "i"), "i"))
    taken = sites.withColumn("nr", drawn).filter(F.col("nr") <= per_kind)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    taken = taken.groupBy("doc_id", "i").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "kind", "original"))).alias("sites"))
    start = F.struct(F.col("line").alias("now"), F.array().cast("array<struct<kind:string,original:string,replacement:string,token:string>>").alias("errors"))
    edited = rows.join(taken, ["doc_id", "i"], "left").select("doc_id", "i", F.coalesce(F.aggregate("sites", start, _edit), start).alias("e")).select("doc_id", "i", "e.*")
    every = edited.select("doc_id", "i", F.explode("errors").alias("e")).select("doc_id", "i", "e.*")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(place, "i")) - 1
    errors = every.select("doc_id", F.concat_ws("-", "kind", number.cast("string")).alias("error_id"), "kind", "original", "replacement", "token", (F.col("i") + 1).alias("line_no"))
    body = edited.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("now").alias("l")))).alias("ls"), F.array_distinct(F.flatten(F.collect_list("errors.kind"))).alias("planted"))
    out = texts.select("doc_id", F.col("text").alias("old")).join(body, "doc_id", "left")
    skipped = F.array_except(F.array(*map(F.lit, KINDS)), F.coalesce("planted", F.array().cast("array<string>")))
    return out.select("doc_id", F.coalesce(F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.col("old")).alias("text"), skipped.alias("skipped_kinds")), errors
