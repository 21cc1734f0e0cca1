"""Packing paragraphs into windows of about so many words that overlap by whole paragraphs.

Paragraphs, sentences and word counts are columns; only the fold over a document's counts, which is
sequential by nature, is a small Python function. Texts never leave the JVM.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id, n_words, sentences


def pack(para: list[int], words: list[int], fits: list[bool], target: int, overlap: int, tail: int) -> tuple[list[list[int]], list[list[int]]]:
    """(pieces, windows). pieces: lists of units (a fitting paragraph, or sentences of one that doesn't, up to the
    target); windows: lists of pieces. A window closes when the next piece would overrun the target and it has
    at least `tail` new words; fitting paragraphs among its last `overlap` pieces open the next one; a short
    last window joins the one before."""
    pieces: list[list[int]] = []
    size: list[int] = []
    whole: list[bool] = []
    for u in range(len(para)):
        joins = bool(pieces) and not fits[u] and para[pieces[-1][-1]] == para[u] and size[-1] + words[u] <= target
        if joins:
            pieces[-1].append(u)
            size[-1] += words[u]
        else:
            pieces.append([u])
            size.append(words[u])
            whole.append(fits[u])
    windows: list[list[int]] = []
    now: list[int] = []
    held = 0
    for p in range(len(pieces)):
        if now[held:] and sum(size[i] for i in now) + size[p] > target and sum(size[i] for i in now[held:]) >= tail:
            windows.append(now)
            now = [i for i in now[len(now) - min(overlap, len(now)) :] if whole[i]]
            held = len(now)
        now = [*now, p]
    if now[held:]:
        if windows and sum(size[i] for i in now[held:]) < tail:
            windows[-1] = windows[-1] + now[held:]
        else:
            windows.append(now)
    return pieces, windows


def _pack_udf(target: int, overlap: int, tail: int):
    @F.arrow_udf("struct<pieces:array<array<int>>,windows:array<array<int>>>")
    def packed(units: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.int32()))
        got = [pack([u["para"] for u in row], [u["n"] for u in row], [u["fits"] for u in row], target, overlap, tail) if row else ([], []) for row in units.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], kind)], ["pieces", "windows"])

    return packed


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, target_words: int = 900, overlap_paras: int = 1, min_tail_words: int = 60, para_sep: str = r"\n\s*\n") -> DataFrame:
    """(chunk_id, doc_id, index, text). Blank and null texts have no chunks; ids hold a hash of the text."""
    body = docs.select(F.col(id_col).alias("doc"), F.filter(F.transform(F.split(text_col, f"(?U){para_sep}"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "").alias("paras"))

    def units(p, i):
        fits = n_words(p) <= target_words
        return F.transform(F.when(fits, F.array(p)).otherwise(sentences(p)), lambda s: F.struct(i.alias("para"), s.alias("text"), n_words(s).alias("n"), fits.alias("fits")))

    cut = body.filter(F.size("paras") > 0).select("doc", F.flatten(F.transform("paras", units)).alias("units"))
    slim = F.transform("units", lambda u: F.struct(u["para"].alias("para"), u["n"].alias("n"), u["fits"].alias("fits")))
    packed = cut.withColumn("k", _pack_udf(target_words, overlap_paras, min_tail_words)(slim))
    text_of = lambda piece: F.array_join(F.transform(piece, lambda u: F.get(F.col("units.text"), u)), " ")
    out = packed.withColumn("texts", F.transform("k.pieces", text_of)).select("doc", F.posexplode(F.transform("k.windows", lambda w: F.array_join(F.transform(w, lambda p: F.get(F.col("texts"), p)), "\n\n"))).alias("index", "text"))
    return out.select(chunk_id(F.col("doc"), F.col("index"), F.col("text")).alias("chunk_id"), F.col("doc").cast("string").alias("doc_id"), "index", "text")
