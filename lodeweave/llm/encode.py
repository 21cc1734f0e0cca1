"""Problem 6: encode a whole corpus, every content-defined chunk once.

Texts are cut where a rolling hash of the last 16 bytes says so, so copies share their chunks although
other parts differ. Each distinct chunk is encoded once, its ids are joined back to the places where it
stands, and the seams are repaired where a cut may have changed the ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import TOKENIZER_DIR, encode, encoder

WINDOW = 16


def cut_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mean: int, least: int, most: int) -> list[np.ndarray]:
    """For each text data[start:end] (UTF-8) the places to cut, in bytes.

    A cut is wanted before a blank or line feed that follows a visible ASCII character: no token reaches
    over such a place, and the ids on both sides don't depend on each other. A text that has none for
    `most` bytes is cut before any whole character that is neither; those seams need repair.
    """
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(1)
    step, mul = 1, 0x01000193
    while step < WINDOW:  # after it, h[i] covers the 2 * step bytes up to i
        h[step:] = h[step:] + h[:-step] * np.uint32(mul)
        step, mul = step * 2, mul * mul & 0xFFFFFFFF
    white = (data == 0x20) | (data == 0x0A)
    seen = (data > 0x20) & (data < 0x7F)
    safe = np.zeros(len(data), bool)
    safe[1:] = white[1:] & seen[:-1]
    marked = safe.copy()
    marked[1:] &= ((h[:-1] ^ (h[:-1] >> 15)) * np.uint32(0x2C1B3C6D) >> np.uint32(8)) % np.uint32(max(1, mean // 6)) == 0
    at, out = np.flatnonzero(marked), []
    lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
    for s, e, i, j in zip(starts.tolist(), ends.tolist(), lo.tolist(), hi.tolist()):
        cuts, last = [], s
        for c in [*at[i:j].tolist(), e]:
            while c - last > most:  # nothing marked for too long
                part = safe[last + least : last + most]
                near = np.flatnonzero(part)
                if len(near):
                    last = last + least + int(near[-1])
                else:
                    rest = data[last + most : c]
                    whole = np.flatnonzero(((rest & 0xC0) != 0x80) & (rest != 0x20) & (rest != 0x0A))
                    if not len(whole):
                        break
                    last = last + most + int(whole[0])
                cuts.append(last)
            if c < e and c - last >= least:
                cuts.append(c)
                last = c
        out.append(np.array(cuts, np.int64))
    return out


def _pieces_udf(mean: int, least: int, most: int):
    @F.arrow_udf("array<string>")
    def pieces(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("").cast(pa.large_string())
        if texts.offset:
            texts = pa.concat_arrays([texts])
        off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[: off[-1]] if raw is not None else np.zeros(0, np.uint8)
        cuts = cut_points(data, off[:-1], off[1:], mean, least, most)
        count = np.array([len(c) + 1 for c in cuts], np.int64) * (off[1:] > off[:-1])
        bounds = np.concatenate([np.concatenate([[s], c]) for s, e, c in zip(off[:-1], off[1:], cuts) if e > s] or [np.zeros(0, np.int64)])
        bounds = np.append(bounds, off[-1]).astype(np.int64)
        child = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), raw or pa.py_buffer(b""))
        lists = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        return pa.ListArray.from_arrays(lists, child.cast(pa.string()))

    return pieces


def _encode_udf(folder: str, name: str):
    @F.arrow_udf("binary")
    def ids_of(texts: pa.Array) -> pa.Array:
        enc = encoder(folder, name)
        kind = np.uint16 if enc.max_token_value < 65536 else np.uint32
        return pa.array([encode(enc, t).astype(kind).tobytes() for t in texts.to_pylist()], pa.binary())

    return ids_of


def repair(enc, left: np.ndarray, right: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of two neighbouring chunks, as if encoded in one: widen a window over the seam and encode it anew.

    The window begins and ends at places no token reaches over (a visible ASCII character, then a blank
    and a visible character) or at the ends of the two; only there its ids are sure to agree.
    """
    a = len(left) - 1
    while a > 0 and not _free(tokens[left[a - 1]], tokens[left[a]]):
        a -= 1
    b = 1
    while b < len(right) and not _free(tokens[right[b - 1]], tokens[right[b]]):
        b += 1
    a = max(a, 0)
    seam = b"".join(tokens[i] for i in left[a:]) + b"".join(tokens[i] for i in right[:b])
    return np.concatenate([left[:a], encode(enc, seam.decode("utf-8", "strict"))]), right[b:]


def _free(before: bytes, after: bytes) -> bool:
    return 0x20 < before[-1] < 0x7F and after[:1] in (b" ", b"\n") and len(after) > 1 and after[1] > 0x20


def _join_udf(folder: str, name: str):
    @F.arrow_udf("array<int>")
    def joined(seqs: pa.Array, ids: pa.Array, loose: pa.Array) -> pa.Array:
        """Chunks of each text in order (repeated rows once), seams repaired."""
        enc = encoder(folder, name)
        kind = np.uint16 if enc.max_token_value < 65536 else np.uint32
        out, sizes, tokens = [], [0], None
        for seq, parts, free in zip(seqs.to_pylist(), ids.to_pylist(), loose.to_pylist()):
            got: list[np.ndarray] = []
            done = -1
            for k, part, apart in sorted(zip(seq, parts, free)):
                if k <= done or part is None:
                    continue
                done = k
                new = np.frombuffer(part, kind).astype(np.int32)
                if apart and got:
                    if tokens is None:
                        tokens = [enc.decode_single_token_bytes(i) for i in range(enc.max_token_value + 1)]
                    whole = np.concatenate(got)
                    first, new = repair(enc, whole, new, tokens)
                    got = [first.astype(np.int32)]
                got.append(new)
            out += got
            sizes.append(sizes[-1] + sum(map(len, got)))
        flat = np.concatenate(out) if out else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(flat, pa.int32()))

    return joined


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, mean_bytes: int = 1024, min_bytes: int = 256, max_bytes: int = 16384) -> DataFrame:
    """(id, ids): the ids of each text, without special tokens.

    Null and empty texts give the empty list. A row that is repeated with the same id and text comes out
    once; rows with the same id (or a null id) and different texts come out one by one. Other columns
    are left out, whatever their names. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut = texts.select("id", F.xxhash64("text").alias("whole"), _pieces_udf(mean_bytes, min_bytes, max_bytes)("text").alias("pieces"))
    pieces = cut.select("id", "whole", F.posexplode_outer("pieces").alias("seq", "piece"))
    # texts without chunks get keys of their own, lest they meet in one task
    empty = F.col("piece").isNull()
    key = [F.when(empty, F.xxhash64(F.lit(seed), "id", "whole")).otherwise(F.xxhash64(F.lit(seed), "piece")).alias(f"k{seed}") for seed in (1, 2)]
    places = pieces.select("id", "whole", "seq", *key, (F.col("seq").isNotNull() & (F.col("seq") > 0) & ~F.substring("piece", 1, 1).isin(" ", "\n")).alias("loose"))
    once = pieces.filter(~empty).select(*key, "piece").groupBy("k1", "k2").agg(F.first("piece").alias("piece"))
    once = once.select("k1", "k2", _encode_udf(folder, tokenizer)("piece").alias("ids"))
    full = places.join(once, ["k1", "k2"], "left").groupBy("id", "whole").agg(F.collect_list(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "ids", "loose")).alias("c"))
    return full.select(F.col("id").alias(id_col), _join_udf(folder, tokenizer)("c.seq", "c.ids", "c.loose").alias("ids"))
