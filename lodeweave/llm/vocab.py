"""Public tokenizers on the executors: loaded once per worker from a folder that is a parameter."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

#: Folder of the vocabulary files; every operator takes it as a parameter.
TOKENIZER_DIR = os.environ.get("LODEWEAVE_TOKENIZERS", "/opt/tokenizers")
#: How byte_bpe_50k cuts a text before merging (fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoder(folder: str, name: str = "byte_bpe_50k"):
    """The tokenizer of a .tiktoken rank file; strings that look like special tokens are ordinary text."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(enc, text: str) -> np.ndarray:
    """The ids of a text as uint32."""
    return enc.encode_to_numpy(text, disallowed_special=())
