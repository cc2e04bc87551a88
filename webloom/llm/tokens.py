"""A public byte-level tokenizer, built once a worker from its file of ranks."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = RANKS) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def lengths(path: str = RANKS) -> np.ndarray:
    """The byte length of every token."""
    enc = encoding(path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


def encode(text: str, path: str = RANKS) -> np.ndarray:
    return np.asarray(encoding(path).encode_ordinary(text), np.int64)


def count(text: str, path: str = RANKS) -> int:
    return len(encoding(path).encode_ordinary(text))
