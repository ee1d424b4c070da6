"""Token ids of whole texts by a public byte-level vocabulary, inside a task.

The rank file holds the same vocabulary as the tokenizer file and gives the same ids several
times faster; ``exact=True`` uses the tokenizer file itself. Strings of special tokens are text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, exact: bool = False) -> Callable[[str], list[int]]:
    if exact:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(_path(f"{vocabulary}.json"))
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(vocabulary), special_tokens={}
    ).encode_ordinary


@lru_cache(maxsize=2)
def _ranks(vocabulary: str) -> dict[bytes, int]:
    with open(_path(f"{vocabulary}.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str = VOCABULARY) -> np.ndarray:
    """How many bytes of text each id stands for."""
    ranks = _ranks(vocabulary)
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        out[rank] = len(token)
    return out


def encoded(texts, vocabulary: str = VOCABULARY, exact: bool = False):
    """The ids of each text, a text at a time; equal texts of one batch are encoded once."""
    encode, seen = encoder(vocabulary, exact), {}
    for text in texts:
        ids = seen.get(text)
        if ids is None:
            ids = np.array(encode(text or ""), np.uint32)
            seen[text] = ids
        yield ids
