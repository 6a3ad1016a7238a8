"""Byte-level BPE ids of whole texts, the same ids as the `tokenizers` library gives for the vocabulary file.

The vocabulary as ranks is encoded by tiktoken, which is several times faster and gives the same ids; a text that holds the
literal of a special token, which `tokenizers` turns into that token's id, is left to `tokenizers` itself."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _fast(path: str):
    """(encoding, special literals) for a .json vocabulary with its ranks beside it; None without them."""
    import json
    import os

    import public_tokenizers
    import tiktoken

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    with open(path, encoding="utf-8") as f:
        special = tuple(x["content"] for x in json.load(f).get("added_tokens", []))
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}), special


@lru_cache(maxsize=4)
def _plain(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str | None, path: str) -> np.ndarray:
    """uint32 ids, no special tokens added; a null text has none."""
    if not text:
        return np.zeros(0, np.uint32)
    fast = _fast(path)
    if fast is None or any(x in text for x in fast[1]):
        return np.asarray(_plain(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return fast[0].encode_to_numpy(text, disallowed_special=())
