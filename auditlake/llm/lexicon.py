"""The words of each text as numbers: equal words of a text have equal numbers, and different words different ones.

Words are hashed from prefix sums and sorted by text and hash; neighbours with equal hashes are compared byte by byte. A text
in which two different words share a hash is numbered again by its words themselves, so the numbers are exact."""

from __future__ import annotations

import numpy as np

from auditlake.llm import text as tx

U = np.uint64
#: Bits of a sort key that hold the text's number in its slice; the rest holds the hash.
TEXT_BITS = 20


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether the bytes from a and from b on, `length` of them, are equal; about `most` bytes are compared at once."""
    out, upto = np.ones(len(a), bool), np.concatenate([[0], np.cumsum(length)])
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
        n = length[lo:hi]
        within = np.arange(upto[hi] - upto[lo]) - np.repeat(upto[lo:hi] - upto[lo], n)
        other = data[np.repeat(a[lo:hi], n) + within] != data[np.repeat(b[lo:hi], n) + within]
        out[lo:hi] = tx.sums(other, upto[lo : hi + 1] - upto[lo]) == 0
        lo = hi
    return out


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hash_bits: int = 64 - TEXT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, distinct words of each text), given tx.words() of at most 2**20 texts."""
    texts = len(first) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(texts, np.int64)
    own = tx.owners(first)
    h = tx.hashes(tx.prefix_sums(data), starts, ends) >> U(64 - hash_bits)
    key = own.astype(U) << U(64 - TEXT_BITS) | h
    order = np.argsort(key)
    held = key[order]
    new = np.ones(len(order), bool)
    new[1:] = held[1:] != held[:-1]
    again = np.flatnonzero(~new)
    a, b = order[again - 1], order[again]
    same = ends[a] - starts[a] == ends[b] - starts[b]
    same[same] = equal_spans(data, starts[a[same]], starts[b[same]], ends[a[same]] - starts[a[same]])
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(new) - 1
    distinct = np.bincount(own[order[new]], minlength=texts)
    for t in np.unique(own[b[~same]]):
        seen: dict[bytes, int] = {}
        span = slice(first[t], first[t + 1])
        numbers[span] = [seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(starts[span].tolist(), ends[span].tolist())]
        distinct[t] = len(seen)
    return numbers, distinct
