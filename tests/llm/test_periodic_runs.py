"""Runs against a search by the definition, and their defined results at the edges."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from test_llm import EDGES, frame, rows

from auditlake.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """(start, length, period) by the definition: every maximal stretch of every period, with no smaller period."""
    found, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {x for s, length, q in found for x in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_against_the_definition(spark):
    rng = np.random.default_rng(3)
    data = rows() + EDGES
    for i in range(300):  # many of these ids have an altered text
        k, n = int(rng.integers(1, 6)), int(rng.integers(1, 160))
        data.append((100_000 + i, " ".join(f"w{x}" for x in rng.integers(0, k, n))))
    for i in range(60):  # repeated phrases in prose, chained and nested
        phrase = [f"p{x}" for x in rng.integers(0, 9, rng.integers(1, 12))]
        inner = phrase * int(rng.integers(3, 7)) + ["x"] * int(rng.integers(0, 3))
        data.append((200_000 + i, " \n".join(["start", *(inner * int(rng.integers(1, 5))), "end"])))
    want = sorted((expected(*x) for x in data), key=str)
    df = periodic_runs.periodic_runs(frame(spark, data))
    assert df.columns == [x.split()[0] for x in periodic_runs.ROWS.split(", ")]
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == want
    assert sum(x[1] > 0 for x in want) > 100 and any(x[1] > 2 for x in want)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2, n)


@pytest.mark.parametrize("most", [1 << 20, 7])
@pytest.mark.parametrize("hashed", ["good", "constant"])
def test_slices_and_bad_hashes(most, hashed):
    """All texts of a slice at once, in small blocks of pairs too; where every hash is equal, words alone decide."""
    texts = [np.zeros(40, np.int64), words(90, 1), np.arange(30), np.tile(words(11, 2), 9), np.zeros(0, np.int64), np.tile([0, 1, 2], 8)]
    texts = [x + 10 * i for i, x in enumerate(texts)]  # numbers differ between texts, as word_numbers gives them
    flat, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    value = None if hashed == "good" else np.zeros(len(flat), np.uint64)
    text, start, end, period = periodic_runs.runs(flat, first, value, most)
    got = [[] for _ in texts]
    for t, s, e, p in zip(text.tolist(), start.tolist(), end.tolist(), period.tolist()):
        got[t].append((s, e - s, p))
    assert got == [brute_runs(x.tolist()) for x in texts]


def test_thue_morse_words():
    """Polynomial hashes modulo 2**64 of this sequence and its complement are equal: only words tell them apart."""
    t = np.array([0])
    for _ in range(11):
        t = np.concatenate([t, 1 - t])
    w = np.concatenate([t, 1 - t, t, 1 - t])
    first = np.array([0, len(w)])
    got = periodic_runs.runs(w, first)
    again = periodic_runs._by_words(w)
    order = np.lexsort((again[2], again[0]))
    assert [x.tolist() for x in got[1:]] == [x[order].tolist() for x in again]


def test_long_text_is_not_quadratic():
    """A text of one word has n log n pairs, of which one run stays."""
    w = np.zeros(200_000, np.int64)
    text, start, end, period = periodic_runs.runs(w, np.array([0, len(w)]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [200_000], [1])


def test_no_rows(spark):
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []
