"""Runs of repeated words: stretches with a smallest period q that hold at least three periods and 24 words.

A run of period q has at least m = max(24 - q, 2q) places in a row whose word is the same q words on, so it holds a point of the
grid m-1, 2m-1, ..: over all periods the grid has n log n points. All pairs (period, grid point) of a slice of texts are held as
arrays, and the longest common extensions of the words at the point and q words on, forwards and backwards, are found for all
pairs at once by binary search over prefix hashes of the word numbers (which are exact, see lexicon.py). Of equal stretches the
smallest period stays, as every other one is its multiple. Each is then verified word by word; a text with a stretch that does not
hold is searched again by comparing words alone.

Before the search a text is changed as the contract says (`altered`), by a hash of its doc_id.

Defined results: a null or empty text, or one without a word, has no run, and both digests are that of the empty string; a null
doc_id leaves its text unaltered; rows that repeat a doc_id keep their rows; an empty table gives no rows; columns besides doc_id
and text are not read. Texts are whole; the memory of a task is bounded by its longest text, not by the number of its pairs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.llm import text as tx
from auditlake.llm.lexicon import word_numbers

U = np.uint64
SHORTEST = 24
TIMES = 3
ROWS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def altered(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) if the words from a on become those of a cycle of p words that starts at a."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    return a, 1 + (n - a) // (TIMES + g % 8)


def _same(prefix: np.ndarray, power: np.ndarray, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the hashes of `length` words at `at` and `period` words on are equal."""
    return (prefix[at + length] - prefix[at]) * power[period] == prefix[at + period + length] - prefix[at + period]


def _extensions(prefix, power, at, period, most, forwards: bool) -> np.ndarray:
    """The longest common extensions, up to `most`, of the words at `at` and `period` words on: all by one binary search."""
    low, high = np.zeros(len(at), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) >> 1, low)
        equal = _same(prefix, power, at if forwards else at - mid, period, mid)
        low, high = np.where(open_ & equal, mid, low), np.where(open_ & ~equal, mid - 1, high)
    return low


def _pairs(first: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, grid point within the text) of all pairs, about `most` at a time."""
    n = np.diff(first)
    periods = np.where(n >= SHORTEST, n // TIMES, 0)
    text = np.repeat(np.arange(len(n)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(SHORTEST - q, (TIMES - 1) * q)
    points = (n[text] - q) // step
    upto = np.concatenate([[0], np.cumsum(points)])
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
        c = points[lo:hi]
        k = np.arange(upto[hi] - upto[lo]) - np.repeat(upto[lo:hi] - upto[lo], c)
        yield np.repeat(text[lo:hi], c), np.repeat(q[lo:hi], c), (k + 1) * np.repeat(step[lo:hi], c) - 1
        lo = hi


def _smallest(text, start, end, period) -> tuple[np.ndarray, ...]:
    """One row for each (text, start, end), with its smallest period, in order."""
    order = np.lexsort((period, end, start, text))
    text, start, end, period = (x[order] for x in (text, start, end, period))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return text[new], start[new], end[new], period[new], period % period[new][np.cumsum(new) - 1] if len(new) else period


def _by_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of one text, by comparing words only: for texts whose hashes fail."""
    found = []
    for q in range(1, len(words) // TIMES + 1):
        equal = np.concatenate([[0], words[:-q] == words[q:], [0]]).astype(np.int8)
        edge = np.flatnonzero(np.diff(equal)).reshape(-1, 2)
        for s, e in edge[edge[:, 1] - edge[:, 0] + q >= max(SHORTEST, TIMES * q)].tolist():
            found.append((0, s, e + q, q))
    text, start, end, period, _ = _smallest(*np.array(found, np.int64).reshape(-1, 4).T)
    return start, end, period


def _verified(words: np.ndarray, at: np.ndarray, end: np.ndarray, period: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether all words from `at` to `end` are those `period` words before."""
    out, length = np.ones(len(at), bool), end - at - period
    upto = np.concatenate([[0], np.cumsum(length)])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
        c = length[lo:hi]
        i = np.repeat(at[lo:hi], c) + np.arange(upto[hi] - upto[lo]) - np.repeat(upto[lo:hi] - upto[lo], c)
        out[lo:hi] = tx.sums(words[i] != words[i + np.repeat(period[lo:hi], c)], upto[lo : hi + 1] - upto[lo]) == 0
        lo = hi
    return out


def runs(words: np.ndarray, first: np.ndarray, value: np.ndarray | None = None, most: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(text, start, end, period) of all runs of the texts whose word numbers `words` holds, by text, start and period.

    value: a hash of each word number, for tests; about `most` pairs of periods and grid points are held at once."""
    longest = int(np.diff(first).max(initial=0))
    hashed = tx.mix((words + 1).astype(U) * U(0x9E3779B97F4A7C15)) if value is None else value
    prefix, power = tx.prefix_sums(hashed), tx.powers(longest // TIMES + 1)
    found = [np.zeros((4, 0), np.int64)]
    for text, q, g in _pairs(first, most):
        base = first[:-1][text]
        hit = words[base + g] == words[base + g + q]
        text, q, g, base = text[hit], q[hit], g[hit], base[hit]
        ahead = _extensions(prefix, power, base + g, q, np.diff(first)[text] - q - g, True)
        back = _extensions(prefix, power, base + g, q, g, False)
        start, end = g - back, g + ahead + q
        long = end - start >= np.maximum(SHORTEST, TIMES * q)
        found.append(np.stack([x[long] for x in (text, start, end, q)]))
    text, start, end, period, odd = _smallest(*np.concatenate(found, 1))
    every = np.concatenate(found, 1)[0]
    base = first[:-1][text]
    bad = np.unique(text[~_verified(words, base + start, base + end, period)])
    if odd.any():  # a period that is no multiple of the smallest one of its stretch
        bad = np.union1d(bad, np.sort(every)[np.flatnonzero(odd)])
    if len(bad):
        keep = ~np.isin(text, bad)
        parts = [np.stack([x[keep] for x in (text, start, end, period)])]
        for t in bad:
            s, e, p = _by_words(words[first[t] : first[t + 1]])
            parts.append(np.stack([np.full(len(s), t), s, e, p]))
        text, start, end, period = np.concatenate(parts, 1)
    order = np.lexsort((period, start, text))
    return text[order], start[order], end[order], period[order]


def greatest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """Index of the run with the greatest length/period; ties: the smallest start, then period."""
    ratio = length / period
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9)).tolist()
    return min(near, key=lambda i: (-Fraction(int(length[i]), int(period[i])), start[i], period[i]))


def _collapsed(joined: memoryview, at: np.ndarray, to: np.ndarray, source: np.ndarray) -> str:
    """SHA-256 of the words of `source`, one space apart; words that lie next to each other are taken as one slice."""
    digest = hashlib.sha256()
    if len(source):
        cut = np.flatnonzero(np.diff(source) != 1) + 1
        begin, last = source[np.concatenate([[0], cut])], source[np.concatenate([cut - 1, [len(source) - 1]])]
        for i, (a, b) in enumerate(zip(at[begin].tolist(), to[last].tolist())):
            if i:
                digest.update(b" ")
            digest.update(joined[a:b])
    return digest.hexdigest()


def describe(ids: list[int | None], data: np.ndarray, offs: np.ndarray) -> dict[str, list]:
    """The columns of ROWS of the texts of a buffer."""
    starts, ends, first = tx.words(data, offs)
    n = np.diff(first)
    numbers, _ = word_numbers(data, starts, ends, first)
    source = np.arange(len(starts))
    for t, doc_id in enumerate(ids):
        if change := altered(doc_id, int(n[t])):
            a, p = change
            source[first[t] + a : first[t + 1]] = first[t] + a + np.arange(n[t] - a) % p
    text, start, end, period = runs(numbers[source], first)
    buffer, at, to = tx.join_words(data, starts, ends)
    joined = memoryview(buffer)
    mark = np.zeros(len(source) + 1, np.int64)
    np.add.at(mark, first[:-1][text] + start + period, 1)
    np.add.at(mark, first[:-1][text] + end, -1)
    kept = np.cumsum(mark[:-1]) == 0
    upto = np.searchsorted(text, np.arange(len(ids) + 1))
    out: dict[str, list] = {c.split()[0]: [] for c in ROWS.split(", ")}
    out["doc_id"], out["n_runs"] = ids, np.diff(upto).tolist()
    for t in range(len(ids)):
        mine = slice(upto[t], upto[t + 1])
        s, length, p = start[mine], (end - start)[mine], period[mine]
        best = (None,) * 4
        if len(s):
            i = greatest(s, length, p)
            best = int(s[i]), int(length[i]), int(p[i]), 1000 * int(length[i]) // int(p[i])
        for name, x in zip(("start", "length", "period", "exponent_milli"), best):
            out[name].append(x)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), length.tolist(), p.tolist()))
        out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
        words = slice(first[t], first[t + 1])
        out["collapsed_sha256"].append(_collapsed(joined, at, to, source[words][kept[words]]))
    return out


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in ROWS.split(", ")])
    for batch in tx.pieces(batches):
        yield pa.RecordBatch.from_pydict(describe(batch.column(0).to_pylist(), *tx.utf8(batch.column(1))), kinds)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of every row of docs(doc_id, text); see the module's text for defined results."""
    tx.arrow_batches(docs.sparkSession)
    return tx.only(docs, "doc_id", "text").mapInArrow(_run_batches, ROWS)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(tx.table(spark, sf_dir, "documents"))
