"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

For every benchmark item of n words each n-word window of a document has a 64-bit SimHash over its words. Items of one
length are indexed by four 16-bit blocks: fingerprints within 20 bits agree up to 5 bits in at least one block, so looking
up each block of a window among the items within 5 bits of it finds every item within the radius. Each candidate is then
checked exactly: the weighted Jaccard similarity (sum of minima over sum of maxima) of the multisets of 5-word shingles must
be 0.8 or more. Windows that share no shingle with any item have similarity zero, so no fingerprint is taken of them. (The
radius follows from the threshold: at similarity 0.8 one word of a 15-word item may differ, or the last tenth of a long one,
an expected distance of 7.5 to 12 bits; in trials 9 of 2760 such pairs lay over 16 bits.)

Words are split at ASCII white space, A-Z lower-cased. The benchmark is a stated query set: it is sent to the tasks in blocks of
bounded size, one pass over the documents for each block, without a shuffle.

Defined results: null or empty texts and items match nothing; an item of fewer than five words is one shingle, the whole
sequence, and is met in a longer document by the shingles of its own length; a document shorter than an item is compared whole; of equally similar windows the first is named; repeated
documents or items give a row each; an empty table on either side gives no rows; columns besides doc_id, text and item_id,
text are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import text as tx
from auditlake.llm.simhash import LOWER

U = np.uint64
BLOCKS = 4
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long, distance int, n_windows long"


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingles of each text from its word hashes; a short text is one shingle."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(count)])
    own = np.repeat(np.arange(len(n)), count)
    at = first[:-1][own] + np.arange(begin[-1]) - begin[:-1][own]
    return tx.hashes(tx.prefix_sums(words), at, np.minimum(at + width, first[1:][own])), begin


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tx.words(data, offs)
    return tx.hashes(tx.prefix_sums(LOWER[data]), starts, ends), first


def bits_of(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhash(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints from the number of words with each bit set, of n words."""
    return np.packbits(2 * ones > np.reshape(n, (-1, 1)), axis=1, bitorder="little").view(U).ravel()


def counted(sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset: (distinct shingles, how often each occurs)."""
    return np.unique(sh, return_counts=True)


class Index:
    """Benchmark items by length in words: ids, fingerprints, shingle multisets as arrays, and a table for each block."""

    def __init__(self, ids: list, texts: list[str | None], width: int = 5, radius: int = 20):
        self.width, self.radius = width, radius
        near = np.arange(1 << 16, dtype=np.uint32)
        self.masks = near[np.bitwise_count(near) <= radius // BLOCKS]
        words, first = word_hashes(*tx.utf8(pa.array(texts, pa.string())))
        sh, begin = shingles(words, first, width)
        self.known = np.unique(sh)
        n = np.diff(first)
        by: dict[int, list[int]] = {}
        for i in np.flatnonzero(n):
            by.setdefault(int(n[i]), []).append(int(i))
        self.items = {}
        #: for each size and block: the items in order of their block value, and where each value begins
        self.blocks = {}
        #: sizes by the width of their shingles: the full width, or less for shorter items
        self.widths: dict[int, list[int]] = {}
        for size, mine in sorted(by.items()):
            bits = np.stack([bits_of(words[first[i] : first[i + 1]]).sum(0, dtype=np.int32) for i in mine])
            self.widths.setdefault(min(size, width), []).append(size)
            fps = simhash(bits, np.full(len(mine), size))
            self.items[size] = ([ids[i] for i in mine], fps, [counted(sh[begin[i] : begin[i + 1]]) for i in mine])
            self.blocks[size] = []
            for b in range(BLOCKS):
                values = (fps >> U(16 * b)) & U(0xFFFF)
                order = np.argsort(values, kind="stable").astype(np.int32)
                self.blocks[size].append((values[order].astype(np.uint16), order))

    def near(self, size: int, b: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into values, item) of every item whose block b is near that value."""
        held, order = self.blocks[size][b]
        if len(held) <= len(self.masks):  # few items: each against each value
            at, item = np.nonzero(np.bitwise_count(values[:, None].astype(np.uint16) ^ held[None]) <= self.radius // BLOCKS)
            return at, order[item]
        asked = (values[:, None].astype(np.uint32) ^ self.masks[None]).astype(np.uint16).ravel()
        start, stop = np.searchsorted(held, asked, "left"), np.searchsorted(held, asked, "right")
        count = stop - start
        at = np.repeat(np.arange(len(asked)) // len(self.masks), count)
        return at, order[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())]

    def candidates(self, fps: np.ndarray, size: int, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of every pair within the radius, by block lookup; what is held at once is bounded. Where there
        are few pairs in all, as most texts have, the distances themselves are cheaper than four lookups."""
        items = self.items[size][1]
        if len(fps) * len(items) <= 1 << 15:
            distance = np.bitwise_count(fps[:, None] ^ items[None])
            window, item = np.nonzero(distance <= self.radius)
            return window, item, distance[window, item]
        found = []
        for b in range(BLOCKS):
            values, at = np.unique((fps >> U(16 * b)) & U(0xFFFF), return_inverse=True)
            windows = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[windows], np.arange(len(values) + 1))
            step = max(1, most // max(1, min(len(items), len(self.masks))))
            for lo in range(0, len(values), step):
                value, item = self.near(size, b, values[lo : lo + step])
                value = value + lo
                count = np.diff(edges)[value]
                # pairs of values and items to pairs of windows and items, again in bounded steps
                upto = np.cumsum(count)
                cuts = np.unique(np.append(np.searchsorted(upto, np.arange(most, int(upto[-1]) if len(upto) else 0, most)), len(value)))
                for p, q in zip(np.append(0, cuts), cuts):
                    c = count[p:q]
                    w = windows[np.repeat(edges[:-1][value[p:q]] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
                    i = np.repeat(item[p:q], c)
                    close = np.bitwise_count(fps[w] ^ items[i]) <= self.radius
                    found.append(np.unique(w[close].astype(np.int64) * len(items) + i[close]))
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        window, item = pair // len(items), pair % len(items)
        return window, item, np.bitwise_count(fps[window] ^ items[item])

    def search(self, words: np.ndarray, sh: np.ndarray, shared: np.ndarray, least: float, width: int, step: int = 1 << 16) -> dict:
        """{(size, item): [similarity, start, words, distance, windows]} of one text's windows, for items of that shingle width."""
        n = len(words)
        # only words from the first to the last window that can hold a shared shingle are looked at, in steps
        seen = np.flatnonzero(shared)
        most = max(self.widths[width])
        low, high = max(0, int(seen[0]) - most), min(n, int(seen[-1]) + width + most)
        upto = np.concatenate([[0], np.cumsum(shared)])
        found: dict = {}
        for lo in range(low, max(low + 1, high), step):
            hi = min(high, lo + step + most)
            total = np.zeros((hi - lo + 1, 64), np.int32)
            np.cumsum(bits_of(words[lo:hi]), axis=0, dtype=np.int32, out=total[1:])
            for size in self.widths[width]:
                start = np.arange(lo, min(lo + step, max(low, min(high, n) - size) + 1)) if size < n else np.arange(lo, min(lo + 1, 1))
                stop = np.minimum(start + size, n)
                last = np.maximum(stop - width, start) + 1  # shingles start..last lie in the window
                start = start[(stop <= hi) & (upto[np.minimum(last, len(sh))] > upto[np.minimum(start, len(sh))])]
                if len(start):
                    self._check(
                        start,
                        np.minimum(start + size, n),
                        size,
                        simhash(total[np.minimum(start + size, n) - lo] - total[start - lo], np.minimum(start + size, n) - start),
                        sh,
                        least,
                        width,
                        found,
                    )
        return found

    def _check(self, start: np.ndarray, stop: np.ndarray, size: int, fps: np.ndarray, sh: np.ndarray, least: float, width: int, found: dict) -> None:
        """Keep those windows that are similar enough, by their weighted shingles."""
        for w, i, d in zip(*self.candidates(fps, size)):
            a, b = int(start[w]), int(stop[w])
            keys, counts = counted(sh[a : max(b - width, a) + 1])
            theirs, often = self.items[size][2][i]
            at = np.minimum(np.searchsorted(theirs, keys), len(theirs) - 1)
            both = int(np.minimum(counts, often[at])[theirs[at] == keys].sum())
            similarity = both / (int(counts.sum()) + int(often.sum()) - both)
            if similarity >= least:
                best = found.setdefault((size, int(i)), [-1.0, 0, 0, 0, 0])
                best[4] += 1
                if similarity > best[0]:
                    best[:4] = similarity, a, b - a, int(d)


def _search_batches(batches: Iterator[pa.RecordBatch], index: Index, least: float) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    for batch in tx.pieces(batches):
        words, first = word_hashes(*tx.utf8(batch.column(1)))
        rows = []
        for width in index.widths if len(words) else ():
            sh, begin = shingles(words, first, width)
            at = np.searchsorted(index.known, sh)
            shared = index.known[np.minimum(at, len(index.known) - 1)] == sh
            for k in np.flatnonzero(tx.sums(shared.astype(np.int64), begin)):
                doc_id = batch.column(0)[int(k)].as_py()
                s = slice(begin[k], begin[k + 1])
                for (size, i), found in index.search(words[first[k] : first[k + 1]], sh[s], shared[s], least, width).items():
                    rows.append((doc_id, index.items[size][0][i], *found))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, width: int = 5, radius: int = 20, block_items: int = 20_000) -> DataFrame:
    """One row per document and benchmark item that the document contains, with its best window."""
    spark = docs.sparkSession
    tx.arrow_batches(spark)
    read = tx.only(docs, "doc_id", "text")
    items = tx.only(benchmark, "item_id", "text").where("text IS NOT NULL")
    total = items.count()
    out = spark.createDataFrame([], SCHEMA)
    n = -(-total // block_items)
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = block.orderBy("item_id", "text").toArrow()
        index = Index(rows["item_id"].to_pylist(), rows["text"].to_pylist(), width, radius)
        if index.items:
            sent = spark.sparkContext.broadcast(index)
            out = out.union(read.mapInArrow(lambda b, i=sent: _search_batches(b, i.value, least), SCHEMA))
    return out


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(tx.table(spark, sf_dir, "documents"), tx.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that hold a benchmark item go. Rows are told apart by a hash of doc_id, which may be null or
    repeated, and text."""
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    keyed = docs.select(row.alias("doc_id"), "text")
    leaks = tx.written(find_leaks(keyed, tx.table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.withColumn("\0row", row).join(leaks.select(F.col("doc_id").alias("\0leak")), F.col("`\0row`") == F.col("`\0leak`"), "left_anti").select(*docs.columns)
