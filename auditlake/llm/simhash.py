"""SimHash near-duplicate groups by bit-sliced comparison.

The 64-bit fingerprint of a text is taken over its 3-word shingles (XXH64, seed 42). Distinct fingerprints only are
compared, as exact copies share one. Four 16-bit quarters give six pairs of quarters; two fingerprints within 2 bits agree
in at least two quarters, so they meet in at least one of the six key spaces, whose keys have 32 bits. Within a key the
comparison is bit-sliced: the bit planes of a block of fingerprints are stored vertically, 64 fingerprints to a machine
word, the distances of a block are updated plane by plane with carry-save counters, and a block is left as soon as every
distance in it is beyond the radius. A key with many fingerprints is split by three blocks of its other 32 bits, in one of
which such fingerprints agree too, and what is then still large is cut into tiles; so no task holds an unbounded group. A task returns a spanning forest of the links it finds instead of all pairs: components stay the same.

Defined results: a null or empty text, or one without a word, has fingerprint zero, which links like any other; a text with
fewer than three words has one shingle, the whole sequence; repeated doc_ids keep their rows, each with its own
fingerprint, and the component is that of the fingerprints; a null doc_id keeps its row and never names a component (a
component with null ids only has a null component_id); an empty table gives no rows; columns besides doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import text as tx

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprints(data: np.ndarray, offs: np.ndarray, width: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text of a buffer: a bit is 1 if it is set in over half of the shingle hashes."""
    starts, ends, first = tx.words(data, offs)
    n = np.diff(first)
    if not len(starts):
        return np.zeros(len(n), U)
    # a shingle is a slice of the words, lower-cased and joined by one space
    joined, at, to = tx.join_words(LOWER[data], starts, ends)
    buf, digest = joined.tobytes(), xxhash.xxh64_intdigest
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(count)])
    own = np.repeat(np.arange(len(n)), count)
    a = first[:-1][own] + (np.arange(begin[-1]) - begin[:-1][own])
    b = np.minimum(a + width, first[1:][own]) - 1
    h = np.fromiter((digest(buf[s:e], seed) for s, e in zip(at[a].tolist(), to[b].tolist())), U, len(a))
    return majority(h, own, count)


def majority(h: np.ndarray, own: np.ndarray, count: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """SimHash of each owner's hashes (those of an owner together, in order): a bit is 1 if it is set in over half of them."""
    out, ones = np.zeros(len(count), U), np.zeros((len(count), 64), np.int64)
    for lo in range(0, len(h), step):
        bits = np.unpackbits(h[lo : lo + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = own[lo : lo + step]
        cut = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        ones[mine[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    has = count > 0
    out[has] = np.packbits((2 * ones > count[:, None])[has], axis=1, bitorder="little").view(U).ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in tx.pieces(batches):
        fp = fingerprints(*tx.utf8(batch.column(1)), width=width)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def planes(values: np.ndarray) -> np.ndarray:
    """The bit planes of the values, each packed into 64-bit words; values of several words, (n, words), have 64 planes a word."""
    values = values.reshape(len(values), -1)
    n, width = -(-max(len(values), 1) // 64) * 64, values.shape[1]
    padded = np.zeros((n, width), U)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8 * width), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(U)


def within(plane_of, shape: tuple[int, ...], radius: int, bits: int = 64) -> np.ndarray:
    """Mask words of those lanes whose difference planes hold at most `radius` ones. plane_of(b) gives plane b.

    Carry-save: the incoming plane ripples through bitwise counters; what leaves the last counter is kept as `over`."""
    counters = [np.zeros(shape, U) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(shape, U)
    ones = U(0xFFFFFFFFFFFFFFFF)

    def beyond() -> np.ndarray:
        # counters > radius, compared from the top bit down
        more, same = np.zeros(shape, U), np.full(shape, ones)
        for k in reversed(range(len(counters))):
            if radius >> k & 1:
                same &= counters[k]
            else:
                more |= same & counters[k]
                same &= ~counters[k]
        return more | over

    for b in range(bits):
        carry = plane_of(b)
        for k in range(len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7 and radius <= b < bits - 1 and (beyond() == ones).all():
            return np.zeros(shape, U)
    return ~beyond()


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with left[i] and right[j] within radius: left values are queries, right values a sliced block. Values
    are 64-bit words, or rows of several such words."""
    ours, theirs = [], []
    block = 4096
    left = left.reshape(len(left), -1)
    for lo in range(0, len(right), block):
        part = right[lo : lo + block]
        p = planes(part)
        for q in range(0, len(left), 256):
            query = left[q : q + 256]
            plane = lambda b: p[b][None, :] ^ (U(0) - (query[:, b // 64] >> U(b % 64) & U(1)))[:, None]  # noqa: B023, E731
            mask = within(plane, (len(query), p.shape[1]), radius, len(p))
            if mask.any():
                i, j = np.nonzero(np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, : len(part)])
                ours.append(i + q)
                theirs.append(j + lo)
    none = np.zeros(0, np.int64)
    return (np.concatenate(ours), np.concatenate(theirs)) if ours else (none, none)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star of each component of the links (a, b): every member with the component's least value."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    member = low != np.arange(len(nodes))
    return nodes[member], nodes[low[member]]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """One row is one tile: two arrays of fingerprints (the second empty: the first against itself)."""
    small_a, small_b = [], []

    def flush():
        a, b = np.concatenate(small_a), np.concatenate(small_b)
        small_a.clear(), small_b.clear()
        mask = within(lambda k, p=planes(a ^ b): p[k], (-(-len(a) // 64),), radius)
        hit = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[: len(a)])
        return out(a[hit], b[hit])

    def out(a, b):
        x, y = forest(a, b) if len(a) else (a, b)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    held = 0
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1)):
            a, b = (np.asarray(x.values, np.int64).view(U) if x.is_valid and len(x.values) else np.zeros(0, U) for x in (left, right))
            if not len(b):
                if len(a) < 32:  # the pairs of many small keys are sliced together
                    i, j = np.triu_indices(len(a), 1)
                    small_a.append(a[i])
                    small_b.append(a[j])
                    held += len(i)
                    if held > 1 << 20:
                        yield flush()
                        held = 0
                    continue
                i, j = close_pairs(a, a, radius)
                i, j = i[i < j], j[i < j]
                yield out(a[i], a[j])
            else:
                i, j = close_pairs(a, b, radius)
                yield out(a[i], b[j])
    if held:
        yield flush()


def _forest_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to stars of the components that a task can see; about `most` links are held at once."""
    held: list[np.ndarray] = []

    def out():
        a, b = forest(*np.concatenate(held, 1))
        held.clear()
        for lo in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000]), pa.array(b[lo : lo + 100_000])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]))
            if sum(x.shape[1] for x in held) > most:
                yield from out()
    if held:
        yield from out()


def settled(edges: DataFrame) -> bool:
    """Whether links (a, b) are stars: no node is both a child and a root, or the child of two roots."""
    ends = edges.select("a", F.lit(1).alias("child")).union(edges.select("b", F.lit(0)))
    return ends.groupBy("a").agg(F.sum("child").alias("child"), F.count("*").alias("n")).where("child > 1 OR (child = 1 AND n > 1)").isEmpty()


def components(links: DataFrame, most_in_a_task: int = 1 << 20) -> DataFrame:
    """(node, root): the least node of each connected component of links(a, b), nodes with a link only.

    Each task first replaces the links that it can see by stars; if at most `most_in_a_task` (16 MB) are left, one task does the
    rest. Else large-star and small-star steps alternate until all links
    are stars; each round's links are written to the shared folder, nothing is collected. A node's many neighbours are met by
    min() aggregates, which combine before the shuffle, and a join."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = tx.written(edges.mapInArrow(_forest_batches, "a long, b long"), "cc")
    if edges.limit(most_in_a_task + 1).count() <= most_in_a_task:
        edges = tx.written(edges.coalesce(1).mapInArrow(_forest_batches, "a long, b long"), "cc")
    while not settled(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: greater neighbours (and itself) go to the least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("a > m").select("a", "m")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: a node's smaller neighbours and itself go to the least of them
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).distinct()
        edges = tx.written(small, "cc")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def shared(keys: DataFrame, *by: str) -> DataFrame:
    """Rows of keys(fp, key, sub, ..) whose key others have too, with their number n."""
    counts = keys.groupBy("key", "sub", *by).agg(F.count("*").alias("n")).where("n > 1")
    return keys.join(counts, ["key", "sub", *by])


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, tile: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text); see the module's text for defined results.

    tile: a key with more distinct fingerprints is compared in tiles of about so many."""
    if not 0 <= radius <= 2:
        raise ValueError("four quarters taken two at a time find every pair up to radius 2 only")
    spark = docs.sparkSession
    tx.arrow_batches(spark)
    fps = tx.written(tx.only(docs, "doc_id", "text").mapInArrow(lambda b, w=width: _fingerprint_batches(b, w), "doc_id long, fp long"), "fp")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    distinct = tx.written(least, "fp-distinct")
    quarter = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    other = lambda a, b: [x for x in range(4) if x not in (a, b)]
    both = lambda a, b: F.shiftleft(quarter[a], 16).bitwiseOR(quarter[b])
    meets = F.explode(
        F.array(
            *[
                F.struct(
                    F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(both(*pair)).alias("key"),
                    both(*other(*pair)).alias("rest"),
                ) for i, pair in enumerate(PAIRS)
            ]
        )
    ).alias("x")
    held = shared(distinct.select("fp", meets).select("fp", "x.key", F.lit(0).alias("sub"), "x.rest"))
    # of a large key's fingerprints those within 2 bits agree in one of three blocks of the other 32 bits
    thirds = F.array(*[F.struct(F.lit(i + 1).alias("sub"), F.shiftrightunsigned("rest", 11 * i).bitwiseAND(0x7FF).alias("rest")) for i in range(3)])
    large = shared(held.where(F.col("n") > tile).select("fp", "key", F.explode(thirds).alias("x")).select("fp", "key", "x.sub", "x.rest"), "rest")
    gathered = lambda df, *by: df.groupBy("key", "sub", *by).agg(F.collect_list("fp").alias("l")).select("l", F.array().cast("array<long>").alias("r"))
    plain = gathered(held.where(F.col("n") <= tile)).union(gathered(large.where(F.col("n") <= tile), "rest"))
    # what is still large is cut into tiles: a tile is a pair (i <= j) of k parts, and each part goes to its k tiles
    parts = F.ceil(F.col("n") / tile).cast("int")
    part = F.pmod(F.xxhash64("fp", F.lit(1)), parts).cast("int")
    tiled = (
        large.where(F.col("n") > tile).select("key", "sub", "rest", "fp", part.alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"))
        .select("key", "sub", "rest", "fp", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), (F.col("p") > F.col("o")).alias("second"))
        .groupBy("key", "sub", "rest", "i", "j").agg(
            F.collect_list(F.when(~F.col("second"), F.col("fp"))).alias("l"),
            F.collect_list(F.when(F.col("second"), F.col("fp"))).alias("r"),
        )
        .where((F.col("i") == F.col("j")) | (F.size("r") > 0)).select("l", "r")
    )
    found = plain.union(tiled).mapInArrow(lambda b, r=radius: _links(b, r), "a long, b long")
    roots = components(found)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("low").alias("component_id"))
    class_of = tx.written(named.join(best, "root").select("fp", "component_id"), "fp-class")
    return fps.join(class_of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(tx.table(spark, sf_dir, "documents"))
