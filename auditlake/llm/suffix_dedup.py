"""Removal of repeated long strings by suffix arrays.

Every byte under a 400-byte string that also starts anywhere else is removed. Suffix arrays are built over shards, and the
shards are made so that equal strings meet in one: each 400-byte window names an anchor, the leftmost least 64-byte gram in
it by hash, which equal windows share; windows whose anchor occurs once in the corpus cannot repeat. The windows of one
anchor that follow each other form a context; equal contexts are folded into one with a count before any text is moved. An
anchor with one context left, of several copies, needs no sorting: all of its windows repeat.

Each shard of contexts gets a suffix array by Larsson-Sadakane refinement in numpy (sort by 8 bytes, then double the depth
over the groups still tied) and common prefixes by Kasai's rule, run in step over many stretches of text at once. Suffixes
between which all common prefixes reach 400 bytes are equal windows. An anchor with more text than a shard holds is spread
over several; their distinct windows are cut by the remainder of their hash, and the shards' sorted arrays of an anchor are
merged by binary search in each part, so no task ever holds an unbounded group.

Passages of just over 50 words often have fewer than 400 bytes, and stay. So that they can be found, `n_shared_windows` counts
the places of a document where a 50-word string starts that another row has too, in the same way: contexts of 8-word anchors
are folded, and only where an anchor has several of them are their strings' hashes grouped.

Defined results: a null or empty text has no bytes, and the hash of none; strings never cross documents; texts under 400
bytes are kept whole; repeated rows are documents of their own, so they remove each other's strings; texts of any length are
read whole; an empty table gives no rows; columns besides doc_id and text are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import text as tx

U = np.uint64
GRAM = 64
STEP = 1 << 21
#: Bytes of text whose words or windows are hashed at a time: a worker keeps the powers that this takes.
PIECE = 1 << 18
LOW = U((1 << 22) - 1)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row, by running minima from both ends of blocks of w."""
    n = len(v)
    q = np.full(-(-n // w) * w, ~U(0), U)
    q[:n] = v
    q = q.reshape(-1, w)
    ahead = np.minimum.accumulate(q, axis=1).ravel()
    back = np.minimum.accumulate(q[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def contexts(x: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, context hash, low, n): the runs of window starts low .. low+n-1 of a text that name the same anchor."""
    out = []
    gram = min(gram, window)
    for at in range(0, len(x) - window + 1, STEP):
        part = x[at : at + STEP + window - 1]
        s = tx.prefix_sums(part)
        begin = np.arange(len(part) - gram + 1)
        h = tx.hashes(s, begin, begin + gram)
        # the low bits hold the place: the leftmost of equal grams is least, wherever the window lies
        least = sliding_min((h & ~LOW) | begin.astype(U), window - gram + 1) & LOW
        low = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        n = np.diff(np.append(low, len(least)))
        out.append((h[least[low].astype(np.int64)], tx.hashes(s, low, low + n + window - 1), low + at, n))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))


KEY = "doc_id long, k long"
NAMED = ["doc_id", "k"]


def _context_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in tx.pieces(batches, most=PIECE):
        data, offs = tx.utf8(batch.column(2))
        rows, own = [], []
        for i in np.flatnonzero(np.diff(offs) >= window):
            rows.append(contexts(data[offs[i] : offs[i + 1]], window))
            own.append(np.full(len(rows[-1][0]), i))
        if rows:
            anchor, ctx, low, n = (np.concatenate(c) for c in zip(*rows))
            at = pa.array(np.concatenate(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    *[pa.array(c.view(np.int64)) for c in (anchor, ctx)],
                    pa.array(low),
                    pa.array(n.astype(np.int64)),
                ],
                [*NAMED, "anchor", "ctx", "low", "n"],
            )


def suffix_array(x: np.ndarray, end: np.ndarray, real: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `real` in the order of their suffixes, to at least `depth` characters.

    x holds characters from 1 and zeros behind each text; end[i] is the first zero behind i; key[i] the 8 characters from i.
    Larsson-Sadakane: groups of equal prefixes are refined by the ranks `h` further on, h doubling; sorted ones rest."""
    first = key[real]
    order = np.argsort(first, kind="stable")
    sa, first = real[order], first[order]
    del order
    rank = np.zeros(len(x) + 1, real.dtype)

    def refine(slot: np.ndarray, pos: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Give the sorted suffixes `pos` at `slot` their group's rank; what stays tied."""
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(new)))
        rank[pos] = np.repeat(slot[head] + 1, size)
        tied = np.repeat(size > 1, size)
        return slot[tied], pos[tied]

    slot, pos = refine(np.arange(len(sa), dtype=real.dtype), sa, np.concatenate([[True], first[1:] != first[:-1]]) if len(sa) else np.zeros(0, bool))
    del first
    h = 8
    while len(pos) and h < depth:
        # ranks take as many bits as places; two of them side by side need 64
        k = rank[pos].astype(np.int64)
        k *= len(x) + 1
        k += rank[np.minimum(pos + h, end[pos])]
        order = np.argsort(k, kind="stable")
        # groups lie in order of rank, so the sorted suffixes fill the same slots again
        pos, k = pos[order], k[order]
        del order
        sa[slot] = pos
        slot, pos = refine(slot, pos, np.concatenate([[True], k[1:] != k[:-1]]))
        h *= 2
    return sa


def common_prefixes(sa: np.ndarray, end: np.ndarray, key: np.ndarray, most: int, stretch: int = 64) -> np.ndarray:
    """Common prefix of each suffix with the one before it in `sa`, up to `most`: Kasai's rule that a prefix shrinks by one
    at most from one position to the next, applied to all stretches of text in step."""
    n = len(end)
    before = np.full(n, -1, end.dtype)
    before[sa[1:]] = sa[:-1]
    length = np.zeros(n, np.int32)
    base = np.arange(0, n, stretch)
    h = np.zeros(len(base), np.int64)
    for t in range(stretch):
        p = base + t
        ok = np.flatnonzero(p < n)
        p = p[ok]
        q = before[p]
        g = np.where(q >= 0, np.maximum(h[ok] - 1, 0), 0)
        live = np.flatnonzero(q >= 0)
        limit = np.minimum(most, np.minimum(end[p] - p, np.where(q >= 0, end[q] - q, 0)))
        g = np.minimum(g, limit)
        live = live[g[live] < limit[live]]
        while len(live):
            differ = key[p[live] + g[live]] ^ key[q[live] + g[live]]
            same = differ == 0
            # equal leading bytes of the 8 compared; the bit below the top one is cleared, so a float cannot round up
            top = np.frexp((differ & ~(differ >> U(1))).astype(np.float64))[1]
            step = np.where(same, 8, 8 - (top + 7) // 8)
            g[live] = np.minimum(g[live] + step, limit[live])
            live = live[same & (g[live] < limit[live])]
        h[ok] = g
        length[p] = g
    return length[sa]


def shard_windows(texts: list[bytes], starts: np.ndarray, weight: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the first starts[i] positions of each text: (text, position, repeated, leader of an equal group)."""
    sizes = np.array([len(t) for t in texts])
    at = np.concatenate([[0], np.cumsum(sizes + 8)])[:-1]
    x = np.zeros(int((sizes + 8).sum()) + 8, np.uint8)
    x[: -8] = np.frombuffer(b"".join(t + b"\0" * 8 for t in texts), np.uint8)
    inside = np.zeros(len(x), bool)
    for a, n in zip(at, sizes):
        inside[a : a + n] = True
    x[inside] += 1  # no UTF-8 byte is 255, so zero is free to stand behind each text
    # places of a shard fit 32 bits unless a single text is larger
    place = np.int32 if len(x) < 1 << 31 else np.int64
    end = np.zeros(len(x) - 8, place)
    for a, n in zip(at, sizes):
        end[a : a + n + 8] = a + n
    key = np.zeros(len(end), U)
    for j in range(8):
        key <<= U(8)
        key |= x[j : j + len(key)]
    real = np.flatnonzero(inside[: len(end)]).astype(place)
    del inside
    # sorted to the texts' ends, since Kasai's rule fails where suffixes tied at a lesser depth part behind it
    sa = suffix_array(x, end, real, key, int(sizes.max(initial=window)))
    del real
    lcp = common_prefixes(sa, end, key, window)
    del key
    block = np.zeros(len(end), place)
    block[sa] = np.cumsum(lcp < window, dtype=place)
    del sa, lcp, end, x
    text = np.repeat(np.arange(len(texts)), starts)
    position = np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts)
    mine = block[at[text] + position]
    total = np.bincount(mine, weight[text])
    leader = np.zeros(len(mine), bool)
    leader[np.unique(mine, return_index=True)[1]] = True
    return text, position, total[mine] >= 2, leader


def spans_of(text: np.ndarray, position: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end): the bytes under windows, as runs; windows in order of text and position."""
    if not len(text):
        return text, position, position
    cut = np.concatenate([[True], (text[1:] != text[:-1]) | (position[1:] > position[:-1] + window)])
    head = np.flatnonzero(cut)
    last = np.append(head[1:], len(text)) - 1
    return text[head], position[head], position[last] + window


def _shard(table: pa.Table, window: int, most: int = 1 << 19) -> pa.Table:
    """One shard's rows (shard, anchor, ctx, m, n, hot, z) to spans, and for hot anchors to the hashes of distinct windows.

    Equal windows have equal anchors, so whole anchors are taken together up to `most` bytes of text at a time: memory is that
    of the largest anchor, or of `most` bytes, whatever falls into one shard."""
    anchor = np.asarray(table["anchor"])
    order = np.argsort(anchor, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
    size = np.add.reduceat(np.asarray(table["n"])[order] + (window - 1), head)
    cuts, held = [], 0
    for a, n in zip(head, size):
        if held and held + n > most:
            cuts.append(a)
            held = 0
        held += n
    return pa.concat_tables([_anchors(table.take(pa.array(rows)), window) for rows in np.split(order, cuts)])


def _anchors(table: pa.Table, window: int) -> pa.Table:
    """What _shard() gives, of rows that are sorted together."""
    z = zstandard.ZstdDecompressor()
    texts = [z.decompress(t) for t in table["z"].to_pylist()]
    hot = np.asarray(table["hot"])
    text, position, repeated, leader = shard_windows(texts, np.asarray(table["n"]), np.asarray(table["m"]), window)
    t, a, b = spans_of(text[repeated], position[repeated], window)
    found = [
        pa.table(
            {
                "anchor": table["anchor"].take(pa.array(t)),
                "ctx": table["ctx"].take(pa.array(t)),
                "a": a,
                "b": b,
                "hash": pa.nulls(len(t), pa.int64()),
                "shard": pa.nulls(len(t), pa.int64()),
                "done": pa.nulls(len(t), pa.bool_()),
            }
        )
    ]
    far = leader & hot[text]
    if far.any():  # other shards hold contexts of the same anchor: this one's distinct windows go to meet theirs
        h = np.zeros(int(far.sum()), U)
        t, p = text[far], position[far]
        for i in np.unique(t):
            s = tx.prefix_sums(np.frombuffer(texts[i], np.uint8))
            h[t == i] = tx.hashes(s, p[t == i], p[t == i] + window)
        shard = np.full(len(t), table["shard"][0].as_py())
        found.append(
            pa.table(
                {
                    "anchor": table["anchor"].take(pa.array(t)),
                    "ctx": table["ctx"].take(pa.array(t)),
                    "a": p,
                    "b": p + window,
                    "hash": h.view(np.int64),
                    "shard": shard,
                    "done": repeated[far],
                }
            )
        )
    return pa.concat_tables([x.cast(SHARD_SCHEMA) for x in found])


SHARD_SCHEMA = pa.schema(
    [
        ("anchor", pa.int64()),
        ("ctx", pa.int64()),
        ("a", pa.int64()),
        ("b", pa.int64()),
        ("hash", pa.int64()),
        ("shard", pa.int64()),
        ("done", pa.bool_()),
    ]
)


def _merge(table: pa.Table) -> pa.Table:
    """One range of window hashes: each shard's sorted array is looked up in every other's; windows found there repeat."""
    h, shard = np.asarray(table["hash"]).view(U), np.asarray(table["shard"])
    order = np.lexsort((h, shard))
    edges = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]]))
    runs = [h[order[a:b]] for a, b in zip(edges, edges[1:])]
    # all runs merged, from short to long, into what is known of each hash: in one shard, or in more
    known, more = np.zeros(0, U), np.zeros(0, bool)
    for run in sorted(runs, key=len):
        run = np.unique(run)
        at = np.searchsorted(known, run)
        there = np.zeros(len(run), bool)
        if len(known):
            there = known[np.minimum(at, len(known) - 1)] == run
        more[at[there]] = True
        known, more = np.insert(known, at[~there], run[~there]), np.insert(more, at[~there], False)
    hit = more[np.searchsorted(known, h)] & ~np.asarray(table["done"])
    return table.filter(pa.array(hit)).select(["anchor", "ctx", "a", "b"])


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([z.compress((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary())],
            [*NAMED, "z"],
        )


CUT = "anchor long, ctx long, low long, n long, m long, shard long, hot boolean, z binary, a long, b long, h long"


def _cut_batches(batches: Iterator[pa.RecordBatch], window: int, words: int) -> Iterator[pa.RecordBatch]:
    """(z, list of contexts, list of word contexts) to one row per context with its bytes, and one per word window with its hash."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    names = [x.split()[0] for x in CUT.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(x, types[kind]) for x, kind in map(str.split, CUT.split(", "))])

    def out(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(n, schema.field(x).type)) for x in names], names)

    for batch in batches:
        for z, rows, at in zip(*batch.columns):
            text = unpack.decompress(z.as_py())
            if rows.is_valid:
                flat = rows.values
                columns = {x: flat.field(x) for x in ("anchor", "ctx", "low", "n", "m", "shard", "hot")}
                spans = zip(columns["low"].to_pylist(), columns["n"].to_pylist())
                yield out(columns | {"z": pa.array([pack.compress(text[a : a + n + window - 1]) for a, n in spans], pa.binary())})
            if at.is_valid:
                h, _ = _word_hashes(pa.array([text], pa.binary()))
                *own, low, n = (np.asarray(at.values.field(x)) for x in ("anchor", "ctx", "a", "b", "low", "n"))
                start = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                w = tx.hashes(tx.prefix_sums(h), start, start + words)
                yield out({x: pa.array(np.repeat(v, n)) for x, v in zip(("anchor", "ctx", "a", "b"), own)} | {"h": pa.array(w.view(np.int64))})


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = tx.utf8(column)
    starts, ends, first = tx.words(data, offs)
    return tx.hashes(tx.prefix_sums(data), starts, ends), first


def _kept_batches(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, z, spans, w, text) to what is left; a text is packed in z, or else plain."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        size, gone, runs, digest, kept = [], [], [], [], []
        for z, spans, plain in zip(batch.column(1), batch.column(2), batch.column(4)):
            text = unpack.decompress(z.as_py()) if z.is_valid else (plain.as_py() or "").encode()
            out, at, n = [], 0, 0
            last = -1
            for a, b in sorted((x["a"], x["b"]) for x in spans.as_py() or ()):
                n += a > last
                if b > at:
                    out.append(text[at:a] if a > at else b"")
                    at = b
                last = max(last, b)
            rest = b"".join([*out, text[at:]])
            size.append(len(text)), gone.append(len(text) - len(rest)), runs.append(n), digest.append(
                hashlib.sha256(rest).hexdigest()
            ), kept.append(rest if with_text else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *[pa.array(x, pa.int64()) for x in (size, gone, runs)],
                pa.array(digest),
                batch.column(3).fill_null(0),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_windows", "kept"],
        )


def _anchor_batches(batches: Iterator[pa.RecordBatch], words: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in tx.pieces(batches, most=PIECE):
        h, first = _word_hashes(batch.column(2))
        rows = [(i, *contexts(h[first[i] : first[i + 1]], words, gram)) for i in np.flatnonzero(np.diff(first) >= words)]
        if rows:
            at = pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]))
            anchor, ctx, low, n = (np.concatenate([r[j] for r in rows]) for j in (1, 2, 3, 4))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    *[pa.array(x.view(np.int64)) for x in (anchor, ctx)],
                    pa.array(low),
                    pa.array(n.astype(np.int64)),
                ],
                [*NAMED, "anchor", "ctx", "low", "n"],
            )


def word_contexts(named: DataFrame, words: int, gram: int, most_broadcast: int = 2_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (doc_id, k, text): all contexts of word windows whose anchor occurs again; these folded, with the least and the
    greatest row that has each; and by row (doc_id, k) the folded ones whose windows must be compared.

    Anchors that occur again are 64-bit numbers; up to `most_broadcast` are broadcast."""
    row = F.xxhash64("doc_id", "k")
    kinds = f"{KEY}, anchor long, ctx long, low long, n long"
    found = tx.written(named.mapInArrow(lambda b: _anchor_batches(b, words, gram), kinds), "word-contexts")
    again = tx.written(found.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"), "word-anchors")
    live = tx.written(found.join(tx.few(again, most_broadcast), "anchor", "left_semi"), "word-live")
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), "doc_id", "k", "low", "n")).alias("r")
    folded = tx.written(live.groupBy("anchor", "ctx").agg(F.min(row).alias("a"), F.max(row).alias("b"), one), "word-folded")
    several = folded.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    at = F.collect_list(F.struct("anchor", "ctx", "a", "b", "r.low", "r.n")).alias("at")
    return live, folded, folded.join(several, "anchor").groupBy("r.doc_id", "r.k").agg(at)


def shared_windows(live: DataFrame, folded: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc_id, k, w): of rows that share a word window with another row, the number of places where such a window starts.
    Equal rows count as one.

    A context that two rows have is shared whole; of the others the windows (anchor, ctx, a, b, h) are compared."""
    met = hashes.groupBy("anchor", "h").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("anchor", "h")
    # equal rows give a context's windows more than once; a context itself holds no window twice
    partly = hashes.select("anchor", "ctx", "h").join(met, ["anchor", "h"]).groupBy("anchor", "ctx").agg(F.count_distinct("h").alias("some"))
    shared = folded.select("anchor", "ctx", (F.col("a") != F.col("b")).alias("whole"))
    shared = shared.join(partly, ["anchor", "ctx"], "left").where("whole OR some > 0")
    starts = F.collect_set(F.struct("low", F.when(F.col("whole"), F.col("n")).otherwise(F.col("some")).alias("w"))).alias("at")
    summed = F.aggregate("at", F.lit(0).cast("long"), lambda sum, x: sum + x["w"]).alias("w")
    return live.join(shared, ["anchor", "ctx"]).groupBy("doc_id", "k").agg(starts).select("doc_id", "k", summed)


def _parted(named: DataFrame, keys: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows that keys(doc_id, k) name, all others), told apart where they lie if the keys are few; else (all rows, None)."""
    keys = keys.select(F.col("doc_id").alias("i"), F.col("k").alias("j"))
    if keys.limit(most + 1).count() > most:
        return named, None
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("j"))
    return named.join(F.broadcast(keys), same, "left_semi"), named.join(F.broadcast(keys), same, "left_anti")


def remove_repeats(
    docs: DataFrame,
    window: int = 400,
    shard_bytes: int = 2 << 20,
    range_windows: int = 400_000,
    with_text: bool = False,
    words: int = 50,
    word_gram: int = 8,
    most_broadcast: int = 500_000,
) -> DataFrame:
    """One row per row of docs; `kept` holds the remaining bytes if with_text is set (they need not be valid UTF-8).

    most_broadcast: up to so many names of rows (two numbers each) are broadcast, so that other rows' texts stay where they are."""
    spark = docs.sparkSession
    tx.arrow_batches(spark)
    # a row is named by its doc_id and its text's hash: rows with equal names have equal texts, and so equal spans
    named = tx.only(docs, "doc_id", "text").select(F.col("doc_id"), F.xxhash64("text").alias("k"), "text")
    # found(anchor, ctx, doc_id, k, low, n): all contexts; `same` those whose anchor occurs again
    found = tx.written(named.mapInArrow(lambda b: _context_batches(b, window), f"{KEY}, anchor long, ctx long, low long, n long"), "contexts")
    folded = tx.written(
        found.groupBy("anchor", "ctx").agg(
            F.count("*").alias("m"),
            F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), "doc_id", "k", "low", "n")).alias("r"),
        ),
        "contexts-folded",
    )
    anchors = folded.groupBy("anchor").agg(F.sum("m").alias("all"), F.count("*").alias("kinds"), F.sum(F.col("r.n") + (window - 1)).alias("bytes")).where("all > 1")
    alone = folded.join(anchors.where("kinds = 1"), "anchor").select("anchor", "ctx", F.lit(0).cast("long").alias("a"), (F.col("r.n") + (window - 1)).alias("b"))
    anchors = anchors.where("kinds > 1")
    total = anchors.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    parts = F.ceil(F.col("bytes") / (2 * shard_bytes))
    chosen = folded.join(anchors, "anchor").select(
        "anchor", "ctx", "m", "r.doc_id", "r.k", "r.low", "r.n", (parts > 1).alias("hot"),
        # a hot anchor's shards have numbers of their own, of a hash of anchor and part
        F.when(
            parts > 1,
            -1 - F.abs(F.xxhash64("anchor", F.pmod(F.xxhash64("ctx"), parts)) % (1 << 60)),
        ).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard"),
    )
    per_doc = chosen.groupBy("doc_id", "k").agg(F.collect_list(F.struct("anchor", "ctx", "low", "n", "m", "shard", "hot")).alias("rows"))
    live, word_folded, places = word_contexts(named, words, word_gram)
    per_doc = per_doc.select("doc_id", "k", "rows", F.lit(None).cast(places.schema["at"].dataType).alias("at"))
    wanted = per_doc.union(places.select("doc_id", "k", F.lit(None).cast(per_doc.schema["rows"].dataType), "at"))
    wanted = tx.written(wanted.groupBy("doc_id", "k").agg(*[F.first(x, ignorenulls=True).alias(x) for x in ("rows", "at")]), "wanted")
    both = lambda left, right, how: left.join(right, left.doc_id.eqNullSafe(right.doc_id) & (left.k == right.k), how)
    packed = lambda rows: rows.mapInArrow(_pack_batches, f"{KEY}, z binary")
    inside, _ = _parted(named, wanted, most_broadcast)
    cut = both(packed(inside), wanted, "inner").select("z", "rows", "at").mapInArrow(lambda b: _cut_batches(b, window, words), CUT)
    cut = tx.written(cut, "cut")
    pieces = cut.where("z IS NOT NULL").drop("a", "b", "h")
    # equal rows of docs bring a context more than once
    pieces = pieces.groupBy("shard", "anchor", "ctx").agg(*[F.first(x).alias(x) for x in ("low", "n", "m", "hot", "z")])
    out = "anchor long, ctx long, a long, b long, hash long, shard long, done boolean"
    judged = tx.written(pieces.groupBy("shard").applyInArrow(lambda t: _shard(t, window), out), "shards")
    wide = judged.where("hash IS NOT NULL")
    ranges = max(1, -(-wide.count() // range_windows))
    # equal windows have equal anchors, so hashes are compared within an anchor only
    merged = wide.groupBy("anchor", F.pmod(F.shiftright("hash", 8), F.lit(ranges)).alias("range")).applyInArrow(
        lambda t: _merge(t.drop_columns(["range"]) if "range" in t.column_names else t),
        "anchor long, ctx long, a long, b long",
    )
    verdicts = judged.where("hash IS NULL").select("anchor", "ctx", "a", "b").union(merged).union(alone).groupBy("anchor", "ctx").agg(
        F.collect_list(F.struct("a", "b")).alias("spans")
    )
    # contexts with over a thousandth of all rows, a thousand at most, are salted on both sides
    salts = 64
    hot = F.broadcast(folded.where(F.col("m") > max(salts, found.count() // 1000)).select("anchor", "ctx", F.lit(True).alias("salted")))
    found = found.join(hot, ["anchor", "ctx"], "left").withColumn("salt", F.when(F.col("salted"), F.pmod(F.xxhash64("doc_id", "k", "low"), F.lit(salts))).otherwise(0))
    verdicts = verdicts.join(hot, ["anchor", "ctx"], "left").withColumn(
        "salt",
        F.explode(
            F.when(
                F.col("salted"),
                F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")),
            ).otherwise(F.array(F.lit(0).cast("long")))
        ),
    ).drop("salted")
    spans = (
        found.join(verdicts, ["anchor", "ctx", "salt"]).select(
            "doc_id",
            "k",
            F.explode(
                F.transform("spans", lambda s: F.struct((s["a"] + F.col("low")).alias("a"), (s["b"] + F.col("low")).alias("b")))
            ).alias("s"),
        )
        .select("doc_id", "k", "s", F.lit(0).cast("long").alias("w"))
        .union(shared_windows(live, word_folded, cut.where("h IS NOT NULL").select("anchor", "ctx", "a", "b", "h")).select("doc_id", "k", F.lit(None).alias("s"), "w"))
        .groupBy("doc_id", "k").agg(F.collect_set("s").alias("spans"), F.max("w").alias("w"))
    )
    spans = tx.written(spans, "spans")
    inside, outside = _parted(named, spans, most_broadcast)
    inside = packed(inside)
    kept = both(inside, spans, "left" if outside is None else "inner").select(inside.doc_id, "z", "spans", "w", F.lit(None).cast("string").alias("text"))
    if outside is not None:  # texts without a repeat are not shuffled, and so not packed: a task has one Python worker
        none = [F.lit(None).cast(kept.schema[x].dataType).alias(x) for x in ("z", "spans", "w")]
        kept = kept.union(outside.select("doc_id", *none, "text"))
    kept = kept.mapInArrow(
        lambda b: _kept_batches(b, with_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_windows long, kept binary",
    )
    return kept if with_text else kept.drop("kept")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(tx.table(spark, sf_dir, "documents"))
