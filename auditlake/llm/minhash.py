"""MinHash near-duplicate groups by an inverted join over signature coordinates.

A text is the set of its distinct 2-word shingles; two texts are linked if 100 x intersection >= 80 x union, and a group is a
connected component of links. Equal sets meet by a hash of the set; each different set has a signature of COORDS minima.

1. Post. The first POSTED coordinates, each with its value, are a set's tokens. Linked sets agree in at least POSTED_MATCHES of
   them (see below), so of the POSTED - POSTED_MATCHES + 1 tokens that come first in an order that all sets keep, they share one:
   only these are posted (prefix merging). Tokens that many sets have come last in the order; how many is counted in a sample of
   the sets, which bears on the order alone.
2. Centres, ROUNDS times. Of each token's list, the sets outside its largest group so far meet a centre of that group: pairs
   within the sizes that a link allows, whose signatures agree in MATCHES coordinates, are compared as whole sets. So a group of
   many near copies costs a few rows a set.
3. What is left. Of each list that still holds several groups, the sets outside the largest one are compared with all of the
   list, in tiles of bounded size, coordinate by coordinate; pairs of one group are skipped, and a tile is left once no pair can
   reach MATCHES any more (skip merging). Of the pairs that reach it a tile returns a forest, not the pairs. Its components are
   families, and within a family the sets outside the largest group are compared with all others as whole sets, in tiles too.

Every link is confirmed on whole sets. A link is missed only if its signatures agree in too few coordinates: at a similarity of 0.8
the number is binomial, and lies under 10 of 32 or 30 of 64 with a probability under 1e-8 (Chernoff bound); more similar sets, less.

Words are split at ASCII white space, A-Z lower-cased. Sets and shingles are told apart by 64-bit hashes. Defined results: a text of
one word has one shingle, that word; null or empty texts, and those without a word, have the empty set, size 0, and are linked with
nothing, not even each other: their component is their own doc_id; repeated doc_ids keep their rows, each with its own set; a null
doc_id keeps its row and never names a component (a component with null ids only has a null component_id, and its rows are kept);
an empty table gives no rows; columns besides doc_id and text are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm import text as tx
from auditlake.llm.simhash import LOWER, components, forest

U = np.uint64
PERCENT = 80
COORDS, MATCHES = 64, 30
POSTED, POSTED_MATCHES = 32, 10
PREFIX = POSTED - POSTED_MATCHES + 1
ROUNDS = 2
#: Sets of a signature tile's side, and shingles of a side of a tile of whole sets.
CHUNK, PART = 4096, 1 << 19
_drawn = tx.mix(np.arange(1, 2 * COORDS + 1, dtype=U) * tx.BASE)
TIMES, FLIP = (_drawn[:COORDS] >> U(32)).astype(np.uint32) | np.uint32(1), (_drawn[COORDS:] >> U(32)).astype(np.uint32)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles in order, first, hash of the set) of each text."""
    data, offs = tx.utf8(column)
    starts, ends, first = tx.words(data, offs)
    h = tx.hashes(tx.prefix_sums(LOWER[data]), starts, ends)
    n, own = np.diff(first), tx.owners(first)
    # each word and the next one of its text; a lone word stays alone
    last = np.zeros(len(h), bool)
    last[first[1:][n > 0] - 1] = True
    after = np.where(last, U(0), np.concatenate([h[1:], h[:0] if not len(h) else h[:1]]))
    sh = tx.mix(h * U(0x9E3779B97F4A7C15) + tx.mix(after + U(0x3C6EF372FE94F82B)))
    keep = ~last | (n[own] == 1)
    sh, own = sh[keep], own[keep]
    order = np.argsort(sh)
    order = order[np.argsort(own[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
    sh, own = sh[order], own[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (own[1:] != own[:-1])
    sh, own = sh[new], own[new]
    first = np.searchsorted(own, np.arange(len(n) + 1))
    return sh, first, tx.mix(tx.sums(tx.mix(sh).view(np.int64), first).view(U) + np.diff(first).astype(U))


def signatures(sh: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over each set, as rows of 32-bit numbers; zeros for an empty set."""
    has = np.diff(first) > 0
    out = np.zeros((len(has), COORDS), np.uint32)
    halves = [np.ascontiguousarray(x) for x in sh.view(np.uint32).reshape(-1, 2).T]
    for i in range(COORDS if has.any() else 0):
        out[has, i] = np.minimum.reduceat((halves[i % 2] ^ FLIP[i]) * TIMES[i], first[:-1][has])
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, width: int, kind=np.uint8) -> np.ndarray:
    return tx.utf8(column)[0].view(kind).reshape(-1, width)


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.pieces(batches):
        sh, first, key = shingle_sets(batch.column(2))
        sig = signatures(sh, first)
        columns = [pa.array(key.view(np.int64)), pa.array(np.diff(first)), _binary(sig.astype(np.uint8)), _binary(sig[:, :POSTED])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "t", "key", "n", "sig", "head"])


def tokens(head: np.ndarray) -> np.ndarray:
    """A number for each posted coordinate and its value; different ones have different numbers."""
    return tx.mix(head.astype(U) | np.arange(1, POSTED + 1, dtype=U)[None, :] << U(32))


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(tokens(_rows(batch.column(0), POSTED, np.uint32)).ravel().view(np.int64))], ["token"])


def levels(sets: DataFrame, one_in: int = 16, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(tokens in order, their levels) of the `most` commonest tokens of sampled sets; all others have level 0."""
    drawn = sets.where(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0).select("head")
    rows = drawn.mapInArrow(_token_batches, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = np.asarray(rows["token"]).astype(np.int64).view(U), np.asarray(rows["n"]).astype(np.int64)
    order = np.argsort(token)
    return token[order], np.minimum(63, 4 * np.log2(np.maximum(n, 1))).astype(U)[order]


def prefixes(head: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The PREFIX tokens of each set that come first: by level, then by number."""
    held = tokens(head)
    level = np.zeros(held.shape, U)
    if len(known[0]):
        at = np.minimum(np.searchsorted(known[0], held), len(known[0]) - 1)
        level = np.where(known[0][at] == held, known[1][at], U(0))
    order = np.lexsort((held, level), axis=1)[:, :PREFIX]
    return np.take_along_axis(held, order, 1)


def _posting_batches(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = prefixes(_rows(batch.column(2), POSTED, np.uint32), known)
        key, n = (np.repeat(np.asarray(batch.column(i)), PREFIX) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(held.ravel().view(np.int64)), pa.array(key), pa.array(n)], ["token", "key", "n"])


def _close_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) whose signatures agree in MATCHES coordinates."""
    for batch in batches:
        enough = (_rows(batch.column(2), COORDS) == _rows(batch.column(3), COORDS)).sum(1) >= MATCHES
        yield batch.select(["a", "b"]).filter(pa.array(enough))


def agreeing(left: np.ndarray, right: np.ndarray, able: np.ndarray) -> np.ndarray:
    """Which pairs of rows of two blocks of signatures, of those that are `able`, agree in MATCHES coordinates."""
    count = np.zeros(able.shape, np.uint8)
    for i in range(COORDS):
        count += left[:, i, None] == right[None, :, i]
        if i % 8 == 7 and not (able & (count + (COORDS - 1 - i) >= MATCHES)).any():
            return np.zeros(able.shape, bool)
    return able & (count >= MATCHES)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, columns) of a list of (key, n, root, sig)."""
    held = lists.flatten()
    columns = {c: np.asarray(held.field(c)) for c in ("key", "n", "root")}
    return np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py(), columns | {"sig": _rows(held.field("sig"), COORDS)}


def _able(left: dict, right: dict, i, j) -> np.ndarray:
    a, b = left["n"][i], right["n"][j]
    return (left["root"][i] != right["root"][j]) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = forest(a, b) if len(a) else (a, b)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _tile_batches(batches: Iterator[pa.RecordBatch], small: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Two lists a row to a forest of the pairs that can be links. Pairs of rows with up to `small` of them are taken together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        (at, left), (to, right) = (_flat(batch.column(i)) for i in (0, 1))
        na, nb = np.diff(at), np.diff(to)
        count = np.where(na * nb <= small, na * nb, 0)
        upto = np.concatenate([[0], np.cumsum(count)])
        lo = 0
        while lo < len(na):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + (1 << 20), "right")) - 1)
            row = np.repeat(np.arange(lo, hi), count[lo:hi])
            p = np.arange(len(row)) - np.repeat(upto[lo:hi] - upto[lo], count[lo:hi])
            i, j = at[row] + p // np.maximum(nb[row], 1), to[row] + p % np.maximum(nb[row], 1)
            able = _able(left, right, i, j)
            i, j = i[able], j[able]
            enough = np.concatenate([np.zeros(0, bool), *((left["sig"][i[k : k + 65536]] == right["sig"][j[k : k + 65536]]).sum(1) >= MATCHES for k in range(0, len(i), 65536))])
            yield _stars(left["key"][i[enough]], right["key"][j[enough]])
            lo = hi
        for k in np.flatnonzero(na * nb > small):
            a, b = [], []
            for q in range(at[k], at[k + 1], 256):
                i, j = slice(q, min(q + 256, at[k + 1])), slice(to[k], to[k + 1])
                able = _able(left, right, np.arange(i.start, i.stop)[:, None], np.arange(j.start, j.stop)[None, :])
                x, y = np.nonzero(agreeing(left["sig"][i], right["sig"][j], able))
                x, y = forest(left["key"][i][x], right["key"][j][y]) if len(x) else (x, y)
                a.append(x), b.append(y)
            yield _stars(np.concatenate(a), np.concatenate(b))


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.pieces(batches):
        sh, first, _ = shingle_sets(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sh.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "s"])


def _whole_links(key, root, other, sets: list[np.ndarray]) -> pa.RecordBatch:
    """One tile: a forest of the links of different groups of its `other` sets with all of them, by whole sets."""
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    upto = np.zeros(len(flat) + 1, np.int64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(other):
        able = (root != root[i]) & (100 * np.minimum(size, size[i]) >= PERCENT * np.maximum(size, size[i]))
        if able.any():
            mine = flat[first[i] : first[i + 1]]
            mark[mine] = True
            np.cumsum(mark[flat], out=upto[1:])
            mark[mine] = False
            both = upto[first[1:]] - upto[first[:-1]]
            j = np.flatnonzero(able & ((100 + PERCENT) * both >= PERCENT * (size + size[i])))
            a.append(np.full(len(j), key[i])), b.append(key[j])
    return _stars(np.concatenate(a), np.concatenate(b))


def _family_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, i, j, key, root, other, s), a tile's rows together, to the links of each tile."""
    now, held = None, []
    done = lambda: _whole_links(*(np.array([x[c] for x in held]) for c in range(3)), [x[3] for x in held])
    for batch in batches:
        marks = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j"))))
        key, root, other = (np.asarray(batch.column(c)) if c != "other" else batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "root", "other"))
        lists = batch.column("s")
        values, offs = np.asarray(lists.flatten()), np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        for r, mark in enumerate(marks):
            if mark != now and held:
                yield done()
                held = []
            now = mark
            held.append((key[r], root[r], other[r], values[offs[r] : offs[r + 1]].copy()))
    if held:
        yield done()


def _ratio(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


class Groups:
    """Groups of near copies of docs(doc_id, text)."""

    def __init__(self, docs: DataFrame):
        tx.arrow_batches(docs.sparkSession)
        self.docs = tx.only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("t"), "text")
        #: one row per row of docs
        self.rows = tx.written(self.docs.mapInArrow(_row_batches, "doc_id long, t long, key long, n long, sig binary, head binary"), "minhash-rows")
        #: one row per distinct set that is not empty: its size and signature, and the least row that has it
        row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("row")
        full = self.rows.where("n > 0").groupBy("key").agg(row, F.count("*").alias("copies"), *[F.first(x).alias(x) for x in ("n", "sig", "head")])
        self.sets = tx.written(full, "minhash-sets")
        self.roots: DataFrame | None = None
        self.lists = self.posted()
        for seed in range(ROUNDS):
            pairs = tx.written(self.centred(seed), "minhash-pairs")
            if pairs.isEmpty():
                break
            self.join_groups(self.checked(pairs))
        found = tx.written(self.left_over(), "minhash-left")
        if not found.isEmpty():
            self.join_groups(self.within(components(found)))

    def join_groups(self, links: DataFrame) -> None:
        self.roots = components(links if self.roots is None else links.union(self.roots.select("node", "root")))

    def with_roots(self, df: DataFrame) -> DataFrame:
        """df(key, ..) with the group of each set so far."""
        if self.roots is None:
            return df.withColumn("root", F.col("key"))
        return df.join(self.roots, df.key == self.roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "key"))

    def posted(self) -> DataFrame:
        """(token, key, n): the prefix tokens that several sets have."""
        sent = self.docs.sparkSession.sparkContext.broadcast(levels(self.sets))
        each = self.sets.select("key", "n", "head").mapInArrow(lambda b: _posting_batches(b, sent.value), "token long, key long, n long")
        each = tx.written(each, "minhash-postings")
        several = tx.written(each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "minhash-tokens")
        return tx.written(each.join(several, "token"), "minhash-lists")

    def split(self, seed: int) -> tuple[DataFrame, DataFrame]:
        """(lists with roots, (token, largest, centre, all, others) of those with several groups), both written."""
        lists = tx.written(self.with_roots(self.lists), "minhash-rooted")
        parts = lists.groupBy("token", "root").agg(F.count("*").alias("m"), F.min_by(F.struct("key", "n"), F.struct(F.xxhash64("key", F.lit(seed)), "key")).alias("centre"))
        largest = F.max_by(F.struct("root", "centre"), F.struct("m", F.xxhash64("root"), "root")).alias("x")
        tops = parts.groupBy("token").agg(largest, F.sum("m").alias("c"), F.count("*").alias("groups"), (F.sum("m") - F.max("m")).alias("others")).where("groups > 1")
        return lists, tx.written(tops.select("token", F.col("x.root").alias("largest"), F.col("x.centre").alias("centre"), "c", "others"), "minhash-tops")

    def centred(self, seed: int) -> DataFrame:
        """Pairs (a, b) of a set outside its list's largest group and that group's centre."""
        lists, tops = self.split(seed)
        met = lists.join(tops, "token").where((F.col("root") != F.col("largest")) & _ratio("n", "centre.n"))
        pairs = met.select(F.least("key", "centre.key").alias("a"), F.greatest("key", "centre.key").alias("b")).distinct()
        sa, sb = (self.sets.select(F.col("key").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
        return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_close_batches, "a long, b long")

    def whole(self, keys: DataFrame) -> DataFrame:
        """(key, s): the whole sets of keys(key), from the rows that stand for them."""
        wanted = tx.few(tx.written(self.sets.join(keys, "key", "left_semi").select("key", F.col("row.doc_id").alias("i"), F.col("row.t").alias("h")), "minhash-wanted"))
        texts = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("h"))).select("key", "text")
        return tx.written(texts.mapInArrow(_set_batches, "key long, s array<long>").dropDuplicates(["key"]), "minhash-whole")

    def checked(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs(a, b), by whole sets. A centre that meets many sets is repeated for every 1,000 of them."""
        whole = self.whole(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
        met = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a")).groupBy("x").agg(F.ceil(F.count("*") / 1000).cast("int").alias("salts"))
        met = tx.written(met, "minhash-met")
        salt = lambda end, other: F.pmod(F.xxhash64(other), F.col(f"salts_{end}")).cast("int").alias(f"salt_{end}")
        count = lambda end: met.select(F.col("x").alias(end), F.col("salts").alias(f"salts_{end}"))
        dealt = pairs.join(count("a"), "a").join(count("b"), "b").select("a", "b", salt("a", "b"), salt("b", "a"))
        sets = lambda end: whole.join(met, whole.key == met.x).select(F.col("key").alias(end), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias(f"salt_{end}"), F.col("s").alias(f"s{end}"))
        both = dealt.join(sets("a"), ["a", "salt_a"]).select("a", "b", "salt_b", "sa").join(sets("b"), ["b", "salt_b"])
        shared = F.size(F.array_intersect("sa", "sb"))
        return tx.written(both.where((100 + PERCENT) * shared >= PERCENT * (F.size("sa") + F.size("sb"))).select("a", "b"), "minhash-links")

    def left_over(self) -> DataFrame:
        """A forest of the pairs of different groups that can be links: of every list, the sets outside its largest group with all."""
        lists, tops = self.split(ROUNDS)
        live = lists.join(tops.select("token", "largest", "c", "others"), "token").join(self.sets.select("key", "sig"), "key")
        live = tx.written(live.select("token", "key", "n", "root", "sig", (F.col("root") != F.col("largest")).alias("other"), "c", "others"), "minhash-live")
        chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
        mine = lambda c, seed: F.pmod(F.xxhash64("key", F.lit(seed)), chunks(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), chunks(c) - 1))
        held = F.struct("key", "n", "root", "sig")
        ours = live.where("other").select("token", held.alias("l"), F.lit(None).alias("r"), mine("others", 7).alias("i"), every("c").alias("j"))
        theirs = live.select("token", F.lit(None).alias("l"), held.alias("r"), every("others").alias("i"), mine("c", 8).alias("j"))
        tiles = ours.union(theirs).groupBy("token", "i", "j").agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))
        return tiles.where("size(l) > 0 AND size(r) > 0").select("l", "r").mapInArrow(_tile_batches, "a long, b long").distinct()

    def within(self, families: DataFrame) -> DataFrame:
        """The links within families(node, root) between sets of different groups, by whole sets in tiles of bounded size."""
        members = families.select(F.col("node").alias("key"), F.col("root").alias("family")).union(families.select("root", "root").distinct())
        members = tx.written(self.with_roots(members.join(self.sets.select("key", "n"), "key")), "minhash-members")
        parts = members.groupBy("family", "root").agg(F.sum("n").alias("m"))
        tops = parts.groupBy("family").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.sum("m").alias("c"), (F.sum("m") - F.max("m")).alias("others"))
        tops = tx.written(tops, "minhash-families")
        count = lambda c: F.ceil(F.col(c) / PART).cast("int")
        mine = lambda c, seed: F.pmod(F.xxhash64("key", F.lit(seed)), count(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
        live = members.join(tops, "family").withColumn("other", F.col("root") != F.col("largest"))
        ours = live.where("other").select("family", "key", "root", F.lit(True).alias("other"), mine("others", 7).alias("i"), every("c").alias("j"))
        theirs = live.select("family", "key", "root", F.lit(False).alias("other"), every("others").alias("i"), mine("c", 8).alias("j"))
        # a set that is both is there once
        rows = ours.union(theirs).groupBy("family", "i", "j", "key", "root").agg(F.max("other").alias("other"))
        whole = self.whole(members.select("key"))
        tiles = rows.join(whole, "key").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
        return tx.written(tiles.select("family", "i", "j", "key", "root", "other", "s").mapInArrow(_family_batches, "a long, b long"), "minhash-links")

    def components(self) -> DataFrame:
        """(key, component_id, copies) of every distinct set."""
        named = self.with_roots(self.sets.select("key", "copies", F.col("row.doc_id").alias("low")))
        least = named.groupBy("root").agg(F.min("low").alias("component_id"))
        return tx.written(named.join(least, "root").select("key", "component_id", "copies"), "minhash-components")

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) of every row of docs. Sets that over a thousandth of the rows have, at most
        1,000 of them, are broadcast, so that no key of the other join holds more."""
        found = self.components()
        rows = self.rows.select("doc_id", "key", F.col("n").alias("n_shingles"))
        often = found.where(F.col("copies") * 1000 > self.rows.count()).select("key", "component_id")
        full = rows.where("n_shingles > 0")
        hot = full.join(F.broadcast(often), "key").select("doc_id", "n_shingles", "component_id")
        rest = full.join(F.broadcast(often), "key", "left_anti").join(found.select("key", "component_id"), "key").select("doc_id", "n_shingles", "component_id")
        empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return hot.union(rest).union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text); see the module's text for defined results."""
    return Groups(docs).result()


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(tx.table(spark, sf_dir, "documents"))
