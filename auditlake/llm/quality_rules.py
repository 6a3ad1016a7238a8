"""Quality rules: counted base rules, and perplexity bands of a modified Kneser-Ney model for each language.

The model is over 5-grams of UTF-8 bytes, of a text's words joined by one space; its perplexity is per lexical word (one with a
letter, a digit or a byte of another alphabet), so that bare separators and symbols hung on words are paid for by the words.
A model would be too sure of the texts that it was counted on. So texts fall into two halves by a hash, copies into the same
half, and each half is scored by the model of the other (by its own where its language has no text in the other).

Spark counts the 5-grams of every whole text: each task sums its own before the shuffle. A language's half is parted into
SLICES by the two bytes in front of a gram's last one. All orders from three to five of a gram lie in one slice, so a slice's
continuation counts, context totals, interpolated probabilities and back-off weights are made by one task, as sorted arrays;
discounts and orders one and two come from sums over the slices. The arrays are a table in the shared folder, and each
task reads those of the languages that it meets; what a worker holds at once is bounded by `most_bytes`, and a language that
needs more is scored in several steps over parts of its slices. (If Python cannot read the shared folder's file system, the
table is broadcast, within a checked size.) Logarithms are kept in millionths of a bit, so sums do not depend on the parts.

A language's band is its median of bits per lexical word, over documents that pass the base rules, plus and minus `spread`
times its scaled median deviation, and at least `margin` bits wide; short texts get a wider band, as their mean varies more.

Defined results: a null or empty text has no words, so all counts are 0 and base_failed holds; null and empty lang are one
language of its own; a text without lexical words has a null perplexity and is not kept; repeated rows are scored, and counted,
each; texts of any length are read whole; an empty table gives no rows; columns besides doc_id, text and lang are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm import text as tx

U = np.uint64
ORDER = 5
WINDOW = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SLICES = 128
#: Bytes of lexical words.
LEXICAL = np.zeros(256, bool)
LEXICAL[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _distinct(key: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys of each owner, whether each key occurs again with its owner)."""
    _, at, inverse, count = np.unique(tx.mix(key ^ tx.mix(own.astype(U) + U(1))), return_index=True, return_inverse=True, return_counts=True)
    return np.bincount(own[at], minlength=n), count[inverse] > 1


def base_counts(data: np.ndarray, offs: np.ndarray, spans: tuple) -> list[np.ndarray]:
    n, size = len(offs) - 1, len(data)
    starts, ends, first = spans
    n_words = np.diff(first)
    if not size:
        return [np.zeros(n, np.int64)] * 5
    space = tx.IS_SPACE[data]
    chars = tx.sums((~space & ((data & 0xC0) != 0x80)).astype(np.int64), offs)
    symbols = tx.sums(SYMBOL[data].astype(np.int64), offs)
    s = tx.prefix_sums(data)
    # lines with a word, less the distinct ones
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([offs[:-1], breaks + 1])
    own = np.concatenate([np.arange(n), np.searchsorted(offs, breaks, "right") - 1])
    end = np.minimum(np.append(breaks, size)[np.searchsorted(breaks, begin)], offs[own + 1])
    filled = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, own = begin[filled], end[filled], own[filled]
    lines, _ = _distinct(tx.hashes(s, begin, end), own, n)
    dup_lines = np.bincount(own, minlength=n) - lines
    # words under windows that occur again in the same text
    ws = tx.prefix_sums(tx.hashes(s, starts, ends))
    del s
    count = np.maximum(n_words - WINDOW + 1, 0)
    own = np.repeat(np.arange(n), count)
    at = first[:-1][own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    again = at[_distinct(tx.hashes(ws, at, at + WINDOW), own, n)[1]]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    repeated = tx.sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), first)
    return [n_words, chars, symbols, dup_lines, repeated]


def grams(data: np.ndarray, spans: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(packed 5-grams, first): one for each byte of a text's joined words; before a text stand spaces."""
    starts, ends, first = spans
    buf, at, to = tx.join_words(data, starts, ends)
    bound = np.append(at, len(buf))[first]
    into = np.arange(len(buf)) - np.repeat(bound[:-1], np.diff(bound))
    g = buf.astype(U)
    for j in range(1, ORDER):
        back = np.full(len(buf), 32, np.uint8)
        back[j:] = buf[:-j] if len(buf) > j else []
        back[into < j] = 32
        g |= back.astype(U) << U(8 * j)
    return g, bound


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([c for _, c in held]), len(key)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Counts by language and half, summed over the task; what is held is bounded, more is sent on and summed after the shuffle."""
    held: dict[tuple[str, int], list] = {}

    def out(name):
        key, count = _merge(held.pop(name))
        for lo in range(0, len(key), 100_000):
            k = key[lo : lo + 100_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name[0]] * len(k), pa.string()),
                    pa.array([name[1]] * len(k), pa.int32()),
                    pa.array(k),
                    pa.array(count[lo : lo + 100_000]),
                ],
                ["lang", "half", "g", "n"],
            )

    for batch in tx.pieces(batches):
        data, offs = tx.utf8(batch.column(0))
        g, bound = grams(data, tx.words(data, offs))
        for name, mine in _by_model(batch.column(1), batch.column(2)):
            key, count = np.unique(g[np.repeat(mine, np.diff(bound))], return_counts=True)
            if not len(key):
                continue
            rows = held.setdefault(name, [])
            rows.append((key, count))
            if len(rows) > 4:
                held[name] = [_merge(rows)]
        for name in [x for x, v in held.items() if sum(len(k) for k, _ in v) > most]:
            yield from out(name)
    for name in list(held):
        yield from out(name)


def _by_model(langs: pa.Array, halves: pa.Array) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """((lang, half), mask of its texts) for those that occur."""
    lang, half = np.array(langs.fill_null("").to_pylist(), object), np.asarray(halves)
    for name in sorted(set(zip(lang.tolist(), half.tolist()))):
        yield name, (lang == name[0]) & (half == name[1])


def halved(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the half that a row's text falls into."""
    return tx.only(docs, *names).withColumn("half", F.xxhash64("text").bitwiseAND(1).cast("int"))


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, half, slice, g, n) over every whole text; a slice's rows lie in one partition."""
    tx.arrow_batches(docs.sparkSession)
    counted = halved(docs, "text", "lang").mapInArrow(lambda b: _count_batches(b), "lang string, half int, g long, n long")
    # as slice_of()
    part = F.shiftright((F.shiftright("g", 8).bitwiseAND(0xFFFF) * 40503).bitwiseAND(0xFFFF), 9).cast("int")
    return counted.withColumn("slice", part).repartition("lang", "half", "slice").groupBy("lang", "half", "slice", "g").agg(F.sum("n").alias("n"))


def slice_of(g: np.ndarray) -> np.ndarray:
    return ((g >> U(8) & U(0xFFFF)) * U(40503) & U(0xFFFF)) >> U(9)


def lower(g: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams of that order, how many longer grams end so), from the distinct grams of the order above, sorted."""
    return np.unique(g & U((1 << 8 * order) - 1), return_counts=True)


def _few_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


def _gather(table: pa.Table) -> pa.Table:
    """A slice's counts as sorted arrays; the numbers of counts 1 to 4 in orders five, four, three; its share of order two."""
    g, n = np.asarray(table["g"]).astype(U), np.asarray(table["n"])
    order = np.argsort(g)
    g, n = g[order], n[order]
    k4, n4 = lower(g, 4)
    k3, n3 = lower(k4, 3)
    k2, n2 = lower(k3, 2)
    one = lambda x, t: pa.array([x], t)
    names = ["lang", "half", "slice"]
    return pa.table(
        [
            *[table[x].slice(0, 1).combine_chunks() for x in names],
            one(g.tobytes(), pa.binary()),
            one(n.astype(np.int64).tobytes(), pa.binary()),
            one([*_few_counts(n), *_few_counts(n4), *_few_counts(n3)], pa.list_(pa.int64())),
            one(k2.astype(np.int64), pa.list_(pa.int64())),
            one(n2, pa.list_(pa.int64())),
        ],
        [*names, "g", "n", "few", "k2", "n2"],
    )


def discounts(few: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    m1, m2, m3, m4 = (float(x) for x in few)
    y = m1 / (m1 + 2 * m2) if m1 else 0.0
    # without enough counts to estimate from, a usual fixed discount
    d = [i - (i + 1) * y * after / m if m and y else 0.5 * i for i, (m, after) in enumerate(((m1, m2), (m2, m3), (m3, m4)), 1)]
    return np.clip(d, 0.05, np.arange(1, 4) - 0.05)


def interpolated(k: np.ndarray, n: np.ndarray, d: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities, contexts, their back-off weights) of sorted grams; below: of each the probability of the shorter gram."""
    context, at = np.unique(k >> U(8), return_inverse=True)
    off = d[np.minimum(n, 3) - 1]
    total = np.bincount(at, n, len(context))
    back = np.bincount(at, off, len(context)) / total
    return (n - off) / total[at] + back[at] * below, context, back


def _ground(table: pa.Table) -> pa.Table:
    """Of a language's half: discounts of orders five, four, three, and order two interpolated, a row of 256 for each byte that
    a gram has before its last, and one for all other bytes."""
    few = np.sum([x for x in table["few"].to_pylist()], 0)
    both = np.zeros(1 << 16, np.int64)
    for k, n in zip(table["k2"], table["n2"]):
        both[np.asarray(k.values)] += np.asarray(n.values)
    k2 = np.flatnonzero(both).astype(U)
    k1, n1 = lower(k2, 1)
    p1, _, rest = interpolated(k1, n1, discounts(np.array(_few_counts(n1))), np.full(len(k1), 1 / 256))
    plain = np.full(256, rest[0] / 256)
    plain[k1.astype(int)] = p1
    n2 = both[k2.astype(int)]
    p2, before, back = interpolated(k2, n2, discounts(np.array(_few_counts(n2))), plain[(k2 & U(255)).astype(int)])
    rows = np.concatenate([back[:, None] * plain, plain[None]])
    rows[np.searchsorted(before, k2 >> U(8)), (k2 & U(255)).astype(int)] = p2
    one = lambda x, t: pa.array([x], t)
    d = np.concatenate([discounts(few[i : i + 4]) for i in (0, 4, 8)])
    return pa.table(
        [
            table["lang"].slice(0, 1).combine_chunks(),
            table["half"].slice(0, 1).combine_chunks(),
            one(d, pa.list_(pa.float64())),
            one(before.astype(np.uint8).tobytes(), pa.binary()),
            one(rows.tobytes(), pa.binary()),
        ],
        ["lang", "half", "d", "before", "p2"],
    )


def two(before: np.ndarray, rows: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Values of order two for the last two bytes of grams."""
    row = np.full(256, len(before))
    row[before] = np.arange(len(before))
    return rows[row[(g >> U(8) & U(255)).astype(int)], (g & U(255)).astype(int)]


def units(p: np.ndarray) -> np.ndarray:
    return np.rint(np.log2(p) * 1e6).astype(np.int32)


ARRAYS = [f"{x}{k}" for k in (5, 4, 3) for x in "kpxb"]


def _model_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's counts with its language's ground to sorted arrays: of each order grams, logarithms, contexts, weights."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {x: batch.column(batch.schema.get_field_index(x))[i].as_py() for x in ("lang", "half", "slice", "g", "n", "d", "before", "p2")}
            k5, n5 = np.frombuffer(row["g"], U), np.frombuffer(row["n"], np.int64)
            k4, n4 = lower(k5, 4)
            k3, n3 = lower(k4, 3)
            d = np.array(row["d"]).reshape(3, 3)
            p3, x3, b3 = interpolated(k3, n3, d[2], two(np.frombuffer(row["before"], np.uint8), np.frombuffer(row["p2"]).reshape(-1, 256), k3))
            p4, x4, b4 = interpolated(k4, n4, d[1], p3[np.searchsorted(k3, k4 & U(0xFFFFFF))])
            p5, x5, b5 = interpolated(k5, n5, d[0], p4[np.searchsorted(k4, k5 & U(0xFFFFFFFF))])
            arrays = [x.tobytes() for k, p, x, b in ((k5, p5, x5, b5), (k4, p4, x4, b4), (k3, p3, x3, b3)) for x in (k, units(p), x, units(b))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["lang"]]),
                    pa.array([row["half"]], pa.int32()),
                    pa.array([row["slice"]], pa.int32()),
                    *[pa.array([x], pa.binary()) for x in arrays],
                ],
                ["lang", "half", "slice", *ARRAYS],
            )


def slot(lang, half):
    """The folder of a language's half."""
    return F.concat(F.sha2(lang, 256), F.lit("-"), half.cast("string"))


class Store:
    """The finished model: tables below `path`, in folders by slot, read by the tasks; or held, where Python cannot read there."""

    def __init__(self, spark, path: str, parts: int, most_bytes: int, most_held: int = 128 << 20):
        self.path, self.parts, self.most_bytes, self.held = path, parts, most_bytes, None
        if not tx.python_reads(path):
            model = spark.read.parquet(f"{path}/slices")
            size = model.agg(F.sum(sum(F.octet_length(x) for x in ARRAYS))).first()[0] or 0
            if size > most_held:
                raise RuntimeError(f"Python cannot read {path}, and the model has {size} bytes, over {most_held}, to be broadcast")
            self.held = {x: spark.read.parquet(f"{path}/{x}").toArrow() for x in ("slices", "ground")}

    def rows(self, table: str, lang: str, half: int) -> pa.Table | None:
        import hashlib

        import pyarrow.compute as pc

        name = f"{hashlib.sha256(lang.encode()).hexdigest()}-{half}"
        if self.held is not None:
            found = self.held[table].filter(pc.equal(self.held[table]["slot"], name))
            return found if found.num_rows else None
        return tx.python_table(f"{self.path}/{table}/slot={name}")

    def load(self, lang: str, half: int, part: int) -> "Model | None":
        slices = self.rows("slices", lang, half)
        if slices is None:
            return None
        mine = slices.filter(pa.array(np.asarray(slices["slice"]) % self.parts == part))
        ground = self.rows("ground", lang, half).to_pylist()[0]
        return Model(mine, ground)


class Model:
    def __init__(self, slices: pa.Table, ground: dict):
        self.orders = []
        for k in (5, 4, 3):
            arrays = []
            for keys, values in ((f"k{k}", f"p{k}"), (f"x{k}", f"b{k}")):
                key, value = (np.concatenate([np.zeros(0, t), *[np.frombuffer(x, t) for x in slices[name].to_pylist()]]) for name, t in ((keys, U), (values, np.int32)))
                order = np.argsort(key)
                arrays += [key[order], value[order]]
            self.orders.append((k, *arrays))
        self.before, self.p2 = np.frombuffer(ground["before"], np.uint8), units(np.frombuffer(ground["p2"]).reshape(-1, 256))
        self.size = sum(x.nbytes for o in self.orders for x in o[1:]) + self.p2.nbytes

    def score(self, g: np.ndarray) -> np.ndarray:
        """log2 of the probability of each gram's last byte after the others, in millionths; back-off where a gram is unseen."""
        out, todo = np.zeros(len(g), np.int64), np.arange(len(g))
        for k, keys, values, contexts, weights in self.orders:
            q = g[todo] & U((1 << 8 * k) - 1)
            at, there = find(keys, q)
            out[todo[there]] += values[at[there]]
            todo, q = todo[~there], q[~there] >> U(8)
            at, there = find(contexts, q)
            out[todo[there]] += weights[at[there]]
        out[todo] += two(self.before, self.p2, g[todo])
        return out


def find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether q is there) in sorted keys."""
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return at, keys[at] == q


#: Models that this worker holds, by path, language, half and part; the oldest go first.
_models: dict[tuple, "Model | None"] = {}


def model_for(store: Store, lang: str, half: int, part: int) -> Model | None:
    """The other half's model; the half's own if the other has none."""
    for h in (1 - half, half):
        name = (store.path, lang, h, part)
        if name not in _models:
            got = store.load(lang, h, part)
            while _models and sum(m.size for m in _models.values() if m) + (got.size if got else 0) > store.most_bytes:
                _models.pop(next(iter(_models)))
            _models[name] = got
        if _models[name] is not None:
            return _models[name]
    return None


def kneser_ney(counts: DataFrame, most_bytes: int = 256 << 20) -> Store:
    """The model of count_grams(); see the module's text."""
    spark = counts.sparkSession
    key = "lang string, half int"
    gathered = tx.written(
        counts.groupBy("lang", "half", "slice").applyInArrow(
            _gather,
            f"{key}, slice int, g binary, n binary, few array<long>, k2 array<long>, n2 array<long>",
        ),
        "kn-slices",
    )
    path = tx.shared_dir(spark, "kn-model")
    ground = gathered.select("lang", "half", "few", "k2", "n2").groupBy("lang", "half").applyInArrow(_ground, f"{key}, d array<double>, before binary, p2 binary")
    named = lambda df: df.withColumn("slot", slot(F.col("lang"), F.col("half"))).write.partitionBy("slot")
    named(ground).parquet(f"{path}/ground")
    ground = spark.read.schema(ground.schema).parquet(f"{path}/ground")
    # a row of it has half a MB at most
    ground = F.broadcast(ground) if ground.count() <= 128 else ground
    model = gathered.select("lang", "half", "slice", "g", "n").join(ground, ["lang", "half"]).mapInArrow(
        _model_batches,
        f"{key}, slice int, " + ", ".join(f"{x} binary" for x in ARRAYS),
    )
    named(model).parquet(f"{path}/slices")
    size = spark.read.schema(
        T.StructType([*model.schema.fields, T.StructField("slot", T.StringType())])
    ).parquet(f"{path}/slices").groupBy("slot").agg(
        F.sum(sum(F.octet_length(x) for x in ARRAYS)).alias("n")
    ).agg(F.max("n")).first()[0] or 0
    return Store(spark, path, min(SLICES, max(1, math.ceil(size / (most_bytes // 4)))), most_bytes)


def _score_batches(batches: Iterator[pa.RecordBatch], store: Store) -> Iterator[pa.RecordBatch]:
    for batch in tx.pieces(batches, most=(2 if store.parts == 1 else 16) << 20):
        data, offs = tx.utf8(batch.column(1))
        spans = tx.words(data, offs)
        base = base_counts(data, offs, spans)
        upto = np.concatenate([[0], np.cumsum(LEXICAL[data])])
        lexical = tx.sums((upto[spans[1]] > upto[spans[0]]).astype(np.int64), spans[2])
        g, bound = grams(data, spans)
        log2p = np.zeros(len(g), np.int64)
        for (lang, half), mine in _by_model(batch.column(2), batch.column(3)):
            at = np.flatnonzero(np.repeat(mine, np.diff(bound)))
            for part in range(store.parts) if len(at) else ():
                here = at if store.parts == 1 else at[slice_of(g[at]) % U(store.parts) == part]
                if len(here):
                    log2p[here] = model_for(store, lang, half, part).score(g[here])
        columns = [batch.column(0), batch.column(2).fill_null(""), *[pa.array(x.astype(np.int64)) for x in (*base, lexical, tx.sums(log2p, bound))]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", *[x.split()[0] for x in BASE.split(", ")], "n_lexical", "log2p"])


def score(docs: DataFrame, store: Store) -> DataFrame:
    """doc_id, lang, the base counts, lexical words, and log2p in millionths of every row."""
    tx.arrow_batches(docs.sparkSession)
    return halved(docs, "doc_id", "text", "lang").mapInArrow(lambda b: _score_batches(b, store), f"doc_id long, lang string, {BASE}, n_lexical long, log2p long")


def few_languages(df: DataFrame) -> DataFrame:
    """A table of one small row a language: broadcast where it is small (a large language would else be one hot key)."""
    return F.broadcast(df) if df.limit(50_001).count() <= 50_000 else df


def bands(scored: DataFrame, spread: float, margin: float) -> DataFrame:
    """(lang, mid, half) from exact medians of bits per lexical word, in steps of 1/256 bit, over all documents."""
    steps = F.round(F.col("bits") * 256)
    good = scored.where(~F.col("base_failed") & F.col("bits").isNotNull()).select("lang", steps.alias("v"))
    mid = few_languages(tx.written(good.groupBy("lang").agg(F.percentile("v", F.lit(0.5)).alias("mid")), "kn-mid"))
    off = good.join(mid, "lang").groupBy("lang").agg(F.first("mid").alias("mid"), F.percentile(F.abs(F.col("v") - F.col("mid")), F.lit(0.5)).alias("off"))
    return few_languages(
        tx.written(
            off.select(
                "lang",
                (F.col("mid") / 256).alias("mid"),
                F.greatest(1.4826 * spread * F.col("off") / 256, F.lit(margin)).alias("half"),
            ),
            "kn-bands",
        )
    )


def quality_rules(docs: DataFrame, spread: float = 5.0, margin: float = 0.5, short: int = 50, most_bytes: int = 256 << 20) -> DataFrame:
    """One row per document: the base counts, base_failed, perplexity (per lexical word), the band for its language and length,
    and kept. short: at so many lexical words the band is sqrt(2) times as wide as for very long texts."""
    store = kneser_ney(count_grams(docs), most_bytes)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    bits = F.when(F.col("n_lexical") > 0, -F.col("log2p") / 1e6 / F.col("n_lexical"))
    scored = tx.written(score(docs, store).withColumn("base_failed", failed).withColumn("bits", bits), "kn-scored")
    half = F.col("half") * F.sqrt(F.lit(1.0) + float(short) / F.greatest(F.col("n_lexical"), F.lit(1)))
    kept = ~F.col("base_failed") & F.coalesce(F.abs(F.col("bits") - F.col("mid")) <= half, F.lit(False))
    power = lambda x, name: F.pow(F.lit(2.0), x).alias(name)
    return scored.join(bands(scored, spread, margin), "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), power(F.col("bits"), "perplexity"), power(F.col("mid") - half, "least"), power(F.col("mid") + half, "most")
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(tx.table(spark, sf_dir, "documents"))
