"""Filter interaction audit: what each of five filters removes in every order in which they can be applied.

A scan of Arrow buffers reads each text once: a table of byte classes and prefix sums count words, capitals and symbols, sorted
word hashes, verified by bytes, give the distinct words, and a text is left with a mask of the filters that it fails. Texts
travel no further than that: copies are found by a digest (SHA-256) of the text, and masks are counted by part, mask and labels,
at most 128 rows a part. All 120 orders are then sums over those counts.

The failures: A: under 200 words; B: 100 x distinct words < 50 x words; C: 100 x [A-Z] > 3 x code points; D: any of #$%&*|; E: the
text is that of a smaller doc_id, too, anywhere in the table.

Defined results: a null text is an empty one (it fails A, and E if a smaller doc_id's text is empty or null); a null lang and an
empty one are the part ''; a null doc_id is neither smaller nor greater than another, so it never fails E nor makes another fail;
rows that repeat a doc_id count one by one, and of the rows of the least doc_id with a text none fails E; a doc_id that labels
hold several times is good if any of its rows has quality 1, toxic if any has toxic 1; an empty table gives no rows; columns
besides doc_id, text and lang are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import text as tx
from auditlake.llm.lexicon import word_numbers

FILTERS = "ABCDE"
CAPITAL, SYMBOL, INNER = 1, 2, 4
#: Classes of a byte: [A-Z], [#$%&*|], and those that go on with a code point.
CLASSES = np.zeros(256, np.uint8)
CLASSES[65:91] = CAPITAL
CLASSES[list(b"#$%&*|")] = SYMBOL
CLASSES[0x80:0xC0] = INNER
ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def masks(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text the filters A to D that it fails, A as the lowest bit."""
    kind = CLASSES[data]
    capitals, symbols, inner = (tx.sums(kind == x, offs) for x in (CAPITAL, SYMBOL, INNER))
    points = np.diff(offs) - inner
    starts, ends, first = tx.words(data, offs)
    n = np.diff(first)
    distinct = word_numbers(data, starts, ends, first)[1]
    fails = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * points, symbols > 0)
    return sum(x.astype(np.int32) << i for i, x in enumerate(fails))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.pieces(batches):
        data, offs = tx.utf8(batch.column(2))
        buf = memoryview(data)
        digests = [hashlib.sha256(buf[a:b]).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        part = batch.column(1).fill_null("")
        yield pa.RecordBatch.from_arrays([batch.column(0), part, pa.array(masks(data, offs), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, mask of the filters before it) of every step of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(FILTERS[x] for x in order), step, 1 << i, before))
            before |= 1 << i
    return out


def _reduce(counts: pa.Table) -> pa.Table:
    """All orders of one part from its counts (part, mask, good, toxic, n)."""
    mask, n = np.asarray(counts["mask"]), np.asarray(counts["n"])
    total = np.bincount(mask, n, 32).astype(np.int64)
    good, toxic = (np.bincount(mask, n * np.asarray(counts[c]), 32).astype(np.int64) for c in ("good", "toxic"))
    steps = orders()
    bit, before = (np.array([x[i] for x in steps])[:, None] for i in (2, 3))
    every = np.arange(32)[None, :]
    fails, passed = every & bit > 0, every & before == 0
    removed = (fails & passed) @ total
    letter = np.log2(bit[:, 0]).astype(int)
    columns = {
        "part": [counts["part"][0].as_py()] * len(steps), "filter_order": [x[0] for x in steps], "step": np.array([x[1] for x in steps], np.int32),
        "kept": (passed & ~fails) @ total, "removed": removed, "redundant": (fails & ~passed) @ total, "unique_fails": (every == bit) @ total,
        "good_lost": (fails & passed) @ good, "toxic_lost": (fails & passed) @ toxic, "shapley": np.bincount(letter, removed, len(FILTERS)).astype(np.int64)[letter],
    }
    return pa.table(columns)


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every row of docs(doc_id, text, lang): mask has a bit for each filter that fails."""
    tx.arrow_batches(docs.sparkSession)
    scanned = tx.written(tx.only(docs, "doc_id", "lang", "text").mapInArrow(_scan, "doc_id long, part string, mask int, digest binary"), "audit-masks")
    # the least doc_id of each text: counted before the shuffle, and met again under text and doc_id, so copies are never one group
    least = scanned.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marked = tx.only(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    both = scanned.join(least, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
    return both.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; see the module's text for defined results."""
    counts = failing(docs, labels).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    return counts.groupBy("part").applyInArrow(_reduce, ROWS)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(tx.table(spark, sf_dir, "documents"), tx.table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
marked AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN marked ON w.doc_id = marked.doc_id),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit,
  count(*) FILTER (mask & (bit | before) = 0) AS kept, count(*) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
  count(*) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, count(*) FILTER (mask = bit) AS unique_fails,
  count(*) FILTER (mask & bit > 0 AND mask & before = 0 AND good) AS good_lost, count(*) FILTER (mask & bit > 0 AND mask & before = 0 AND toxic) AS toxic_lost
  FROM f, s GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
