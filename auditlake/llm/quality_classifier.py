"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector w over hashed text features serves all grades, and ordered
thresholds theta part them. Features are presence of hashed tokens: lower-cased words, their first four bytes, and runs of
punctuation, in 2**18 buckets; a text's features are scaled by its number of distinct ones. Training takes a bounded sample
of rated documents (`most_rated`, drawn by a hash of doc_id) and runs in numpy on the driver; scoring is one pass over whole
texts. The score's expected grade and its tail probability P(grade >= selected) come from the same fitted curve.

The grades of the `labels` table are 0 (toxic), 1 (quality 0) and 2 (quality 1); of several ratings of one document the
least counts.

Defined results: a null or empty text has no feature and gets the grade of the thresholds alone; ratings of absent documents,
and null ratings, are not used; without any rating nothing is learned: grade and tail are null and every row is kept; texts of
any length are read whole; repeated rows are scored each; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import text as tx
from auditlake.llm.simhash import LOWER

U = np.uint64
BITS = 18
#: 0: white space, 1: letters, digits and bytes of other alphabets, 2: punctuation
CLASS = np.full(256, 1, np.uint8)
CLASS[:128] = 2
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
CLASS[tx.IS_SPACE] = 0


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): the distinct feature buckets of each text."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    kind = CLASS[data]
    cut = np.concatenate([[True], kind[1:] != kind[:-1]])
    cut[offs[:-1][offs[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    s = tx.prefix_sums(LOWER[data])
    own = np.searchsorted(offs, starts, "right") - 1
    word = kind[starts] == 1
    head = word & (ends - starts > 4)
    h = np.concatenate([tx.hashes(s, starts, ends), tx.hashes(s, starts[head], starts[head] + 4) ^ U(0x5851F42D4C957F2D)])
    key = (np.concatenate([own, own[head]]).astype(np.int64) << BITS) | (tx.mix(h) >> U(64 - BITS)).astype(np.int64)
    key = np.unique(key)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(n + 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ordinal:
    def __init__(self, grades: int):
        self.w = np.zeros(1 << BITS, np.float32)
        self.theta = np.linspace(-1, 1, grades - 1) if grades > 1 else np.zeros(0)

    @staticmethod
    def scale(first: np.ndarray) -> np.ndarray:
        return 1 / np.sqrt(np.maximum(np.diff(first), 16) / 16)

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return tx.sums(self.w[buckets].astype(np.float64), first) * self.scale(first)

    def below(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every k."""
        return np.concatenate([sigmoid(self.theta[None] - scores[:, None]), np.ones((len(scores), 1))], 1)

    def fit(
        self,
        texts: list[np.ndarray],
        grade: np.ndarray,
        epochs: int = 12,
        batch: int = 128,
        rate: float = 0.15,
        decay: float = 3e-3,
        least_texts: int = 10,
        seed: int = 5,
    ) -> "Ordinal":
        """Likelihood ascent with adaptive steps; grades count alike. Thresholds stay in order."""
        rng = np.random.default_rng(seed)
        # a bucket that too few of the texts have says nothing yet, and would only be learned by heart
        common = np.bincount(np.concatenate([*texts, np.zeros(0, np.int32)]).astype(np.int64), minlength=len(self.w)) >= least_texts
        texts = [t[common[t]] for t in texts]
        weight = len(grade) / np.maximum(np.bincount(grade, minlength=len(self.theta) + 1), 1)[grade]
        weight /= weight.mean()
        g2, t2 = np.full(len(self.w), 1e-4, np.float32), np.full(len(self.theta), 1e-4)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                n = np.array([len(texts[i]) for i in pick])
                first = np.concatenate([[0], np.cumsum(n)])
                buckets = np.concatenate([texts[i] for i in pick])
                y, scale = grade[pick], self.scale(first)
                cum = np.concatenate([np.zeros((len(pick), 1)), self.below(self.scores(buckets, first))], 1)
                rows = np.arange(len(pick))
                high, low = cum[rows, y + 1], cum[rows, y]
                p = np.maximum(high - low, 1e-9)
                dh, dl = high * (1 - high), low * (1 - low)
                push = weight[pick] / len(pick)
                ds = (dh - dl) / p * push  # of the negative log likelihood by the score
                gw = np.bincount(buckets, np.repeat(ds * scale, n), len(self.w)).astype(np.float32) + decay / len(pick) * self.w
                gt = np.zeros(len(self.theta) + 2)
                np.add.at(gt, y + 1, -dh / p * push)
                np.add.at(gt, y, dl / p * push)
                g2 += gw * gw
                self.w -= rate * gw / np.sqrt(g2)
                if len(self.theta):
                    gt = gt[1:-1]
                    t2 += gt * gt
                    self.theta = np.sort(self.theta - rate * gt / np.sqrt(t2))
        return self


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.pieces(batches):
        buckets, first = features(*tx.utf8(batch.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(buckets))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["doc_id", "grade", "buckets"])


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels(doc_id, quality, toxic)."""
    rated = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic = 1)")
    return rated.groupBy("doc_id").agg(F.min(F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)).alias("grade"))


def train(docs: DataFrame, rated: DataFrame, most_rated: int = 12_000) -> Ordinal | None:
    """rated: (doc_id, grade). most_rated bounds the sample, about; it is small enough to be sent to every task. Of the texts of a
    doc_id that repeats the least one is taken, so the sample has a text a rating at most."""
    spark = docs.sparkSession
    tx.arrow_batches(spark)
    n = rated.count()
    if not n:
        return None
    drawn = rated.where(F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) < int(min(1.0, most_rated / n) * (1 << 30))).limit(2 * most_rated)
    met = tx.only(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = met.select("doc_id", "text", "grade").mapInArrow(
        _feature_batches,
        "doc_id long, grade int, buckets array<int>",
    ).toArrow()
    if not rows.num_rows:
        return None
    lists = rows["buckets"].combine_chunks()
    first = np.asarray(lists.offsets)
    buckets = np.asarray(lists.values, np.int32)
    order = np.lexsort((np.diff(first), np.asarray(rows["doc_id"])))
    texts = [buckets[a:b] for a, b in zip(first, first[1:])]
    grade = np.asarray(rows["grade"])
    return Ordinal(int(grade.max()) + 1).fit([texts[i] for i in order], grade[order])


def _score_batches(batches: Iterator[pa.RecordBatch], model: Ordinal | None, selected: int) -> Iterator[pa.RecordBatch]:
    for batch in tx.pieces(batches):
        n = batch.num_rows
        if model is None:
            expected = tail = pa.array([None] * n, pa.float64())
        else:
            below = model.below(model.scores(*features(*tx.utf8(batch.column(1)))))
            expected = pa.array((1 - below[:, :-1]).sum(1))
            tail = pa.array(1 - below[:, selected - 1] if 0 < selected < below.shape[1] else np.full(n, float(selected <= 0)))
        yield pa.RecordBatch.from_arrays([batch.column(0), expected, tail], ["doc_id", "expected_grade", "tail"])


def classify(docs: DataFrame, model: Ordinal | None, selected: int = 2, least: float = 0.25) -> DataFrame:
    """doc_id, expected_grade, tail = P(grade >= selected), kept = tail >= least (or nothing was learned)."""
    tx.arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = tx.only(docs, "doc_id", "text").mapInArrow(lambda b: _score_batches(b, sent.value, selected), "doc_id long, expected_grade double, tail double")
    return out.withColumn("kept", F.coalesce(F.col("tail") >= least, F.lit(True)))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = tx.table(spark, sf_dir, "documents")
    return classify(docs, train(docs, grades(tx.table(spark, sf_dir, "labels"))))
