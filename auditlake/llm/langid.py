"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of 256 bytes, all of them, the last padded with zero bytes. Each byte has a trained vector; filters
of several widths run over the vectors, each filter keeps its maximum over the window, and a softmax layer turns the maxima
into language probabilities. A text's probabilities are the byte-weighted geometric mean over its windows.

Training takes a bounded sample of labelled texts (`per_language` texts a language, `per_text` windows spread evenly over
each whole text), drawn by a hash of doc_id, and runs on the driver; prediction runs in Arrow batches of windows. A filter
over bytes is a sum of table rows, so the network is applied through tables of byte pairs instead of dense products.

Defined results: `und` with score 0 for a null or empty text, one without a letter, or where nothing was learned; repeated
rows are predicted each; ties go to the first language in order; an empty table gives no rows; extra columns stay, and never
meet the operator's own, which get a fresh name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm import text as tx

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def cut_windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, owner, length): all windows of all texts, the index of the text of each, and its bytes without padding."""
    n = -(-np.diff(offs) // WINDOW)
    owner = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = offs[:-1][owner] + k * WINDOW
    length = np.minimum(WINDOW, offs[1:][owner] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    out = np.zeros(at.shape, np.uint8)
    out[inside] = data[at[inside]]
    return out, owner, length


class Network:
    def __init__(self, languages: list[str], dim: int = 8, filters: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (256, dim)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, (w * dim) ** -0.5, (w, dim, filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * filters, len(languages))).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy of a batch."""
        p, n, rows = self.p, len(x), np.arange(len(x))[:, None]
        v = p["e"][x]
        top, best, pooled = [], [], []
        for w in WIDTHS:
            m = WINDOW - w + 1
            z = sum(v[:, j : j + m] @ p[f"k{w}"][j] for j in range(w)) + p[f"b{w}"]
            a = z.argmax(1)
            t = np.take_along_axis(z, a[:, None], 1)[:, 0]
            top.append(t), best.append(a), pooled.append(np.maximum(t, 0))
        f = np.concatenate(pooled, 1)
        q = np.exp(log_softmax(f @ p["o"] + p["c"]))
        q[np.arange(n), y] -= 1
        q /= n
        g = {"o": f.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
        back = q @ p["o"].T
        at = 0
        for w, t, a in zip(WIDTHS, top, best):
            width = t.shape[1]
            d = back[:, at : at + width] * (t > 0)
            at += width
            g[f"b{w}"] = d.sum(0)
            g[f"k{w}"] = np.empty_like(p[f"k{w}"])
            for j in range(w):
                seen = x[rows, a + j]  # only the window's maximum passes a gradient back
                g[f"k{w}"][j] = np.einsum("nfd,nf->df", p["e"][seen], d)
                np.add.at(g["e"], seen, d[:, :, None] * p[f"k{w}"][j].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 600, batch: int = 64, rate: float = 0.005, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        by = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        for t in range(1, steps + 1):
            pick = np.concatenate([rng.choice(r, -(-batch // len(by))) for r in by])  # languages count alike
            for k, g in self.step(x[pick], y[pick]).items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                self.p[k] -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        return self

    def tables(self) -> "Network":
        """Filters as table rows by byte pair; built where the network is used."""
        p = self.p
        row = {w: [p["e"] @ p[f"k{w}"][j] for j in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        self.t = {w: [pair(*row[w][j : j + 2]) if j + 1 < w else row[w][j] for j in range(0, w, 2)] for w in WIDTHS}
        return self

    def log_probabilities(self, windows: np.ndarray, chunk: int = 128) -> np.ndarray:
        out = []
        for lo in range(0, len(windows), chunk):
            x = np.ascontiguousarray(windows[lo : lo + chunk].T)
            pairs = (x[:-1].astype(np.int32) << 8) | x[1:]
            pooled = []
            for w in WIDTHS:
                m = WINDOW - w + 1
                z = self.t[w][0].take(pairs[:m], axis=0)
                for i, tab in enumerate(self.t[w][1:], 1):
                    z += tab.take((pairs if len(tab) == 65536 else x)[2 * i : 2 * i + m], axis=0)
                pooled.append(np.maximum(z.max(0) + self.p[f"b{w}"], 0))
            out.append(log_softmax(np.concatenate(pooled, 1) @ self.p["o"] + self.p["c"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _sample_batches(batches: Iterator[pa.RecordBatch], per_text: int) -> Iterator[pa.RecordBatch]:
    for batch in tx.pieces(batches):
        windows, owner, length = cut_windows(*tx.utf8(batch.column(1)))
        first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        n = np.diff(first)
        k = np.minimum(n, per_text)
        doc = np.repeat(np.arange(len(n)), k)
        i = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
        at = first[:-1][doc] + i * n[doc] // np.maximum(k[doc], 1)
        at = at[length[at] >= 32]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(owner[at])),
                batch.column(2).take(pa.array(owner[at])),
                pa.array([windows[j].tobytes() for j in at], pa.binary()),
            ],
            ["doc_id", "lang", "w"],
        )


def train(docs: DataFrame, per_language: int = 1500, per_text: int = 4, steps: int = 600, most_languages: int = 500) -> Network | None:
    """A network from docs(doc_id, text, lang) whose rows are not held out and have a lang; None without any.

    per_language and per_text bound what reaches the driver: at most about per_language * per_text windows a language."""
    tx.arrow_batches(docs.sparkSession)
    labelled = tx.only(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = labelled.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(min(1.0, per_language / r["count"]) * (1 << 30)))])
    drawn = labelled.where(F.xxhash64(F.coalesce("doc_id", F.lit(0))).bitwiseAND((1 << 30) - 1) < share[F.col("lang")])
    rows = drawn.mapInArrow(lambda b, n=per_text: _sample_batches(b, n), "doc_id long, lang string, w binary").limit(3 * per_language * per_text * len(counts)).toArrow()
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows["w"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    lang = np.array(rows["lang"].to_pylist(), object)
    order = np.lexsort((np.array([hash_bytes(r) for r in x], np.uint64), np.array(rows["doc_id"].fill_null(-1)), lang.astype(str)))
    languages = sorted(set(lang))
    index = {k: i for i, k in enumerate(languages)}
    return Network(languages).fit(x[order], np.array([index[k] for k in lang[order]]), steps)


def hash_bytes(row: np.ndarray) -> int:
    import zlib

    return zlib.crc32(row.tobytes())


def _predict_batches(batches: Iterator[pa.RecordBatch], net: Network | None, names: list[str], text_at: int) -> Iterator[pa.RecordBatch]:
    if net is not None:
        net.tables()
    for batch in tx.pieces(batches, names[text_at]):
        n = batch.num_rows
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        letters = np.asarray(batch.column(len(names)))
        if net is not None and letters.any():
            windows, owner, length = cut_windows(*tx.utf8(batch.column(text_at)))
            logs = net.log_probabilities(windows).astype(np.float64) * length[:, None]
            first = np.searchsorted(owner, np.arange(n + 1))
            total = np.stack([tx.sums(logs[:, k], first) for k in range(logs.shape[1])], 1)
            size = tx.sums(length, first)
            mean = np.exp(log_softmax(total / np.maximum(size, 1)[:, None]))
            best = mean.argmax(1)
            lang = np.where(letters, np.array(net.languages, object)[best], UNKNOWN)
            score = np.where(letters, mean[np.arange(n), best], 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0))], [*names, "\0lang", "\0score"])


def predict(docs: DataFrame, net: Network | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, named `lang` and `score`; docs must not have those names."""
    if {lang.lower(), score.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"{lang} and {score} are taken; give other names")
    tx.arrow_batches(docs.sparkSession)
    names = docs.columns
    wide = docs.withColumn("\0letter", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    schema = T.StructType([*docs.schema.fields, T.StructField("\0lang", T.StringType()), T.StructField("\0score", T.DoubleType())])
    at = names.index("text")
    out = wide.mapInArrow(lambda b: _predict_batches(b, net, names, at), schema)
    return out.withColumnRenamed("\0lang", lang).withColumnRenamed("\0score", score)


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = tx.table(spark, sf_dir, "documents")
    return predict(tx.only(docs, "doc_id", "text"), train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.35) -> DataFrame:
    """First pipeline stage: documents in no learned language, or in one with a probability under `least`, go."""
    kept = predict(docs, train(docs), "\0lang_pred", "\0lang_score").where((F.col("`\0lang_pred`") != UNKNOWN) & (F.col("`\0lang_score`") >= least))
    return kept.select(*docs.columns)
