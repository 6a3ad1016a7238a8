"""Vectorised text primitives shared by the operators: one Arrow batch of strings is seen as one UTF-8 byte buffer with
offsets, and words, lines, hashes and sums per document are found by whole-array numpy steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.shared import shared_dir, written  # noqa: F401

U = np.uint64
#: Any odd base works: it has an inverse modulo 2**64, so a window hash does not depend on where the window lies.
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 2**64))
#: White space that parts words: 0x20 and 0x09-0x0D, as the contracts say.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 1 << 22:  # those of very long texts are not kept
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: polynomial sums have weak low bits."""
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """s[i] = sum of x[j] * BASE**j for j < i, so that hashes(s, a, b) costs the same for any window."""
    s = np.empty(len(x) + 1, U)
    s[0] = 0
    np.cumsum(x * powers(len(x)), out=s[1:])
    return s


def hashes(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of the windows [starts, ends) of what prefix_sums() saw."""
    if not len(starts):
        return np.zeros(0, U)
    return mix((s[ends] - s[starts]) * powers(int(starts.max()) + 1, BASE_INV)[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words, and for each text the index of its first word, with an end mark."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = IS_SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offs[:-1][offs[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def owners(first: np.ndarray) -> np.ndarray:
    """For each element the index of the text that owns it, from the first indices with an end mark."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values for each text; zero for a text without any."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text; a longer text comes alone and whole."""
    for batch in batches:
        _, offs = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def arrow_batches(spark: SparkSession) -> None:
    """Rows can be very long, so a batch for Python is bounded by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and no other: extra columns, whatever their names, never meet an operator's own."""
    return docs.select(*[docs[x] for x in names])


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A table of small rows: broadcast it if it has at most `most` rows, or leave it to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(x.getPath().getName() for x in files.listStatus(at))


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def python_reads(path: str) -> bool:
    """Whether Python processes can read below a shared path without Spark."""
    from pyarrow import fs

    try:
        files, name = _files(path)
        return files.get_file_info(name).type != fs.FileType.NotFound
    except (pa.ArrowException, OSError, ValueError):
        return False


def python_table(path: str) -> pa.Table | None:
    """A Parquet folder of the shared folder; None if there is none."""
    from pyarrow import fs
    from pyarrow import parquet

    files, name = _files(path)
    if files.get_file_info(name).type == fs.FileType.NotFound:
        return None
    parts = sorted(x.path for x in files.get_file_info(fs.FileSelector(name)) if x.path.endswith(".parquet"))
    return pa.concat_tables([parquet.ParquetFile(files.open_input_file(x)).read() for x in parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, at, to): the words one space apart, with a space at the end, and where each word lies in that buffer."""
    at = starts - np.concatenate([[0], np.cumsum(starts[1:] - ends[:-1])])[: len(starts)] + np.arange(len(starts))
    to = at + (ends - starts)
    out = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
    if len(to):
        # what is not a separator goes on in order
        mark = np.zeros(len(out) + 1, bool)
        mark[to] = True
        out[~mark[:-1]] = data[~IS_SPACE[data]]
    return out, at, to
