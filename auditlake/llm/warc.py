"""WARC archives with revisit resolution.

write_archives() lays every page as a WARC/1.1 response record into gzip archives; read_archives() parses archives back by
their Content-Length fields. resolve() shuffles record headers only, by payload digest: the least page_id of equal payloads
is the response, the others refer to it. write_deduplicated() takes each archive with the decisions on its records, by their
ordinals, and rewrites it where it lies: a revisit has a fresh header and no payload. So payloads are never shuffled. Files
are written and read by Spark's own connectors, so any store that Spark reaches will do.

Spark's text sink writes a string column's bytes as they are, followed by the line separator: a record minus its last line
feed, with "\\n" as separator, is the record itself. An archive is one gzip stream. Records go to folders by size class, each
with a bound on the records of a file, so an archive holds about 64 MB of payload at most, or one larger record.

Defined results: a null html is an empty payload; payloads under `least` bytes never revisit; a null url has an empty
target URI; repeated page_ids give a record each (with equal payloads all of them are the response); a null page_id is
written as an empty id and is a response that none refers to; an empty table writes archives without records; columns besides
page_id, url and html are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import text as tx

#: (payload bytes up to, records of a file)
CLASSES = ((64 << 10, 1000), (1 << 20, 64), (16 << 20, 4), (1 << 40, 1))
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, date string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, ordinal long, payload binary"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in parts])


def _record(page_id: Column, url: Column, payload: Column, date: str) -> Column:
    """A whole response record as binary, less its last line feed. Line breaks in a URL cannot break the header."""
    target = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", "")
    http = F.encode(_text(HTTP, F.octet_length(payload), "\r\n\r\n"), "utf-8")
    block = F.concat(http, payload)
    head = _text(
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:", page_id, ">\r\nWARC-Target-URI: ", target,
        f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha256:", F.sha2(payload, 256),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length(block), "\r\n\r\n",
    )
    return F.concat(F.encode(head, "utf-8"), block, F.lit(b"\r\n\r"))


def _write(records: DataFrame, path: str, kind: int) -> None:
    rows = records.select(F.col("record").cast("string").alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", CLASSES[kind][1]).text(f"{path}/class={kind}")


def write_archives(pages: DataFrame, path: str, date: str | None = None) -> None:
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = tx.only(pages, "page_id", "url", "html").withColumn("payload", F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b"")))
    size = F.octet_length("html")
    kind = F.lit(len(CLASSES) - 1)
    for i in reversed(range(len(CLASSES) - 1)):
        kind = F.when(F.coalesce(size, F.lit(0)) <= CLASSES[i][0], i).otherwise(kind)
    found = sorted(r[0] for r in rows.select(kind).distinct().collect()) or [0]
    for i in found:
        of = rows if found == [i] else rows.where(kind == i)
        _write(of.select(_record(F.col("page_id"), F.col("url"), F.col("payload"), date).alias("record")), path, i)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], memoryview, memoryview]]:
    """(header fields, block, whole record) of each record of an archive's bytes, plain or gzip with any number of members."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(raw) + z.flush())
        raw = z.unused_data
    data = b"".join(out) if out else raw
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[at:end].decode("utf-8").split("\r\n")[1:])
        size = int(fields["Content-Length"])
        stop = end + 4 + size + 4
        yield fields, view[end + 4 : stop - 4], view[at:stop]
        at = stop


def _page(value: str) -> int | None:
    value = value.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def _read_batches(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in map(str.split, RECORD.split(", "))])
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows: list[tuple] = []
            held = 0
            for ordinal, (fields, block, _) in enumerate(parse(content.as_py())):
                body, size = http_head(block)
                revisit = fields["WARC-Type"] == "revisit"
                rows.append(
                    (
                        _page(fields["WARC-Record-ID"]),
                        fields["WARC-Target-URI"],
                        fields["WARC-Date"],
                        fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                        size,
                        fields["WARC-Type"],
                        _page(fields["WARC-Refers-To"]) if revisit else None,
                        file,
                        ordinal,
                        bytes(block[body:]) if with_payload else None,
                    )
                )
                held += len(block) if with_payload else 0
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)


def http_head(block: memoryview) -> tuple[int, int]:
    """(where the payload begins, its length). A revisit keeps the HTTP header of its original, so the length is known without it."""
    http = bytes(block[:256])
    body = http.index(b"\r\n\r\n") + 4
    return body, int(http[:body].lower().rsplit(b"content-length: ", 1)[1].split(b"\r\n", 1)[0])


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the archives below `path`. A row is a whole archive, so the batches are bounded by their bytes."""
    tx.arrow_batches(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below `path`; the payload is null unless asked for."""
    return _archives(spark, path).mapInArrow(lambda b, w=with_payload: _read_batches(b, w), RECORD)


def resolve(headers: DataFrame, least: int = 100) -> DataFrame:
    """headers with record_type and refers_to decided anew, and the URI and date of the record that a revisit refers to. The
    groups of copies are met by a count and a minimum, which combine before the shuffle; only digests that occur twice or more
    are joined back, by a broadcast if they are few."""
    of = headers.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    first = of.groupBy("payload_digest").agg(F.min(F.struct("page_id", "url", "date")).alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = headers.drop("record_type", "refers_to").join(tx.few(tx.written(first, "warc-originals"), 100_000), "payload_digest", "left")
    revisits = F.coalesce(F.col("page_id") != F.col("original.page_id"), F.lit(False)) & (F.col("payload_bytes") >= least)
    return joined.select(
        *[x for x in joined.columns if x != "original"], F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        *[F.when(revisits, F.col(f"original.{x}")).alias(name) for x, name in (("page_id", "refers_to"), ("url", "refers_uri"), ("date", "refers_date"))],
    )


def revisit(fields: dict[str, str], block: memoryview, refers_to: int, uri: str | None, date: str) -> bytes:
    """A revisit record for a response's record: nothing of the payload is written, its length stays in the HTTP header."""
    http = bytes(block[: http_head(block)[0]])
    kept = [f"{x}: {fields[x]}" for x in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest")]
    refers = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {uri or ''}", f"WARC-Refers-To-Date: {date}"]
    lines = [
        "WARC/1.1",
        "WARC-Type: revisit",
        *kept,
        f"WARC-Profile: {PROFILE}",
        *refers,
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http)}",
        "",
        "",
    ]
    return "\r\n".join(lines).encode() + http + b"\r\n\r\n"


def _rewrite_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, marks in zip(batch.column(0), batch.column(1)):
            of = {m["ordinal"]: m for m in marks.as_py() or ()}
            rows: list[bytes] = []
            held = 0
            for ordinal, (fields, block, whole) in enumerate(parse(content.as_py())):
                m = of.get(ordinal)
                rows.append((revisit(fields, block, m["refers_to"], m["refers_uri"], m["refers_date"]) if m else bytes(whole))[:-1])
                held += len(rows[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])


def write_deduplicated(spark: SparkSession, source: str, decisions: DataFrame, path: str) -> None:
    """The archives below `source`, as write_archives() laid them, with the revisits among the decisions (by file and ordinal)."""
    marks = decisions.where("record_type = 'revisit'").groupBy("file").agg(F.collect_list(F.struct("ordinal", "refers_to", "refers_uri", "refers_date")).alias("marks"))
    marks = tx.written(marks, "warc-marks")
    # an archive has 1,000 records at most, so a row of marks is small
    marks = tx.few(marks, 200)
    for kind in sorted(int(x.removeprefix("class=")) for x in tx.folders(spark, source) if x.startswith("class=")):
        files = _archives(spark, f"{source}/class={kind}")
        _write(files.join(marks, "file", "left").select("content", "marks").mapInArrow(_rewrite_batches, "record binary"), path, kind)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Write archives, read them back, resolve revisits, write the deduplicated archives, and report what those hold."""
    first, second = tx.shared_dir(spark, "warc"), tx.shared_dir(spark, "warc-dedup")
    write_archives(tx.table(spark, sf_dir, "pages"), first)
    decisions = tx.written(resolve(read_archives(spark, first, with_payload=False).drop("payload")), "warc-decisions")
    write_deduplicated(spark, first, decisions, second)
    return read_archives(spark, second, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to
FROM d
"""
