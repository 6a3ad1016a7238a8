"""Web archive of a crawl: a zip of WARC records, a sorted CDXJ index, a page list and a data package with digests.

The zip is one file, written by all tasks at once. Responses are sorted by their index lines in range partitions; a task makes the
bytes of its partition's entries (records, index lines, page lines), their checksums, and offsets as running sums. All that is
known of the whole is a row an entry, from which the driver lays out the zip: it writes the headers and the central directory, and
the tasks write their bytes at their places. The file appears under its name when it is complete. So no record, index line or page
passes the driver or one task, and a part has about PART_BYTES of bodies.

The index is read by ranges: its lines lie in blocks of FANOUT, of which levels of lines with the last line, place and length of
each block lead to. A lookup reads one block of each level, so two for up to FANOUT ** 2 records, and three for FANOUT ** 3.

path: on a file system that the driver and all executors mount."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.functions.shared import written
from auditlake.operators.archive import cdxj_key

#: Names of the format's files.
DATA, INDEX, PAGES, PACKAGE, DIGEST = "data/data.warc", "indexes/index.cdx", "pages/pages.jsonl", "datapackage.json", "datapackage-digest.json"
ROOT = "indexes/root.idx"
PAGES_HEADER = b'{"format": "json-pages-1.0", "id": "pages", "title": "All Pages"}\n'
FANOUT = 256
PART_BYTES = 1 << 30
#: kind: data, lines (index and pages), block (of index lines) or sum (an entry as a whole). at: the place in the entry.
PIECE = "kind string, part int, entry string, at long, length long, bytes binary, url string, digest string, crc long, sha256 string"


def archive_path(root: str, project_id: int, host: str) -> str:
    return os.path.join(root, "archive", str(project_id), f"{host}.wacz")


def key(url: str) -> str:
    """As cdxj_key() has it: host labels reversed, a bracket, then the request URI; user and port are left out."""
    parts = urlsplit(url)
    host = re.sub("^.*@|:[0-9]*$", "", parts.netloc)
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def warc_record(url: str, stamp: str, mime: str, content: bytes) -> bytes:
    names = {
        "WARC-Type": "response",
        "WARC-Date": stamp,
        "WARC-Target-URI": url,
        "Content-Type": mime,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{stamp} {url}')}>",
        "Content-Length": len(content),
    }
    clean = lambda v: str(v).replace("\r", " ").replace("\n", " ")
    return b"WARC/1.0\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in names.items()).encode() + b"\r\n" + content + b"\r\n\r\n"


def message(r: dict) -> tuple[bytes, bytes, str]:
    """(HTTP message, body, media type) of a response."""
    headers = {k: list(v or []) for k, v in sorted(r["headers"] or [])}
    body = (r["body"] or "").encode()
    lines = f"HTTP/1.1 {r['status_code'] or 0}\r\n" + "".join(f"{k}: {v}\r\n" for k, vs in headers.items() for v in vs)
    return lines.encode() + b"\r\n" + body, body, next((vs[0] for k, vs in headers.items() if k.lower() == "content-type" and vs), "")


class Entry:
    """The bytes of one entry as they come: place, checksum and digest."""

    def __init__(self, name: str, part: int):
        self.name, self.part, self.size, self.crc, self.sha = name, part, 0, 0, hashlib.sha256()

    def add(self, kind: str, content: bytes, **more) -> dict:
        at, self.size, self.crc = self.size, self.size + len(content), zlib.crc32(content, self.crc)
        self.sha.update(content)
        return {"kind": kind, "part": self.part, "entry": self.name, "at": at, "length": len(content), "bytes": content, **more}

    def whole(self) -> dict:
        return {"kind": "sum", "part": self.part, "entry": self.name, "at": 0, "length": self.size, "crc": self.crc, "sha256": self.sha.hexdigest()}


class Lines:
    """Sorted lines of an index entry, in blocks. A block is known by the key and time of the last index line that it leads to."""

    def __init__(self, entry: Entry, fanout: int):
        self.entry, self.fanout, self.held, self.last = entry, fanout, [], b""

    def add(self, line: bytes, last: bytes) -> Iterator[dict]:
        self.held.append(line)
        self.last = last
        if len(self.held) == self.fanout:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        if self.held:
            row = self.entry.add("lines", b"".join(self.held))
            yield row
            yield row | {"kind": "block", "bytes": self.last}
            self.held = []


def _numbered(name: str, part: int, parts: int) -> str:
    """The entry of a part: as it is if there is one part only."""
    stem, dot, kind = name.rpartition(".")
    return name if parts == 1 else f"{stem}-{part:05d}{dot}{kind}"


def _rows(made: Iterator[dict], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """PIECE rows in batches of about `most` bytes."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    kind = pa.schema([(c, kinds[t]) for c, t in (x.split() for x in PIECE.split(", "))])
    held, size = [], 0
    for row in made:
        held.append(row)
        size += len(row.get("bytes") or b"")
        if size > most or len(held) == 1024:
            yield pa.RecordBatch.from_pylist(held, kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def _part(batches: Iterator[pa.RecordBatch], parts: int, fanout: int) -> Iterator[dict]:
    """The pieces of a partition's entries, from its responses in order."""
    part = TaskContext.get().partitionId()
    data, index, pages = (Entry(_numbered(x, part, parts), part) for x in (DATA, INDEX, PAGES))
    lines, listed = Lines(index, fanout), []
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            for r in batch.slice(at, 32).to_pylist():
                content, body, mime = message(r)
                digest = "sha-256:" + hashlib.sha256(body).hexdigest()
                row = data.add("data", warc_record(r["url"], r["stamp"], mime, content), url=r["url"], digest=digest)
                yield row
                entry = {
                    "url": r["url"], "mime": mime, "status": str(r["status_code"] or 0), "digest": digest, "recordDigest": "sha256:" + hashlib.sha256(content).hexdigest(),
                    "length": row["length"], "offset": row["at"], "filename": data.name,
                }
                begin = f"{r['key']} {r['stamp'].translate(str.maketrans('', '', '-T:Z'))} ".encode()
                yield from lines.add(begin + json.dumps(entry, ensure_ascii=False).encode() + b"\n", begin + b"{")
                listed.append(json.dumps({"url": r["url"], "ts": r["stamp"]}, ensure_ascii=False).encode() + b"\n")
                if len(listed) == 1024 or not pages.size:
                    yield pages.add("lines", (b"" if pages.size else PAGES_HEADER) + b"".join(listed))
                    listed = []
    if data.size:
        yield from lines.flush()
        if listed:
            yield pages.add("lines", b"".join(listed))
        yield from (x.whole() for x in (data, index, pages))


def _level(batches: Iterator[pa.RecordBatch], name: str, parts: int, fanout: int) -> Iterator[dict]:
    """An index entry that leads to the blocks of the level below, which come in order."""
    part = TaskContext.get().partitionId()
    entry = Entry(_numbered(name, part, parts), part)
    lines = Lines(entry, fanout)
    for batch in batches:
        for r in batch.to_pylist():
            line = {"last": r["bytes"].decode(), "filename": r["entry"], "offset": r["at"], "length": r["length"]}
            yield from lines.add(json.dumps(line, ensure_ascii=False).encode() + b"\n", r["bytes"])
    if lines.held or entry.size:
        yield from lines.flush()
        yield entry.whole()


def records(responses: DataFrame, moment: str | None = None) -> DataFrame:
    """What a record is made of: responses(url, status_code, headers, body) that have a URL, with its key and their common time."""
    time = F.current_timestamp() if moment is None else F.lit(moment).cast("timestamp")
    stamp = F.date_format(urls.utc(time), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp")
    return responses.where("url IS NOT NULL").select("url", "status_code", "headers", "body", cdxj_key(F.col("url")).alias("key"), stamp)


def pieces(responses: DataFrame, moment: str | None = None, parts: int | None = None, fanout: int = FANOUT) -> list[DataFrame]:
    """PIECE rows of the records, index and pages of responses(url, status_code, headers, body), and of each further level of the
    index, all stored. moment: the responses' common time, now where not given; parts: by the bodies' bytes where not given."""
    named = records(responses, moment)
    if parts is None:
        parts = max(1, -(-(named.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // PART_BYTES))
    # as the index lines begin, so that they are sorted too
    order = [F.concat_ws(" ", "key", "stamp", F.to_json(F.struct("url"))).alias("line"), F.xxhash64("body")]
    dealt = named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = [written(dealt.mapInArrow(lambda b: _rows(_part(b, parts, fanout)), PIECE), "archive-pieces")]
    while (n := out[-1].where("kind = 'block'").count()) > 1:
        below, name, several = out[-1].where("kind = 'block'"), f"indexes/level-{len(out)}.idx", -(-n // fanout**2)
        name = ROOT if n <= fanout else name
        sorted_ = below.repartitionByRange(several, "part", "at").sortWithinPartitions("part", "at").select("entry", "at", "length", "bytes")
        out.append(written(sorted_.mapInArrow(lambda b, x=name, k=several: _rows(_level(b, x, k, fanout)), PIECE), "archive-level"))
    return out


def offsets(pieces_: DataFrame) -> DataFrame:
    """(url, digest, filename, offset, length, position) of every record: offset in its entry, position among the bytes of all
    records, by prefix sums of the entries' sizes, of which there is one row a part."""
    from pyspark.sql import Window

    sums = pieces_.where(F.col("kind") == "sum").where(F.col("entry").startswith("data/"))
    begin = sums.select("part", (F.sum("length").over(Window.orderBy("part")) - F.col("length")).alias("begin"))
    rows = pieces_.where("kind = 'data'").join(F.broadcast(begin), "part")
    return rows.select("url", "digest", F.col("entry").alias("filename"), F.col("at").alias("offset"), "length", (F.col("begin") + F.col("at")).alias("position"))


def up_to_equals(offsets_: DataFrame) -> DataFrame:
    """offsets() with the position as a sum in the order of the index lines has it, less a record's own length: records of one URL
    have equal lines, so each of them ends where their last one ends. The places in the archive are those of offsets()."""
    from pyspark.sql import Window

    end = F.max(F.col("position") + F.col("length")).over(Window.partitionBy("url"))
    return offsets_.withColumn("position", end - F.col("length"))


def _place(names: dict[str, int], path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: its pieces into the file, at the places of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "r+b") as out:
            for batch in batches:
                for entry, at, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    out.seek(names[entry] + at)
                    out.write(content)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def _lay_out(path: str, sums: list) -> dict[str, int]:
    """Write a zip without its stored bytes: headers, data package and central directory; where each entry's bytes begin."""
    begin: dict[str, int] = {}
    with zipfile.ZipFile(path, "w") as z:
        at = 0
        for r in sums:
            info = zipfile.ZipInfo(r.entry, (1980, 1, 1, 0, 0, 0))
            info.file_size = info.compress_size = r.length
            info.CRC, info.header_offset = r.crc, at
            header = info.FileHeader()
            z.fp.seek(at)
            z.fp.write(header)
            begin[r.entry] = at + len(header)
            at = begin[r.entry] + r.length
            z.filelist.append(info)
            z.NameToInfo[info.filename] = info
        z.fp.truncate(at)
        z.fp.seek(at)
        z.start_dir = at
        found = [{"name": os.path.basename(r.entry), "path": r.entry, "hash": "sha256:" + r.sha256, "bytes": r.length} for r in sums]
        package = json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": found}, indent=2).encode()
        z.writestr(PACKAGE, package)
        z.writestr(DIGEST, json.dumps({"path": PACKAGE, "hash": "sha256:" + hashlib.sha256(package).hexdigest()}, indent=2))
    return begin


def write(responses: DataFrame, path: str, moment: str | None = None, parts: int | None = None, fanout: int = FANOUT) -> int:
    """Write the archive of all responses; the number of records. A file of that name is replaced when the new one is complete."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    made = pieces(responses, moment, parts, fanout)
    every = made[0]
    for level in made[1:]:
        every = every.unionByName(level)
    sums = every.where("kind = 'sum'").select("entry", "length", "crc", "sha256").orderBy("entry").collect()  # a row an entry
    draft = f"{path}.{uuid.uuid4().hex}"
    if not sums:
        none = Entry(INDEX, 0)
        sums = [type("Sum", (), {"entry": x, "length": 0, "crc": 0, "sha256": none.sha.hexdigest()}) for x in (DATA, INDEX)]
    begin = _lay_out(draft, sums)
    kept = every.where("kind IN ('data', 'lines')").select("entry", "at", "bytes")
    kept.mapInArrow(_place(begin, draft), "n long").agg(F.sum("n")).collect()
    os.replace(draft, path)
    return made[0].where("kind = 'data'").count()


def _split(block: bytes) -> list[bytes]:
    return block.removesuffix(b"\n").split(b"\n") if block else []


class Archive:
    """Ranged reads of an archive; `read_bytes` counts what was read of its entries."""

    def __init__(self, path: str):
        self.path, self.read_bytes = path, 0
        with zipfile.ZipFile(path) as z:
            self.entries = {x.filename: x for x in z.infolist()}

    def bytes(self, entry: str, offset: int = 0, length: int | None = None) -> bytes:
        info = self.entries[entry]
        with open(self.path, "rb") as f:
            f.seek(info.header_offset + 26)
            name, extra = struct.unpack("<HH", f.read(4))
            f.seek(name + extra + offset, os.SEEK_CUR)
            out = f.read(info.file_size - offset if length is None else length)
        self.read_bytes += len(out)
        return out

    def lines(self, target: bytes) -> Iterator[bytes]:
        """The index lines from the first that is not before `target` on."""
        while True:
            place = (ROOT if ROOT in self.entries else INDEX, 0, None)
            held = _split(self.bytes(*place))
            while held and held[0].startswith(b'{"last"'):
                refs = [json.loads(x) for x in held]
                at = bisect_left([x["last"].encode() for x in refs], target)
                if at == len(refs):
                    return
                held = _split(self.bytes(refs[at]["filename"], refs[at]["offset"], refs[at]["length"]))
            at = bisect_left(held, target)
            yield from held[at:]
            if ROOT not in self.entries or not held:
                return
            target = held[-1] + b"\0"

    def find(self, url: str) -> dict | None:
        """The index entry of exactly this URL. A key may hold spaces, so the time must follow it."""
        wanted = key(url).encode() + b" "
        for line in self.lines(wanted):
            if not line.startswith(wanted):
                return None
            if line[len(wanted) : len(wanted) + 14].isdigit():
                return json.loads(line[len(wanted) + 15 :])
        return None


def read(path: str, url: str) -> bytes | None:
    """The HTTP message archived for exactly this URL, read by its range; None where there is none."""
    archive = Archive(path)
    entry = archive.find(url)
    if entry is None:
        return None
    return archive.bytes(entry["filename"], entry["offset"], entry["length"]).partition(b"\r\n\r\n")[2][: -len(b"\r\n\r\n")]


def index(spark, path: str) -> DataFrame:
    """(key, line) of the archive's index: each task reads the entries that it gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                lines = [x.decode() for x in _split(archive.bytes(name))]
                for at in range(0, len(lines), 10_000):
                    held = lines[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([x.partition(" {")[0].rpartition(" ")[0] for x in held]), pa.array(held)], ["key", "line"])

    names = [(x,) for x in Archive(path).entries if x.endswith(".cdx")]
    return spark.createDataFrame(names, "entry string").repartition(len(names)).mapInArrow(run, "key string, line string")


def chunks(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The archive's bytes for a download, a bounded piece at a time."""
    with open(path, "rb") as f:
        yield from iter(lambda: f.read(size), b"")


def delete(path: str) -> bool:
    if not os.path.exists(path):
        return False
    os.remove(path)
    return True
