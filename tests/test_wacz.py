"""The archive in many parts: written by tasks, read by ranges, whole when it appears."""

import hashlib
import json
import zipfile

import pytest

from auditlake.operators import archive
from auditlake.sources import wacz

KIND = "url string, status_code int, headers map<string,array<string>>, body string"
MOMENT = "2026-01-02 03:04:05"


def rows(n):
    url = lambda i: f"http://h{i % 7}.example/{'a b' if i % 5 else 'é'}/{i}" + ("?q=1" if i % 3 else "")
    return [(url(i), 200 + i % 5, {"Content-Type": ["text/html"], "X": ["1", "2"]}, None if i % 11 == 0 else f"body {i} é\r\n\r\n" * (i % 40)) for i in range(n)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wacz") / "x" / "many.wacz")
    data = rows(700)
    assert wacz.write(spark.createDataFrame([*data, (None, 1, None, "x")], KIND), path, MOMENT, parts=3, fanout=8) == 700
    return path, data


def test_zip_and_data_package(made):
    path, _ = made
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and all(x.compress_type == zipfile.ZIP_STORED for x in z.infolist())
        names = z.namelist()
        assert sum(x.startswith("data/") for x in names) == 3 == sum(x.endswith(".cdx") for x in names) and wacz.ROOT in names
        package = z.read(wacz.PACKAGE)
        resources = json.loads(package)["resources"]
        assert {x["path"] for x in resources} == set(names) - {wacz.PACKAGE, wacz.DIGEST}
        for x in resources:
            held = z.read(x["path"])
            assert x["bytes"] == len(held) and x["hash"] == "sha256:" + hashlib.sha256(held).hexdigest()
        assert json.loads(z.read(wacz.DIGEST))["hash"] == "sha256:" + hashlib.sha256(package).hexdigest()
        lines = b"".join(z.read(x) for x in sorted(names) if x.endswith(".cdx")).splitlines()
        assert len(lines) == 700 and lines == sorted(lines)
        pages = [z.read(x).splitlines() for x in sorted(names) if x.startswith("pages/")]
        assert all(json.loads(x[0])["format"] == "json-pages-1.0" for x in pages) and sum(len(x) - 1 for x in pages) == 700


def test_records(made):
    path, data = made
    held = wacz.Archive(path)
    for url, status, _, body in data:
        entry = held.find(url)
        raw = held.bytes(entry["filename"], entry["offset"], entry["length"])
        head, _, rest = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and f"WARC-Target-URI: {url}\r\n".encode() in head
        content = f"HTTP/1.1 {status}\r\nContent-Type: text/html\r\nX: 1\r\nX: 2\r\n\r\n{body or ''}".encode()
        assert rest == content + b"\r\n\r\n" and f"Content-Length: {len(content)}".encode() in head
        assert entry["digest"] == "sha-256:" + hashlib.sha256((body or "").encode()).hexdigest() and entry["status"] == str(status)
        assert wacz.read(path, url) == content
    assert held.find("http://h1.example/none") is None and held.find("http://h1.example/a b/1?q=1&x") is None and held.find("a://zz/") is None


def test_a_lookup_reads_one_block_a_level(made):
    """Blocks of 8 lines: 88 blocks, 11 of the next level, 2 of the root's level and the root, whatever else the archive holds."""
    path, data = made
    with zipfile.ZipFile(path) as z:
        longest = max(len(x) for n in z.namelist() if n.startswith("indexes/") for x in z.read(n).splitlines()) + 1
        whole = sum(x.file_size for x in z.infolist() if x.filename.startswith("indexes/"))
    for url, *_ in data[::50]:
        held = wacz.Archive(path)
        held.find(url)
        assert 0 < held.read_bytes <= 4 * 8 * longest < whole / 4


def test_two_blocks_at_most(spark, tmp_path):
    """With the usual fanout two blocks lead to any of up to 65,536 records."""
    path = str(tmp_path / "two.wacz")
    data = rows(1500)
    wacz.write(spark.createDataFrame(data, KIND), path, MOMENT)
    with zipfile.ZipFile(path) as z:
        root, lines = z.read(wacz.ROOT), z.read(wacz.INDEX).splitlines(keepends=True)
    most = max(sum(map(len, lines[i : i + wacz.FANOUT])) for i in range(0, len(lines), wacz.FANOUT))
    for url, *_ in data[::100]:
        held = wacz.Archive(path)
        assert held.find(url)["url"] == url and held.read_bytes <= len(root) + most


def test_index_as_a_table(spark, made):
    path, data = made
    index = wacz.index(spark, path)
    assert index.count() == 700 and archive.lookup(index, data[3][0]).count() == 1
    assert {r.key for r in index.select("key").distinct().collect()} == {wacz.key(x[0]) for x in data}


def test_offsets(spark, made):
    """Prefix sums of the parts' sizes give places that do not depend on the number of parts."""
    _, data = made
    df = spark.createDataFrame(data, KIND)
    got = [sorted(tuple(r) for r in wacz.offsets(wacz.pieces(df, MOMENT, parts=n)[0]).select("url", "position", "length").collect()) for n in (1, 4)]
    assert got[0] == got[1]
    in_order = sorted(got[0], key=lambda x: x[1])
    assert in_order[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(in_order, in_order[1:]))


def test_an_old_archive_stays_until_the_new_one_is_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.wacz")
    wacz.write(spark.createDataFrame(rows(3), KIND), path, MOMENT)
    before = open(path, "rb").read()
    monkeypatch.setattr(wacz.os, "replace", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        wacz.write(spark.createDataFrame(rows(9), KIND), path, MOMENT)
    assert open(path, "rb").read() == before == b"".join(wacz.chunks(path, 100))


def test_large_entries_use_64_bit_headers(tmp_path):
    """The layout alone: an entry of 5 GB, of which nothing is written, and what lies behind it."""
    sums = [type("Sum", (), {"entry": n, "length": size, "crc": 0, "sha256": ""}) for n, size in (("data/a.warc", 5 << 30), ("indexes/b.cdx", 3))]
    begin = wacz._lay_out(str(tmp_path / "big.zip"), sums)
    with zipfile.ZipFile(tmp_path / "big.zip") as z:
        assert [x.file_size for x in z.infolist()][:2] == [5 << 30, 3]
    held = wacz.Archive(str(tmp_path / "big.zip"))
    with open(tmp_path / "big.zip", "r+b") as f:
        f.seek(begin["indexes/b.cdx"])
        f.write(b"xyz")
    assert held.bytes("indexes/b.cdx") == b"xyz"
