"""The HTTP data source: many hosts at once, each at its pace."""

import http.server
import threading
import time
from collections import defaultdict

import pytest

from auditlake.sources import fetch


@pytest.fixture(scope="module")
def hosts():
    """One server on several loopback addresses, which are as many hosts; the times at which each was asked."""
    asked = defaultdict(list)

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.headers["Host"]].append(time.monotonic())
            body = f"<title>{self.path}</title>".encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("0.0.0.0", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield [f"127.0.0.{i}:{server.server_port}" for i in range(1, 9)], asked
    server.shutdown()


def asked_rows(spark, hosts, n):
    return spark.createDataFrame([(1, f"http://{h}/{k}", 0, False) for h in hosts for k in range(n)], "crawl_id long, url string, depth int, in_sitemap boolean")


@pytest.mark.parametrize("tasks", [1, 8])
def test_many_hosts_at_once(spark, hosts, tasks):
    """Eight hosts, six pages each, 0.3 s between two requests to a host: all are asked side by side, even by one task, and none
    faster than its pace."""
    names, asked = hosts
    asked.clear()
    client = fetch.Client(delay=0.3, jitter=0.05, tasks=tasks)
    got = {r.url: (r.status_code, r.body) for r in fetch.fetch(asked_rows(spark, names, 6), client).collect()}
    assert len(got) == 48 and all(v == (200, f"<title>/{u.rpartition('/')[2]}</title>") for u, v in got.items())
    times = [t for x in asked.values() for t in x]
    assert len(asked) == 8 and len(times) == 48
    for at in asked.values():
        at.sort()
        assert min(b - a for a, b in zip(at, at[1:])) > 0.28
    # one after the other they would take 8 x 5 x 0.3 = 12 s
    assert max(times) - min(times) < 8
    both = sum(a[0] < b[-1] and b[0] < a[-1] for a in asked.values() for b in asked.values() if a is not b)
    assert both >= 30


def test_source_reads_a_folder(spark, hosts, tmp_path):
    from pyspark.sql import functions as F

    names, _ = hosts
    asked_rows(spark, names[:2], 2).withColumn("host", F.split("url", "/")[2]).write.parquet(str(tmp_path / "asked"))
    spark.dataSource.register(fetch.HttpSource)
    df = spark.read.format("http").option("path", f"file://{tmp_path}/asked").option("client", '{"delay": 0, "jitter": 0}').load()
    assert df.where("status_code = 200").count() == 4 and [f.name for f in df.schema][:3] == ["crawl_id", "url", "status_code"]


def test_paces_by_a_clock_of_its_own():
    """No waiting for a host while another one may be asked; memory holds AHEAD rows at most."""
    now, log, pulled = [0.0], [], [0]

    def rows():
        for k in range(40_000):
            pulled[0] += 1
            yield {"host": "a" if k % 4 else f"h{k % 100}", "k": k}

    def ask(row):
        log.append((now[0], row["host"], row["k"]))
        assert pulled[0] - len(log) <= fetch.AHEAD
        now[0] += 0.01
        return row

    def sleep(s):
        now[0] += s

    out = sum(1 for _ in fetch.polite(rows(), ask, 0.05, 0.0, lambda: now[0], sleep))
    assert out == 40_000 == len({k for *_, k in log})
    by = defaultdict(list)
    for t, h, k in log:
        by[h].append((t, k))
    for at in by.values():
        assert min(b[0] - a[0] for a, b in zip(at, at[1:])) >= 0.05 - 1e-9 and [k for _, k in at] == sorted(k for _, k in at)


def test_nothing_to_ask(spark):
    assert fetch.fetch(asked_rows(spark, [], 0)).count() == 0
