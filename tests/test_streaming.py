"""A crawl that feeds itself against the batch crawl; live progress."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import crawl
from auditlake.sources import html
from auditlake.streaming import incremental, progress
from auditlake.streaming.crawl import PROVIDER, StreamCrawl

HOST = "h.example"


def graph(spark, n=40):
    rng = np.random.default_rng(3)
    host = lambda i: HOST if i % 9 else "other.example"
    edges = {(int(a), int(b)) for a, b in zip(rng.integers(0, n, 2 * n), rng.integers(0, n, 2 * n))} | {(k, k + 1) for k in range(1, 5)}
    page = lambda i: f"https://{host(i)}/{i}"
    return spark.createDataFrame([(page(a), page(b)) for a, b in sorted(edges)], "source string, target string"), page(1)


def test_stream_crawl_equals_reach(spark, tmp_path):
    """The same URLs at the same depths, over cycles, several parents and a host that is not admitted; settings as before."""
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    links, seed = graph(spark)
    links.write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    seeds = spark.createDataFrame([(seed,)], "url string")
    want = {tuple(r) for r in crawl.reach(seeds, links, HOST).collect()}
    assert len(want) >= 20 and max(d for _, d in want) >= 4
    before = spark.conf.get(PROVIDER, None)
    expand = lambda fresh: fresh.join(links, F.col("url") == F.col("source")).select(F.col("target").alias("url"), F.lit(False).alias("in_sitemap"))
    run = StreamCrawl(spark, str(tmp_path / "crawl"), HOST, expand)
    run.feed(seeds.select("url", F.lit(0).alias("depth"), F.lit(False).alias("in_sitemap")))
    assert {(r.url, r.depth) for r in run.run().collect()} == want
    assert spark.conf.get(PROVIDER, None) == before
    # a sitemap that names a known URL, a new one and one of another host arrives later: the state is that of the checkpoint
    known, new = sorted(u for u, d in want if d == 2)[0], f"https://{HOST}/from-a-sitemap"
    again = StreamCrawl(spark, str(tmp_path / "crawl"), HOST, expand)
    mapped = spark.createDataFrame([(known,), (new,), ("https://other.example/9",)], "url string")
    again.feed(mapped.select("url", F.lit(0).alias("depth"), F.lit(True).alias("in_sitemap")))
    got = {r.url: (r.depth, r.in_sitemap) for r in again.run().collect()}
    assert got[known] == (2, True) and got[new] == (0, True) and len(got) == len(want) + 1 and sum(m for _, m in got.values()) == 2


def test_progress_is_published(spark, tmp_path):
    """Pages, issues and the end, from the stream's own metrics; a subscriber that fails is dropped, the others go on."""
    body = "<title>T</title><p>few words"
    rows = [(1, f"http://site.example/{i}", 404 if i % 2 else 200, {"Content-Type": ["text/html"]}, body, 0, 900, i, True, False, False) for i in range(6)]
    spark.createDataFrame(rows, html.RESPONSE).write.parquet(str(tmp_path / "in"))
    broker, told, other = progress.Broker(), [], []

    def fails(message):
        other.append(message)
        raise RuntimeError("gone")

    broker.subscribe("crawl-1", fails)
    broker.subscribe("crawl-1", told.append)
    broker.subscribe("crawl-2", pytest.fail)
    listener = progress.publish_progress(spark, broker)
    try:
        issues = incremental.issue_stream(incremental.response_stream(spark, str(tmp_path / "in")))
        query = incremental.write_issues(issues, str(tmp_path / "out"), str(tmp_path / "ck"), "crawl-1")
        query.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.read.parquet(str(tmp_path / "out")).count()
    finally:
        spark.streams.removeListener(listener)
    by = {m["name"]: m for m in told}
    assert by["pages"] == {"name": "pages", "pages": 6, "ok": 3, "noindex": 0, "depth": 5}
    assert by["issues"] == {"name": "issues", "issues": found} and found > 10
    assert told[-1]["name"] == "end" and told[-1]["error"] is None and told[-1]["pages"] == 6 and told[-1]["issues"] == found
    assert len(other) == 1  # the first message was its last


def test_broker():
    broker, got = progress.Broker(), []
    one = broker.subscribe("t", got.append)
    assert broker.publish("t", {"n": 1}) == 1 and broker.publish("u", {"n": 2}) == 0
    broker.unsubscribe("t", one)
    assert broker.publish("t", {"n": 3}) == 0 and got == [{"n": 1}]
