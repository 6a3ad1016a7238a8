"""The inverted index of URLs, and language tags."""

import zlib

import pytest
from pyspark.sql import functions as F

from auditlake.functions.languages import registry, valid_tag
from auditlake.operators import reports, search


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "urls")
    host = lambda i: "shop" if i % 3 else "blog"
    rows = [(1 + i % 2, i, f"https://{host(i)}.example/{'shoes' if i % 5 == 0 else 'item'}/{'red' if i % 7 == 0 else 'x'}{i}", i % 10 != 9) for i in range(600)]
    rows += [(1, 900, "https://blog.example/shoes/red", True), (1, 901, "https://blog.example/shoes-shoes/red", True), (1, 902, None, True)]
    pages = spark.createDataFrame(rows, "crawl_id long, id long, url string, crawled boolean")
    search.write_index(pages, path)
    return path, pages


@pytest.mark.parametrize("term", ["shoes red", "https://blog.example/shoes/red", "SHOP", "no such word", "the www", ""])
def test_search_equals_the_scan(spark, index, term):
    path, pages = index
    got = [(r.id, r.url) for r in search.search(spark, path, term).collect()]
    want = [(r.id, r.url) for r in reports.search(pages, term).where("url IS NOT NULL").collect()] if term else []
    assert got == want
    assert search.page_count(spark, path, term).first().pages == -(-len(want) // 25)
    one = [r.id for r in search.search(spark, path, term, 1).collect()]
    assert one == [r.id for r in reports.search(pages.where("crawl_id = 1"), term).where("url IS NOT NULL").collect() if term]


def test_relevance(spark, index):
    """Pages with both words come before those with the rarer one, and those before the rest; an exact URL is first."""
    path, _ = index
    found = search.search(spark, path, "shoes red", 1, by_relevance=True).collect()
    has = [("shoes" in r.url.split("/")[3], r.url.endswith("/red")) for r in found]
    assert has[:2] == [(True, True)] * 2 and not any(all(x) for x in has[2:])
    exact = search.search(spark, path, "https://blog.example/shoes/red", 1, by_relevance=True).first()
    assert exact.id == 900


def test_a_search_reads_its_buckets_only(spark, index):
    path, _ = index
    plan = search.search(spark, path, "shoes red")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "In(token" in plan
    scan = search._of(spark, path, "shoes red", None)
    scan.collect()
    metrics = scan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    read = {name: metrics.apply(name).value() for name in ("numFiles", "numOutputRows")}
    buckets = {zlib.crc32(w.encode()) % search.BUCKETS for w in ("shoes", "red")}
    held = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(sorted(buckets))).count()
    whole = spark.read.parquet(f"{path}/postings").count()
    assert read["numFiles"] <= len(buckets) * search.SALTS and 0 < read["numOutputRows"] <= held < whole / 5


VALID = "en EN en-US en_us pt-BR zh-cmn-Hans-CN zh-Hant sr-Latn-RS de-CH-1996 sl-rozaj-biske es-419 x-own en-x-own de-u-co-phonebk iw cmn gsw eng und i-klingon zh-min-nan ar-arb no en-u-ca-gregory-x-a".split()
INVALID = ["", "xx", "xx-zz", "e1", " en", "en ", "en-", "-en", "english", "en-USA-x", "en-Hoax", "en-997", "en-notavari", "en--US", "en-cmn", "a", "i-nothing", "x-", "en-u", "zh-Hans-Hant", "en US"]


def test_language_tags(spark):
    rows = spark.createDataFrame([(x, True) for x in VALID] + [(x, False) for x in INVALID], "tag string, want boolean")
    wrong = rows.withColumn("got", F.expr(valid_tag("tag"))).where("got <> want OR got IS NULL").collect()
    assert not wrong, wrong
    known = registry()
    assert len(known["language"]) > 7000 and {"en", "cmn", "qaa"} <= known["language"] and "hans" in known["script"] and "419" in known["region"] and "1996" in known["variant"]
