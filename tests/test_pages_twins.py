"""Queries over `pages` against their SQL, on pages that share a URL or have other references in their titles."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import TABLES, same

from auditlake.plans.queries import QUERIES, SQL
from auditlake.sources.html import parse

SF = "/root/testdata/sf0.001"
TITLES = ["One", "Two", "a &quot;b&quot; &amp;&amp;", "cut &amp", "&amp;lt; &lt;i&gt; &#65; &eacute;", "  spaces  "]
URLS = ["https://a.example/x", "https://a.example/x", "https://a.example/y", "http://b.example/", "https://a.example/x", "https://c.example/?q=1"]


@pytest.fixture(scope="module")
def own_pages(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    for t in TABLES:
        if t != "pages":
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    html = [f'<!DOCTYPE html>\n<html lang="en">\n<head><title>{t}</title></head><body>' + "<a href=\"/l\">l</a>" * i + "</body></html>" for i, t in enumerate(TITLES)]
    pq.write_table(pa.table({"page_id": list(range(len(URLS))), "url": URLS, "html": html}), folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["archive_offsets", "extract_links", "extract_title"])
def test_shared_urls_and_other_references(spark, own_pages, name):
    ok, got, want = same(spark, QUERIES[name], SQL[name], own_pages)
    assert ok, (got, want)


def test_record_reads_all_references_of_a_title():
    page = parse({"url": "http://a.example/", "status_code": 200, "headers": {"content-type": ["text/html"]}, "body": "<title> a &quot;b&quot; &amp </title>"})
    assert (page["title"], page["dom"]["title_source"]) == ('a "b" &', " a &quot;b&quot; &amp ")
