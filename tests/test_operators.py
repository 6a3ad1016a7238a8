"""Graph fixture, parser, crawl, archive, exports and streaming on small rows of our own."""

import pytest
from pyspark.sql import functions as F

from auditlake.functions.urls import resolve
from auditlake.issue_types import ROWS
from auditlake.operators import archive, crawl, exports, graph_rules, page_rules, reports
from auditlake.sources import html, wacz

PAGE = """<!DOCTYPE html><html lang="en"><head><title> A &amp; B </title><meta name="description" content="d"><link rel="canonical" href="/c"><link rel="alternate" hreflang="fr" href="/fr">
<base href="http://site.example/dir/"><style>p{background:url('x.png')}</style></head><body><h1>H <b>one</b></h1><p>one, two three</p><a href="p?q=1#f" rel="nofollow">go</a><a href="https://other.example/">out</a>
<a href="mailto:x@y">m</a><img src="i.png" srcset="a.png 1x, b,c.png 2x"><picture><source srcset="s.png"></picture><video poster="v.jpg"><source src="v.mp4"></video><script src="s.js">var words</script><form action="http://f.example/"></form></body></html>"""


def record(body=PAGE, url="http://site.example/", status=200, **headers):
    return html.parse(
        {
            "url": url,
            "status_code": status,
            "headers": {"Content-Type": ["text/html"], **{k: [v] for k, v in headers.items()}},
            "body": body,
            "content_length": 0,
        }
    )


def test_parser():
    r = record()
    assert (r["title"], r["description"], r["lang"], r["h1"], r["words"]) == ("A & B", "d", "en", "H one", 5)
    assert [x["url"] for x in r["links"]] == ["http://site.example/dir/p"] and r["links"][0]["nofollow"]
    assert [x["url"] for x in r["external_links"]] == ["https://other.example/"]
    assert [x["url"].rpartition("/")[2] for x in r["images"]] == ["i.png", "a.png", "b,c.png"]
    assert r["dom"]["picture_without_img"] and r["dom"]["img_missing_size"] and r["dom"]["form_actions"] == ["http://f.example/"]
    assert r["videos"][0]["poster"].endswith("v.jpg") and r["dom"]["css_urls"] and r["canonical"]


def test_parser_edges():
    assert record("")["words"] == 0
    assert record("x", status=301, Location="/to")["redirect_url"] == "http://site.example/to"
    assert record('<meta http-equiv="refresh" content="0;url=/n">')["redirect_url"] == "http://site.example/n"
    assert record('<meta http-equiv="refresh" content="0;x">')["redirect_url"] == ""
    assert record("<p>unclosed <b>tags")["words"] == 2
    assert html.srcset(" ,a.png, b.png 2x") == ["a.png", "b.png"]


@pytest.mark.parametrize(
    ("ref", "base", "want"),
    [
        ("../a", None, "http://h.example/a"),
        ("b#c", None, "http://h.example/d/b"),
        ("//o.example", None, "http://o.example/"),
        ("mailto:a@b", None, None),
        ("?q=1", None, "http://h.example/d/e?q=1"),
    ],
)
def test_resolve(ref, base, want):
    assert resolve(ref, "http://h.example/d/e", base) == want


def test_records_and_rules(spark):
    rows = [(1, f"http://site.example/{i}", 200, {"Content-Type": ["text/html"]}, body, 0, 900, 5, True, False, i == 2) for i, body in enumerate([PAGE, None, ""])]
    pages = html.page_records(spark.createDataFrame(rows, html.RESPONSE)).withColumn("id", F.xxhash64("url"))
    found = {(r.url[-1], r.issue_type_id) for r in pages.join(page_rules.page_issues(pages), pages.id == F.col("pagereport_id")).collect()}
    assert {("0", 7), ("0", 36), ("0", 64), ("0", 66), ("0", 70), ("2", 62)} <= found
    assert len(page_rules.page_rules()) == 61 and len(ROWS) == 79 and len({r.code for r in page_rules.page_rules()}) == 61


def test_graph_rules(spark):
    page = "id long, crawl_id long, url string, url_hash string, redirect_hash string, status_code int, media_type string, lang string, title string, description string, canonical string, noindex boolean, crawled boolean, body_hash string"

    def p(i, url, to="", status=200, canonical="", title="t", lang="en", crawl=1, noindex=False):
        return (i, crawl, url, url, to, status, "text/html", lang, title, "d", canonical, noindex, True, "")

    pages = [
        p(1, "a", "b", 301),
        p(2, "b", "c", 301),
        p(3, "c", "b", 301),
        p(4, "s", "s", 301),
        p(5, "x", title="same"),
        p(6, "y", title="same"),
        p(7, "z", title="same", lang="fr"),
        p(8, "a", "b", 301, crawl=2),
        p(9, "n", canonical="m"),
        p(10, "k", canonical="n"),
        p(11, "l", canonical="n"),
    ]
    links = [(5, 1, "y", False), (5, 1, "y", True), (5, 1, "y", True)]
    alternates = [(5, 1, "fr", "x", "z"), (7, 1, "x-default", "z", "z")]
    t = {
        "pagereports": spark.createDataFrame(pages, page),
        "links": spark.createDataFrame(links, "pagereport_id long, crawl_id long, url_hash string, nofollow boolean"),
        "hreflangs": spark.createDataFrame(alternates, "pagereport_id long, crawl_id long, to_lang string, from_hash string, to_hash string"),
    }
    of = {r.code: sorted(x.id for x in r.find(t).collect()) for r in graph_rules.GRAPH_RULES}
    assert of[14] == [1, 2, 3, 4]  # the other crawl's page has no target in its own crawl
    assert of[23] == [2, 3, 4]
    assert of[4] == [5, 6]
    assert of[22] == [9, 9]  # one row for each page that names it
    assert of[26] == [5] and of[34] == [6]
    assert 6 not in of[30] and 5 in of[30]
    assert of[18] == [5]


def test_reports(spark):
    items = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 2), ("e", 1)], "key string, value long")
    assert {tuple(r) for r in reports.top_with_other(items).collect()} == {("a", 5), ("b", 4), ("c", 3), ("Other", 3)}
    assert reports.paginator(2, 3) == {"current": 2, "previous": 1, "next": 3, "total": 3}
    with pytest.raises(ValueError):
        reports.paginator(1, 0, empty_is_valid=False)
    texts = spark.createDataFrame([("ERROR_30x", "Redirect")], "key string, text string")
    issues = spark.createDataFrame([(1, 1, 1), (1, 1, 27)], "pagereport_id long, crawl_id long, issue_type_id int")
    pages = spark.createDataFrame([(1, 1, "u")], "id long, crawl_id long, url string")
    from auditlake.issue_types import issue_types

    assert [
        tuple(r) for r in exports.all_issues(issues, issue_types(spark), pages, texts).collect()
    ] == [("u", "Redirect", "Critical"), ("u", "ERROR_NO_INDEXABLE", "Warning")]


def test_crawl(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    robots = spark.createDataFrame(
        [
            (
                "h.example",
                "User-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: bot\nUser-agent: other\nDisallow: /c$ # end\nSitemap: http://h.example/s.xml",
            )
        ],
        "host string, body string",
    )
    pages = spark.createDataFrame([(f"http://h.example{p}",) for p in ("/a", "/a/b", "/c", "/cd", "/")], "url string")
    blocked = lambda agent: {r.url[16:] for r in crawl.blocked(pages, crawl.robots_rules(robots, agent)).where("robotstxt_blocked").collect()}
    assert blocked("unnamed") == {"/a"} and blocked("bot") == {"/c"}
    assert crawl.robots_sitemaps(robots).first().sitemap == "http://h.example/s.xml"
    edges = [("/", "/1"), ("/1", "/2"), ("/2", "/"), ("/9", "/8")]
    links = spark.createDataFrame(
        [(f"http://h.example{a}", f"http://h.example{b}") for a, b in edges] + [("http://h.example/", "http://o.example/")],
        "source string, target string",
    )
    seeds = spark.createDataFrame([("http://h.example/",)], "url string")
    assert {(r.url[16:], r.depth) for r in crawl.reach(seeds, links, "h.example").collect()} == {("/", 0), ("/1", 1), ("/2", 2)}


def test_archive(spark):
    rows = spark.createDataFrame(
        [
            ("http://a.b.example/x?y", "2026-01-02 03:04:05", "text/html", 200, "d", 0, 9),
            ("http://a.b.example/x?yz", "2026-01-02 03:04:05", "text/html", 200, "d", 9, 9),
        ],
        "url string, ts string, mime string, status int, digest string, offset long, length long",
    )
    index = archive.cdxj_index(rows.withColumn("ts", F.to_timestamp("ts")))
    assert index.first().line.startswith("example,b,a)/x?y 20260102030405 {")
    assert archive.lookup(index, "http://a.b.example/x?y").count() == 1
    raw = spark.createDataFrame(
        [("HTTP/1.1 200 OK\r\nA: 1\r\na: 2\r\n\r\nbody\r\n\r\nmore",)],
        "raw string",
    ).select(archive.parse_http(F.col("raw")).alias("r")).first().r
    assert raw.headers == {"a": ["1", "2"]} and raw.body == "body\r\n\r\nmore"
    to = lambda u: archive.replay_url(u, "http://h.example/d/", 3)
    assert 'href="/replay?pid=3&url=http%3A%2F%2Fh.example%2Fd%2Fx"' in archive.rewrite_html('<a class="k" href="x">', to)
    assert archive.rewrite_css("a{b:url('mailto:x')}", to) == "a{b:url(mailto:x)}"
    assert archive.download_name("http://h.example/a/") == "a.html"


def test_sinks_and_stream(spark, tmp_path):
    urls = spark.createDataFrame([("http://h.example/&",)], "url string")
    exports.write_sitemap(urls, str(tmp_path / "map"))
    assert spark.read.format("xml").option("rowTag", "url").load(str(tmp_path / "map")).first().loc == "http://h.example/&"
    exports.write_csv(urls, str(tmp_path / "csv"))
    from auditlake.streaming import incremental

    rows = spark.createDataFrame([(1, "http://site.example/0", 404, {"Content-Type": ["text/html"]}, PAGE, 0, 900, 5, True, False, False)] * 2, html.RESPONSE)
    rows.write.parquet(str(tmp_path / "in"))
    q = incremental.write_issues(incremental.issue_stream(incremental.response_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("issue_type_id = 2").count() == 1


def test_reach_has_no_depth_limit(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    page = lambda i: f"https://site.example/{i}"
    links = spark.createDataFrame([(page(i), page(i + 1)) for i in range(103)], "source string, target string").coalesce(1).cache()
    got = crawl.reach(spark.createDataFrame([(page(0),)], "url string"), links, "site.example")
    assert got.agg({"depth": "max"}).first()[0] == 103


def test_references_of_a_base():
    page = "https://h.example/a/b?q=1"
    for ref, base, want in (
        ("x", "dir/", "https://h.example/dir/x"), (
            "/page.html",
            "/test",
            "https://h.example/test/page.html",
        ), ("//o.example/x", "/d", "https://h.example/d/x"), (
            "x/",
            "https://o.example",
            "https://o.example/x/",
        ), ("../y?z=1#f", "/d/e", "https://h.example/d/y"),
        (
            "https://o.example/../c",
            "/d",
            "https://o.example/../c",
        ), ("x", None, "https://h.example/a/x"), (
            "//o.example/x",
            None,
            "https://o.example/x",
        ), ("?r", None, "https://h.example/a/b?r"), ("#f", None, "https://h.example/a/b?q=1"),
        ("../../c/./d/", None, "https://h.example/c/d/"), ("mailto:x", None, None), ("", "/d", "https://h.example/d"), ("/", "/d/", "https://h.example/d/"),
    ):
        assert resolve(ref, page, base) == want, (ref, base)
    assert resolve("y", "https://h.example/a//b/x") == "https://h.example/a//b/y"


def test_canonical_falls_back_to_the_header():
    head = {"Content-Type": ["text/html"], "Link": ['<https://h.example/k>; rel="canonical"']}
    of = lambda body: html.parse({"url": "https://h.example/a", "status_code": 200, "headers": head, "body": body})["canonical"]
    two = '<html><head><link rel="canonical" href="/1"><link rel="canonical" href="/2"></head></html>'
    assert of(two) == of('<html><head><link rel="canonical" href="mailto:x"></head></html>') == of("<html>") == "https://h.example/k"
    assert of('<html><head><link rel="canonical" href="/1"></head></html>') == "https://h.example/1"


def test_replay_headers_and_keys(spark):
    df = spark.createDataFrame(
        [
            (
                {"content-type": ["text/html"], "set-cookie": ["a"], "X-Frame-Options": ["DENY"], "expires": ["9"]},
                "https://u:p@sub.h.example:8080/x?y=1",
            )
        ],
        "h map<string,array<string>>, url string",
    )
    got = df.select(archive.replay_headers(F.col("h")).alias("h"), archive.cdxj_key(F.col("url")).alias("key")).first()
    assert got.h == {"content-type": ["text/html"], "cache-control": ["no-store, no-cache, must-revalidate, max-age=0"], "pragma": ["no-cache"], "expires": ["0"]}
    assert got.key == wacz.key("https://u:p@sub.h.example:8080/x?y=1") == "example,h,sub)/x?y=1"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("https://h.example/", 200, {}, "x")], "url string, status_code int, headers map<string,array<string>>, body string")
        assert wacz.records(rows, "2026-01-02T03:04:05Z").first().stamp == "2026-01-02T03:04:05Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_shared_joins_find_the_same_issues(spark):
    from auditlake.plans import fixtures as fx

    t = fx.stored_tables(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(map(tuple, df.collect()))
    alone = [x for r in graph_rules.GRAPH_RULES for x in rows(graph_rules.graph_issues(t, [r]))]
    assert rows(graph_rules.graph_issues(t, graph_rules.GRAPH_RULES)) == sorted(alone) and {r.code for r in graph_rules.GRAPH_RULES} - {c for *_, c in alone} <= {59}
