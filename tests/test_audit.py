"""The HTTP source, a live audit of a small local site, its archive, its tables and their retention."""

import base64
import http.server
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from auditlake.functions import settings
from auditlake.operators import archive, crawl, lifecycle
from auditlake.operators.audit import Audit, Options
from auditlake.sources import fetch, html, wacz

SITE = {
    "/": '<html lang="en"><head><title>Home</title></head><body><a href="/a">a</a><a href="/private/x">p</a><a href="/n" rel="nofollow">n</a><a href="http://other.invalid/">o</a><img src="/i.png" alt="i"></body></html>',
    "/a": '<html lang="en"><head><title>Home</title></head><body><a href="/">h</a><a href="/b?x=1#f">b</a><a href="/moved">m</a></body></html>',
    "/b?x=1": '<html><head><meta name="robots" content="noindex"></head><body><a href="/c">c</a></body></html>',
    "/c": "<html><body>deep</body></html>",
    "/map-only": '<html><body><a href="/below">x</a></body></html>',
    "/below": "<html><body>below</body></html>",
    "/robots.txt": "User-agent: *\nDisallow: /private\nSitemap: {root}/index.xml\n",
    "/index.xml": "<sitemapindex><sitemap><loc>{root}/s.xml</loc></sitemap></sitemapindex>",
    "/s.xml": "<urlset><url><loc>{root}/map-only</loc></url><url><loc>{root}/a</loc></url></urlset>",
}


@pytest.fixture(scope="module")
def site():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.command, self.path, self.headers.get("Authorization")))
            root = f"http://127.0.0.1:{self.server.server_port}"
            text = SITE.get(self.path)
            self.send_response(200 if text is not None else 302 if self.path == "/moved" else 404)
            if self.path == "/moved":
                self.send_header("Location", "/c")
            self.send_header("Content-Type", "image/png" if self.path.endswith(".png") else "text/html; charset=utf-8")
            body = (text or "").replace("{root}", root).encode()
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body)

        do_HEAD = do_GET

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_client(site):
    root, asked = site
    host = root.partition("://")[2]
    got = fetch.Client(user="u", password="p", auth_hosts=(host,)).ask("GET", f"{root}/moved")
    assert got["status_code"] == 302 and got["headers"]["Location"] == ["/c"] and got["ttfb"] >= 0 and not got["timeout"]
    assert asked[-1][2] == "Basic " + base64.b64encode(b"u:p").decode()
    fetch.Client(user="u", password="p", auth_hosts=("elsewhere",)).ask("HEAD", f"{root}/a")
    assert asked[-1] == ("HEAD", "/a", None)
    for bad in ("http://127.0.0.1:1/", "ftp://x/", "http://[", "x"):
        assert fetch.Client(timeout=2).ask("GET", bad) | {"ttfb": 0} == {"status_code": 0, "headers": {}, "body": None, "content_length": 0, "ttfb": 0, "timeout": True}


def test_audit(spark, site, tmp_path):
    root, asked = site
    asked.clear()
    run = Audit(spark, str(tmp_path), f"{root}/", 7, fetch.Client(delay=0), Options(crawl_sitemap=True, check_external=True))
    pages = {r.url.removeprefix(root): r for r in run.run().collect()}
    assert {k: (r.depth, r.status_code) for k, r in pages.items() if not r.robotstxt_blocked} == {
        "/": (0, 200),
        "/a": (1, 200),
        "/i.png": (1, 404),
        "/moved": (2, 302),
        "/c": (3, 200),
        "/map-only": (0, 200),
        "/below": (-1, 200),
    }
    assert [k for k, r in pages.items() if r.robotstxt_blocked] == ["/private/x"] and pages["/private/x"].crawled is False
    assert pages["/a"].in_sitemap and not pages["/c"].in_sitemap and pages["/"].external_links[0].status_code == -1
    paths = [p for m, p, _ in asked if m == "GET"]
    assert len(paths) == len(set(paths)) and "/n" not in paths and "/private/x" not in paths
    tables = f"{tmp_path}/tables"
    assert lifecycle.load(spark, tables, "links", 7).where("url LIKE '%/a'").count() == 1
    assert lifecycle.load(spark, tables, "pagereports", 7).count() == 8
    issues = {(r.pagereport_id, r.issue_type_id) for r in lifecycle.load(spark, tables, "issues", 7).collect()}
    assert {(pages["/i.png"].id, 2), (pages["/"].id, 4), (pages["/a"].id, 4)} <= issues and not any(p == pages["/private/x"].id and c == 2 for p, c in issues)
    assert lifecycle.delete_crawls(spark, tables, [7, 8]) >= 5
    responses = spark.read.option("basePath", f"{tmp_path}/responses").parquet(f"{tmp_path}/responses").where("NOT timeout")
    path = wacz.archive_path(str(tmp_path), 1, "site")
    n = wacz.write(responses, path, "2026-01-02 03:04:05")
    assert n == responses.count() and b"<title>Home</title>" in wacz.read(path, f"{root}/a") and wacz.read(path, f"{root}/nowhere") is None


def test_wacz(spark, tmp_path):
    rows = [
        ("http://h.example/a", 200, {"Content-Type": ["text/html"], "X": ["1", "2"]}, "body\r\n\r\nmore é"),
        ("http://h.example/a b", 200, {}, "two"),
        ("http://h.example/ab", 404, None, None),
        (None, 0, None, None),
    ]
    path = str(tmp_path / "x" / "t.wacz")
    assert wacz.write(spark.createDataFrame(rows, "url string, status_code int, headers map<string,array<string>>, body string"), path, "2026-01-02 03:04:05") == 3
    assert wacz.read(path, "http://h.example/a") == "HTTP/1.1 200\r\nContent-Type: text/html\r\nX: 1\r\nX: 2\r\n\r\nbody\r\n\r\nmore é".encode()
    assert wacz.read(path, "http://h.example/a b").endswith(b"two") and wacz.read(path, "http://h.example/ab").endswith(b"\r\n\r\n") and wacz.read(path, "http://h.example/") is None
    with zipfile.ZipFile(path) as z:
        assert all(x.compress_type == zipfile.ZIP_STORED for x in z.infolist() if x.filename.startswith(("data/", "indexes/")))
        lines = z.read(wacz.INDEX).splitlines()
        assert lines == sorted(lines) and lines[0].startswith(b"example,h)/a 20260102030405 {")
        assert {x["path"] for x in json.loads(z.read(wacz.PACKAGE))["resources"]} == {wacz.DATA, wacz.INDEX, wacz.PAGES}
    assert archive.lookup(wacz.index(spark, path), "http://h.example/a").count() == 1
    assert wacz.delete(path) and not wacz.delete(path)


def test_empty_archive(spark, tmp_path):
    assert wacz.write(spark.createDataFrame([], html.RESPONSE), str(tmp_path / "e.wacz")) == 0
    assert wacz.read(str(tmp_path / "e.wacz"), "http://h.example/") is None


def test_tables_replace_their_own_crawl(spark, tmp_path):
    rows = lambda c, body: spark.createDataFrame(
        [(c, "http://h.example/", 200, {"Content-Type": ["text/html"]}, body, 0, 1, 0, False, False, False)],
        html.RESPONSE,
    )
    records = lambda c, body: html.page_records(rows(c, body)).withColumn("id", F.xxhash64("crawl_id", "url"))
    long = "<h1>" + "é" * 2000 + "</h1>"
    lifecycle.save_crawl(records(1, SITE["/"] + long), str(tmp_path))
    lifecycle.save_crawl(records(2, SITE["/a"]), str(tmp_path))
    lifecycle.save_crawl(records(1, SITE["/"] + long), str(tmp_path))
    pages = lifecycle.load(spark, str(tmp_path), "pagereports")
    assert sorted(r.crawl_id for r in pages.collect()) == [1, 2] and pages.where("crawl_id = 1").first().h1 == "é" * 1021 + "..."
    assert lifecycle.load(spark, str(tmp_path), "links", 1).count() == 3
    lifecycle.delete_crawls(spark, str(tmp_path), [1])
    assert [r.crawl_id for r in lifecycle.load(spark, str(tmp_path), "pagereports").collect()] == [2]


def test_a_table_that_became_empty_stays_empty(spark, tmp_path):
    rows = lambda body: html.page_records(
        spark.createDataFrame(
            [(1, "http://h.example/", 200, {"Content-Type": ["text/html"]}, body, 0, 1, 0, False, False, False)],
            html.RESPONSE,
        )
    ).withColumn("id", F.xxhash64("crawl_id", "url"))
    root = str(tmp_path)
    lifecycle.save_crawl(rows(SITE["/"]), root)
    assert lifecycle.load(spark, root, "images").count() == 1
    lifecycle.save_crawl(rows(SITE["/c"]), root)
    assert lifecycle.load(spark, root, "images").count() == lifecycle.load(spark, root, "links").count() == 0
    issues = spark.createDataFrame([(1, 1, 2), (2, 2, 3)], "pagereport_id long, crawl_id long, issue_type_id int")
    lifecycle.save_issues(issues, root, [1, 2])
    lifecycle.save_issues(issues.where("false"), root, [1])
    assert [r.crawl_id for r in lifecycle.load(spark, root, "issues").collect()] == [2]


def test_crawl_rows(spark, tmp_path):
    from datetime import datetime

    root = str(tmp_path)
    assert lifecycle.crawl_rows(spark, root).count() == 0
    lifecycle.save_crawl_row(spark, root, id=1, project_id=5, url="u", start=datetime(2026, 1, 1))
    lifecycle.save_crawl_row(spark, root, id=2, project_id=5, url="u", start=datetime(2026, 1, 2), issues_end=datetime(2026, 1, 3))
    lifecycle.save_crawl_row(spark, root, id=1, total_urls=9)
    got = {r.id: r for r in lifecycle.crawl_rows(spark, root).collect()}
    assert (got[1].project_id, got[1].total_urls, got[2].total_urls) == (5, 9, None)
    assert [r.id for r in lifecycle.unfinished(lifecycle.crawl_rows(spark, root)).collect()] == [1]
    with pytest.raises(ValueError):
        lifecycle.save_crawl_row(spark, root, id=1, no_such=1)


def test_robots_groups(spark):
    body = "User-agent: bot\nDisallow: /a\n\nUser-agent: bot-news\nDisallow: /n\n\nUser-agent: *\nDisallow: /s\n\nUser-agent: bot-news\nDisallow: /m"
    robots = spark.createDataFrame([("h.example", body)], "host string, body string")
    prefixes = lambda agent: sorted(r.prefix for r in crawl.robots_rules(robots, agent).collect())
    assert prefixes("bot-news") == ["/m", "/n"] and prefixes("Bot/1.0") == ["/a"] and prefixes("other-bot") == ["/s"]
    rules = crawl.robots_rules(spark.createDataFrame([("h.example", "User-agent: *\nDisallow: /q?a=1&b=x+y")], "host string, body string"), "any")
    asked = spark.createDataFrame([(f"http://h.example/q?{q}",) for q in ("b=x%20y&a=1", "a=2&b=x", "")], "url string")
    assert [r.url for r in crawl.blocked(asked, rules).where("robotstxt_blocked").collect()] == ["http://h.example/q?b=x%20y&a=1"]


def test_charsets():
    assert html.decode("é ü".encode("latin1"), "text/html; charset=ISO-8859-1") == "é ü"
    assert html.decode("<meta charset=windows-1251>Привет".encode("cp1251"), "text/html").endswith("Привет")
    assert html.decode('<meta http-equiv="Content-Type" content="text/html; charset=Shift_JIS">日本'.encode("cp932"), "").endswith("日本")
    assert html.decode(b"\xef\xbb\xbfx", "text/html; charset=latin1") == "x" and html.decode("é".encode("utf-16"), "") == "é"
    assert html.decode("naïve".encode(), "") == "naïve" and html.decode("naïve".encode("cp1252"), "text/html; charset=no-such-set") == "naïve"


def test_stop_and_time_limit(spark, site, tmp_path):
    root, _ = site
    short = Audit(spark, str(tmp_path / "a"), f"{root}/", 1, fetch.Client(delay=0), Options(hours=0))
    assert {r.depth for r in short.run().where("crawled").collect()} == {0}
    row = lifecycle.crawl_rows(spark, str(tmp_path / "a" / "tables")).first()
    assert row.end and row.issues_end and row.total_urls == 1 and row.robotstxt_exists and row.sitemap_exists and not row.sitemap_blocked and row.internal_follow == 2 and row.internal_nofollow == 1 and row.external_follow == 1


def test_jdbc(spark):
    from auditlake.sources import jdbc

    url = "jdbc:derby:memory:audit;create=true"
    rows = spark.range(100).selectExpr("id", "id % 7 AS kind")
    jdbc.write(rows, url, "pages", connections=2, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    got = jdbc.read(spark, url, "pages", parts=3, key="id", low=10, high=90, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.rdd.getNumPartitions() == 3 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_sitemaps(spark):
    hosts = spark.createDataFrame([("h.example", "https"), ("g.example", "http")], "host string, scheme string")
    robots = spark.createDataFrame(
        [("h.example", "User-agent: *\nDisallow: /hidden\nSitemap: https://h.example/hidden/s.xml\nSitemap: https://h.example/s.xml")],
        "host string, body string",
    )
    rules = crawl.robots_rules(robots, "bot")
    named = lambda ignore: sorted((r.sitemap, r.sitemap_blocked) for r in crawl.sitemaps_of(hosts, robots, rules, ignore).collect())
    assert named(False) == [("http://g.example/sitemap.xml", False), ("https://h.example/s.xml", False)]
    assert ("https://h.example/hidden/s.xml", True) in named(True)
    maps = spark.createDataFrame(
        [
            ("s", "<urlset><url><loc> http://h.example </loc></url><url><loc>http://h.example/?a=1&amp;b</loc></url></urlset>"),
            ("i", "<sitemapindex><sitemap><loc>http://h.example/s.xml</loc></sitemap></sitemapindex>"),
            ("n", None),
        ],
        "sitemap string, body string",
    )
    assert {r.url for r in crawl.sitemap_urls(maps).collect()} == {"http://h.example/", "http://h.example/?a=1&b"}
    assert [r.url for r in crawl.sitemap_children(maps).collect()] == ["http://h.example/s.xml"]


def test_settings():
    got = settings.settings(
        '[Server]\nport = 9000\n[crawler]\nagent = "x"\ndebug = false',
        {"AUDITLAKE_SERVER_PORT": "9001", "AUDITLAKE_CRAWLER_DEBUG": "true", "HOME": "/"},
    )
    assert got == {"server": {"port": 9001}, "database": {}, "crawler": {"agent": "x", "debug": True}, "ui": {}}
    texts = {"en": settings.translations('a: "Page %n% of \\"%m%\\"" # c\nb: plain text # c\n# no: x\nq: \'it\'\'s\''), "es": {"b": "texto"}}
    assert settings.translate("a", texts, "es", n=2, m="k") == 'Page 2 of "k"' and settings.translate("b", texts, "es") == "texto"
    assert settings.translate("q", texts, "fr") == "it's" and settings.translate("zz", texts, "en") == "zz" and settings.translate("a", texts, "en", n=1) == 'Page 1 of "%m%"'
