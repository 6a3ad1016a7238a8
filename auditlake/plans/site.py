"""Synthetic responses of a site, one for each row of `orders`, with HTML made by integer arithmetic on the key.

One expression serves Spark and, through `duck`, DuckDB, so both have the same bodies. The page records come from the parser;
their twins are the same arithmetic, so every fact that the parser finds has an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.shared import spread
from auditlake.sources import html

K = "o_orderkey"
TEXT = f"CAST({K} AS STRING)"


def case(*pairs: tuple[str, str], other: str = "''") -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in pairs) + f" ELSE {other} END"


def join(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def every(n: int, rest: int = 0) -> str:
    return f"{K} % {n} = {rest}"


SCHEME = case((every(11, 1), "'http'"), other="'https'")
ORIGIN = join(SCHEME, "'://site.example'")
FOLDER = join(ORIGIN, "'/d'", f"CAST({K} % 3 AS STRING)", case((every(23), "'//'"), other="'/'"))
URL = join(FOLDER, "'p'", case((every(17), "'_'"), (every(19), "' '")), TEXT, "'.html'")
STATUS = f"CASE {K} % 9 WHEN 0 THEN 404 WHEN 1 THEN 301 ELSE 200 END"
KIND = f"CASE {K} % 13 WHEN 2 THEN 'text/css' WHEN 3 THEN 'image/png' ELSE 'text/html' END"
HTML = f"{K} % 13 NOT IN (2, 3) AND {K} % 9 <> 1"
ALT = case((every(59), "repeat('a', 101)"), other="'one'")
N_LINKS, N_EXTERNAL, N_IMAGES, N_WORDS = f"{K} % 4", f"{K} % 3", f"{K} % 3", f"{K} % 300"

HEAD = [
    case(
        (every(11), "''"),
        (every(5), join("'<title>First '", TEXT, "'</title><title>Second</title>'")),
        other=join("'<title> Page '", TEXT, "' of the site &amp; more </title>'"),
    ),
    case(
        (every(4), "''"),
        (every(4, 1), "'<meta name=\"description\" content=\"One\"><meta name=\"description\" content=\"Two\">'"),
        other=join("'<meta name=\"description\" content=\"'", f"repeat('d', CAST({K} % 200 AS INT))", "'\">'"),
    ),
    case((every(3), "''"), other="'<meta name=\"viewport\" content=\"width=device-width\">'"),
    case(
        (every(12, 1), "'<meta name=\"robots\" content=\"noindex\">'"),
        (every(12, 2), "'<meta name=\"robots\" content=\"nofollow\">'"),
        (every(12, 3), "'<meta name=\"robots\" content=\"none\">'"),
        (every(12, 4), "'<meta name=\"robots\" content=\"nosnippet\">'"),
        (every(12, 5), "'<meta name=\"robots\" content=\"noimageindex\">'"),
    ),
    case((every(10, 7), "'<meta http-equiv=\"refresh\" content=\"5;url=/moved\">'")),
    case((every(7, 3), "'<base href=\"/base/x\">'")),
    case(
        (every(5, 1), join("'<link rel=\"canonical\" href=\"'", URL, "'\">'")),
        (every(5, 2), "'<link rel=\"canonical\" href=\"/c\">'"),
        (every(5, 3), "'<link rel=\"canonical\" href=\"/c1\"><link rel=\"canonical\" href=\"/c2\">'"),
    ),
    case((every(4, 2), join("'<link rel=\"alternate\" hreflang=\"fr\" href=\"/fr/p\"><link rel=\"alternate\" hreflang=\"x-default\" href=\"'", URL, "'\">'"))),
    case((every(8, 2), join("'<link rel=\"alternate\" hreflang=\"es\" href=\"'", URL, "'\">'"))),
    case((every(6, 5), "'<link rel=\"next\" href=\"a/1.html\">'")),
    case(
        (every(2), "'<link rel=\"stylesheet\" href=\"/s.css\">'"),
        other="'<script src=\"/a.js\">no words here</script><meta http-equiv=\"Content-Security-Policy\" content=\"default-src\">'",
    ),
    case((every(3, 1), "'<link rel=\"preload\" href=\"/f.woff\">'"), (every(3, 2), "'<style>body{background:url(bg.png)}</style>'")),
]
BODY = [
    case((every(7, 5), "'<meta name=\"y\" content=\"z\">'")),
    case((every(6), "''"), other=join("'<h1> Heading '", TEXT, "'</h1>'")),
    case((every(4), "''"), other=join("'<h2>Part '", TEXT, "'</h2>'")),
    case((every(8), "'<h3>Sub</h3>'")),
    "'<a href=\"mailto:x@site.example\">mail</a>'",
    case((f"{N_LINKS} >= 1", "'<a href=\"a/1.html\">Link 1</a>'")),
    case((f"{N_LINKS} >= 2", "'<a href=\"a/2.html#part\" rel=\"nofollow\">Link <b>2</b></a>'")),
    case((f"{N_LINKS} >= 3", "'<a href=\"/a/3.html?x=1\">3 &lt; 4</a>'")),
    case((every(89), "repeat('<a href=\"/many\">m</a>', 101)")),
    case((f"{N_EXTERNAL} >= 1", "'<a href=\"https://other.example/x\" rel=\"sponsored\">x</a>'")),
    case((f"{N_EXTERNAL} >= 2", "'<a href=\"http://other.example\" rel=\"ugc nofollow\">y</a>'")),
    case((every(43), "'<a href=\"http://localhost/z\">z</a>'")),
    case((f"{N_IMAGES} >= 1", join("'<img src=\"/i1.png\" width=\"1\" height=\"2\" alt=\"'", ALT, "'\">'"))),
    case((f"{N_IMAGES} >= 2", "'<img src=\"i2.png\" srcset=\"s1.png 1x, s2.png 2x\" alt=\"\">'")),
    case(
        (
            every(6, 1),
            "'<picture><source srcset=\"/p1.webp 1x, /p2.webp 2x\"><img src=\"/p.png\" alt=\"pic\" width=\"1\" height=\"1\"></picture>'",
        ),
        (every(6, 2), "'<picture><source srcset=\"/q.webp\"></picture>'"),
    ),
    case((every(4, 1), "'<iframe src=\"/f.html\"></iframe>'")),
    case((every(5, 2), "'<audio src=\"/a.mp3\"><source src=\"/b.ogg\"></audio>'"), (every(5, 3), "'<video poster=\"/v.png\"><source src=\"/v.mp4\"></video>'")),
    case((every(3, 1), "'<form action=\"http://site.example/f\"></form>'"), (every(3, 2), "'<form action=\"/f\"></form>'")),
    case((every(10, 1), "'<b id=\"x\"></b><b id=\"x\"></b>'")),
    case((every(7, 2), "'<div style=\"background:url(/in.png)\"></div>'")),
    case((every(97), "repeat('<i>x</i>', 1600)")),
    join("'<p>'", f"repeat('word ', CAST({N_WORDS} AS INT))", "'</p>'"),
]
PAGE = join(
    "'<!DOCTYPE html><html'",
    case((every(3), "' lang=\"en\"'"), (every(3, 1), "' lang=\"fr\"'")),
    "'><head>'",
    *HEAD,
    "'</head><body>'",
    *BODY,
    "'</body></html>'",
)
CANONICAL_HEADER = case((f"{K} % 5 = 4 OR {every(10, 8)}", "'<https://site.example/h>; rel=\"canonical\"'"))
LINK_HEADER = join(
    CANONICAL_HEADER,
    case((f"({K} % 5 = 4 OR {every(10, 8)}) AND {every(4, 3)}", "','")),
    case((every(4, 3), "'<https://site.example/de>; rel=\"alternate\"; hreflang=\"de\"'")),
)
HEADERS = {
    "Content-Type": join(KIND, case((f"{KIND} = 'text/html'", "'; charset=utf-8'"))),
    "Location": case((every(9, 1), join("'/m'", TEXT))),
    "Content-Language": case((every(6, 5), "'de'")),
    "X-Robots-Tag": case((every(12, 6), "'noindex'")),
    "Link": LINK_HEADER,
    "Strict-Transport-Security": case((every(4), "''"), (every(4, 1), "'max-age=x'"), other="'max-age=300'"),
    "Content-Security-Policy": case((every(4), "'default-src'")),
    "X-Content-Type-Options": case((every(5), "'nosniff'")),
}
RESPONSE = {
    "crawl_id": "CAST(1 AS BIGINT)", "url": URL, "status_code": STATUS, "body": case(
        (f"{KIND} = 'image/png'", "NULL"),
        (f"{KIND} = 'text/css'", "'a{background:url(x.png)}'"),
        other=PAGE,
    ), "content_length": f"CAST(({K} * 7919) % 1000000 AS BIGINT)",
    "ttfb": f"CAST(({K} * 37) % 1200 AS INT)", "depth": f"CAST({K} % 10 - 1 AS INT)", "in_sitemap": every(2), "robotstxt_blocked": every(29), "timeout": every(101),
}


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the keys alone are dealt out, as one split of them makes very many pages
    df = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(K), K)
    filled = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.array(F.expr(v)).alias("value")) for k, v in HEADERS.items()]), lambda x: x["value"][0] != "")
    return df.select(*[F.expr(v).alias(k) for k, v in RESPONSE.items()], F.map_from_entries(filled).alias("headers"))


def with_id(pages: DataFrame) -> DataFrame:
    """The order's key as id."""
    return pages.withColumn("id", F.regexp_extract("url", "/p[_ ]?([0-9]+)", 1).cast("long"))


def records(spark: SparkSession, sf_dir: str, *columns: str, page: int | None = None) -> DataFrame:
    """Page records with the order's key as id: their columns of these names, all where none are given, and crawl_id and url.

    page: the id of the only page that is wanted, whose response is looked for before any is parsed."""
    found = responses(spark, sf_dir)
    if page is not None:
        found = with_id(found).where(F.col("id") == page).drop("id")
    return with_id(html.page_records(found, columns=["crawl_id", "url", *columns] if columns else None))


def absolute(ref: str) -> str:
    """The URL that a reference in a body leads to."""
    plain = f"concat({ORIGIN}, '{ref}')" if ref.startswith("/") else f"concat({FOLDER}, '{ref}')"
    return case((every(7, 3), f"concat({ORIGIN}, '/base/x/{ref.lstrip('/')}')"), other=plain)


def given(when: str, *items: str) -> str:
    """A DuckDB list, empty where the condition does not hold or the response is no page."""
    return f"CASE WHEN ({HTML}) AND ({when}) THEN [{', '.join(items)}] ELSE [] END"


def row(**fields: str) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def link(url: str, rel: str, text: str) -> str:
    flags = {x: str(x in rel).lower() for x in ("nofollow", "sponsored", "ugc")}
    return row(url=url, rel=f"'{rel}'", text=f"'{text}'", **flags)


def image(ref: str, alt: str) -> str:
    return row(url=absolute(ref), alt=alt)


LISTS = {
    "links": [
        given(f"{N_LINKS} >= 1", link(absolute("a/1.html"), "", "Link 1")), given(f"{N_LINKS} >= 2", link(absolute("a/2.html"), "nofollow", "Link 2")),
        given(f"{N_LINKS} >= 3", link(case((every(7, 3), absolute("/a/3.html")), other=join(absolute("/a/3.html"), "'?x=1'")), "", "3 &lt; 4")),
        f"CASE WHEN ({HTML}) AND {every(89)} THEN list_transform(range(101), lambda i: {link(absolute('/many'), '', 'm')}) ELSE [] END",
    ],
    "external_links": [
        given(f"{N_EXTERNAL} >= 1", link("'https://other.example/x'", "sponsored", "x")),
        given(f"{N_EXTERNAL} >= 2", link("'http://other.example/'", "ugc nofollow", "y")),
        given(every(43), link("'http://localhost/z'", "", "z")),
    ],
    "hreflangs": [
        given(every(4, 2), row(url=absolute("/fr/p"), lang="'fr'"), row(url=URL, lang="'x-default'")),
        given(every(8, 2), row(url=URL, lang="'es'")),
        given(every(4, 3), row(url="'https://site.example/de'", lang="'de'")),
    ],
    "images": [
        given(f"{N_IMAGES} >= 1", image("/i1.png", ALT)), given(f"{N_IMAGES} >= 2", image("i2.png", "''"), image("s1.png", "''"), image("s2.png", "''")),
        given(every(6, 1), image("/p.png", "'pic'"), image("/p1.webp", "'pic'"), image("/p2.webp", "'pic'")),
    ],
    "videos": [given(every(5, 3), row(url=absolute("/v.mp4"), poster=absolute("/v.png")))],
    "scripts": [given(every(2, 1), absolute("/a.js"))],
    "styles": [given(every(2), absolute("/s.css"))],
    "iframes": [given(every(4, 1), absolute("/f.html"))],
    "audios": [given(every(5, 2), absolute("/a.mp3"), absolute("/b.ogg"))],
    "css_urls": [
        given(every(3, 2), join(FOLDER, "'bg.png'")),
        given(every(7, 2), join(ORIGIN, "'/in.png'")),
        f"CASE WHEN {KIND} = 'text/css' AND {K} % 9 <> 1 THEN [concat({FOLDER}, 'x.png')] ELSE [] END",
    ],
    "preload": [given(every(3, 1), absolute("/f.woff"))],
}


def of_page(value: str, other: str = "''") -> str:
    return f"CASE WHEN {HTML} THEN {value} ELSE {other} END"


TITLE = of_page(case((every(11), "''"), (every(5), join("'First '", TEXT)), other=join("'Page '", TEXT, "' of the site & more'")))
ROBOTS = of_page(
    f"CASE {K} % 12 WHEN 1 THEN 'noindex' WHEN 2 THEN 'nofollow' WHEN 3 THEN 'none' WHEN 4 THEN 'nosnippet' WHEN 5 THEN 'noimageindex' "
    f"WHEN 6 THEN 'noindex' ELSE '' END"
)
FACTS = {
    "id": K, "crawl_id": RESPONSE["crawl_id"], "url": URL, "scheme": SCHEME, "status_code": STATUS, "content_type": HEADERS["Content-Type"], "media_type": KIND,
    "redirect_url": case(
        (every(9, 1), f"concat({ORIGIN}, '/m', {TEXT})"),
        (f"({HTML}) AND {every(10, 7)}", absolute("/moved")),
    ), "refresh": of_page(case((every(10, 7), "'5;url=/moved'"))),
    "lang": of_page(case((every(3), "'en'"), (every(3, 1), "'fr'"), (every(6, 5), "'de'"))), "title": TITLE,
    "description": of_page(case((every(4), "''"), (every(4, 1), "'One'"), other=f"repeat('d', CAST({K} % 200 AS INT))")),
    "robots": ROBOTS, "noindex": f"({HTML}) AND {K} % 12 IN (1, 3, 6)", "nofollow": f"({HTML}) AND {K} % 12 IN (2, 3)",
    "canonical": of_page(case((every(5, 1), URL), (every(5, 2), absolute("/c")), (f"{K} % 5 = 4 OR {every(10, 8)}", "'https://site.example/h'"))),
    "h1": of_page(case((every(6), "''"), other=join("'Heading '", TEXT))), "h2": of_page(case((every(4), "''"), other=join("'Part '", TEXT))),
    "words": of_page(
        f"CAST({N_WORDS} + CASE WHEN {every(6)} THEN 0 ELSE 2 END + CASE WHEN {every(4)} THEN 0 ELSE 2 END + CASE WHEN {every(8)} THEN 1 "
        f"ELSE 0 END + CASE WHEN {every(97)} THEN 1600 ELSE 0 END AS INT)",
        "0",
    ),
    "size": f"CASE WHEN {KIND} = 'image/png' THEN {RESPONSE['content_length']} ELSE strlen(body) END", "body_hash": of_page("sha256(body)"),
    "robotstxt_blocked": every(29), "crawled": f"NOT ({every(101)}) AND NOT (({HTML}) AND {K} % 12 IN (2, 3))", "in_sitemap": every(2), "timeout": every(101), "depth": RESPONSE["depth"], "ttfb": RESPONSE["ttfb"],
}
#: What only rules read.
DOM = {
    "n_title": of_page(case((every(11), "0"), (every(5), "2"), other="1"), "0"), "n_canonical": of_page(
        f"CASE {K} % 5 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END",
        "0",
    ), "first_canonical": of_page(case((every(5, 1), URL), (every(5, 2), "'/c'"), (every(5, 3), "'/c1'"))),
    "html": HTML, "k": K, "canonical_header": f"CASE WHEN {K} % 5 = 4 OR {every(10, 8)} THEN 'https://site.example/h' END", "hsts": HEADERS["Strict-Transport-Security"], "csp": f"(({HTML}) AND {every(2, 1)}) OR {every(4)}", "nosniff": every(5),
}


def duck() -> str:
    """WITH clause of `site`: every page record, with the nested arrays and the facts that rules read, for DuckDB."""
    text = lambda sql: sql.replace("AS STRING", "AS VARCHAR")
    columns = ", ".join(f"{text(v)} AS {k}" for k, v in (FACTS | DOM).items())
    lists = ", ".join(f"list_concat({', '.join(map(text, v))}) AS {k}" if len(v) > 1 else f"{text(v[0])} AS {k}" for k, v in LISTS.items())
    return f"WITH site AS (SELECT {columns}, {lists} FROM (SELECT *, {text(RESPONSE['body'])} AS body FROM orders))"


def child(name: str, columns: str) -> str:
    """Rows of one nested array with their place in it."""
    return f"{duck()} SELECT id AS pagereport_id, crawl_id, CAST(line AS INT) AS line, {columns} FROM (SELECT id, crawl_id, url, lang, unnest({name}) AS x, unnest(range(len({name}))) AS line FROM site)"


PAGES = "crawled AND media_type = 'text/html'"
OK = PAGES + " AND status_code BETWEEN 200 AND 299"
NOT_3XX = PAGES + " AND status_code NOT BETWEEN 300 AND 399"
#: The rules by the arithmetic alone. Links have no status here, and no page has a link that rule 20 reads by default.
RULES = {
    1: "crawled AND status_code = 301", 2: "crawled AND status_code = 404", 6: f"{OK} AND title = ''", 7: f"{PAGES} AND strlen(title) BETWEEN 1 AND 19", 8: f"{PAGES} AND strlen(title) > 60",
    9: f"{OK} AND description = ''", 10: f"{OK} AND strlen(description) BETWEEN 1 AND 79", 11: f"{OK} AND strlen(description) > 160", 12: f"{OK} AND words < 200", 13: f"{PAGES} AND html AND k % 3 = 2",
    15: f"{PAGES} AND h1 = ''", 16: f"{NOT_3XX} AND lang = ''", 17: f"{OK} AND len(links) > 0 AND k % 11 = 1", 19: f"{OK} AND len(links) > 100", 21: f"{OK} AND NOT nofollow AND html AND (k % 3 >= 1 OR k % 43 = 0)",
    24: f"{PAGES} AND html AND k % 8 = 0", 27: "noindex", 29: "robotstxt_blocked", 31: "in_sitemap AND noindex", 32: "in_sitemap AND robotstxt_blocked", 33: f"{PAGES} AND canonical <> '' AND canonical <> url",
    36: "crawled AND status_code BETWEEN 200 AND 299 AND scheme = 'http'", 37: f"{OK} AND len(links) + len(external_links) = 0", 43: f"{PAGES} AND n_canonical > 1", 44: f"{PAGES} AND n_canonical > 0 AND first_canonical LIKE '/%'",
    45: f"{PAGES} AND html AND k % 4 = 3", 46: f"{PAGES} AND html AND k % 4 = 3", 47: f"{PAGES} AND html AND k % 8 = 2 AND lang <> ''", 48: f"{PAGES} AND html AND k % 4 = 2", 49: f"{PAGES} AND n_canonical > 0 AND first_canonical <> canonical_header",
    50: "hsts IN ('', 'max-age=x')", 51: "media_type = 'text/html' AND NOT csp", 52: "media_type = 'text/html' AND NOT nosniff", 53: "media_type = 'image/png' AND k % 9 <> 1 AND size > 500000 OR media_type = 'image/png' AND k % 9 = 1 AND size > 500000",
    54: f"{PAGES} AND html AND k % 3 > 0 AND k % 59 = 0", 55: f"{PAGES} AND n_title > 1", 56: f"{PAGES} AND html AND k % 4 = 1", 57: "media_type = 'text/html' AND status_code = 200 AND depth > 4", 62: "timeout", 63: "k % 17 = 0", 64: "ttfb > 800",
    65: f"{PAGES} AND html AND scheme = 'http' AND k % 3 > 0", 66: f"{PAGES} AND html AND k % 3 = 1", 67: "k % 19 = 0 AND k % 17 <> 0", 68: "k % 23 = 0", 69: f"{PAGES} AND robots = 'noimageindex'", 70: f"{PAGES} AND html AND k % 6 = 2", 71: f"{PAGES} AND html AND k % 7 = 5",
    72: f"{PAGES} AND robots = 'nosnippet'", 73: f"{PAGES} AND html AND k % 3 = 2", 74: "media_type <> 'text/html'", 75: f"{OK} AND html AND k % 10 = 1", 76: f"{PAGES} AND (NOT html OR k % 3 = 0)", 77: f"{OK} AND html AND (k % 97 = 0)",
    78: f"{NOT_3XX} AND html AND k % 6 = 5 AND k % 4 = 0", 79: f"{PAGES} AND html AND k % 43 = 0",
}
#: By their names, where the audit's own predicates differ.
STRICT = {20: f"{OK} AND (nofollow AND len(links) > 0 OR html AND k % 4 >= 2)", 33: f"{RULES[33]} AND in_sitemap"}


def issues_sql(rules: dict[int, str]) -> str:
    return f"{duck()} " + " UNION ALL ".join(
        f"SELECT id AS pagereport_id, crawl_id, CAST({code} AS INT) AS issue_type_id FROM site WHERE {where}" for code, where in rules.items()
    )


#: What records lead to, by kind, as operators.crawl.expand_links() gives it.
EXPANDED = (
    f"{duck()} SELECT crawl_id, source, url, kind, kind = 'resource' AS ignore_domain FROM ("
    + " UNION ALL ".join(
        [
            f"SELECT crawl_id, url AS source, x.url AS url, 'link' AS kind FROM (SELECT crawl_id, url, nofollow, unnest({c}) AS x FROM site) WHERE NOT nofollow AND NOT x.nofollow" for c in ("links", "external_links")
        ]
        + [
            "SELECT crawl_id, url, x.url, 'indirect' FROM (SELECT crawl_id, url, unnest(hreflangs) AS x FROM site)",
            "SELECT crawl_id, url, unnest(iframes), 'indirect' FROM site",
            "SELECT crawl_id, url, unnest([redirect_url, canonical]), 'indirect' FROM site",
        ]
        + [f"SELECT crawl_id, url, unnest({c}), 'resource' FROM site" for c in ("scripts", "styles", "audios", "css_urls", "preload")]
        + [
            f"SELECT crawl_id, url, x.{at}, 'resource' FROM (SELECT crawl_id, url, unnest({c}) AS x FROM site)" for c, at in (
                ("images", "url"),
                ("videos", "url"),
                ("videos", "poster"),
            )
        ]
    )
    + ") WHERE url <> ''"
)
#: Links by follow, sponsored and user-made, of all records of a crawl.
COUNTERS = (
    f"{duck()}, l AS (SELECT crawl_id, 0 AS ext, x.nofollow OR nofollow AS no, x.sponsored AS sponsored, x.ugc AS ugc FROM (SELECT crawl_id, nofollow, unnest(links) AS x FROM site) UNION ALL SELECT crawl_id, 1, x.nofollow OR nofollow, x.sponsored, x.ugc FROM (SELECT crawl_id, nofollow, unnest(external_links) AS x FROM site)) "
    "SELECT crawl_id, count(*) FILTER (ext = 0 AND NOT no) AS internal_follow, count(*) FILTER (ext = 0 AND no) AS internal_nofollow, count(*) FILTER (ext = 1 AND NOT no) AS external_follow, count(*) FILTER (ext = 1 AND no) AS external_nofollow, count(*) FILTER (ext = 1 AND sponsored) AS sponsored, count(*) FILTER (ext = 1 AND ugc) AS ugc FROM l GROUP BY crawl_id"
)


#: Pages whose markup is wrong in one way each: (fragment of the head, of the body, what the standard's tree then holds beside the
#: page's own elements and words: elements, words, links (URL, text)).
MISNESTED = [
    ("", "<p>one<p>two<ul><li>a<li>b</ul>", 5, 4, []),
    ("", "<table>stray<tr><td>cell<td>next</table>", 5, 3, []),
    ("", "<a href=/one>one<a href=/two>two</a>", 2, 0, [("/one", "one"), ("/two", "two")]),
    ("", "<b>x<p>y</b>z</p>", 3, 3, []),
    ("", "<![foo[x]]><!weird><?pi?></>text<!-- a -- b -->", 0, 1, []),
    ("", "<a href=/three><div>in</a>out</div>", 3, 1, [("/three", ""), ("/three", "in")]),
    ("<noscript><img src=/i.png></noscript><meta name=description content=late>", "", 3, 0, []),
    ("", "<svg><title>pic</title><path/><g><a href=/svg>s</a></g></svg>", 5, 1, [("/svg", "s")]),
    ("", "<TABLE><TR><TD><a href=/cell>c</TABLE>after", 5, 1, [("/cell", "c")]),
    ("", "<select><option>p<option>q<div>r</select>s", 3, 3, []),
    ("", "<a href=?a=1&copy=2>k</a><a href=/x?a=1&amp;b=2>l</a>", 2, 0, [("?a=1&copy=2", "k"), ("/x?a=1&b=2", "l")]),
    ("", "<div><p>deep<div>er</p>tail</div></div>", 4, 3, []),
    ("", "<h2>&lt;script&gt;bad&lt;/script&gt;a &lt;b&gt;c&lt;/b&gt; &amp; d</h2>", 1, 8, []),
]
MISNESTED_URL = f"concat('https://site.example/m/', {TEXT})"


def misnested_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lambda at: "element_at(array(" + ", ".join(f"'{x[at]}'" for x in MISNESTED) + f"), CAST({K} % {len(MISNESTED)} + 1 AS INT))"
    body = join("'<!DOCTYPE html><html><head><title>T'", TEXT, "'</title>'", parts(0), "'</head><body><h1>H'", TEXT, "'</h1>'", parts(1), "'<p>end</p></body></html>'")
    df = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(K), K)
    other = {"crawl_id": "1L", "url": MISNESTED_URL, "status_code": "200", "headers": "map('Content-Type', array('text/html'))", "content_length": "0L"}
    flags = {x: "0" for x in ("ttfb", "depth")} | {x: "false" for x in ("in_sitemap", "robotstxt_blocked", "timeout")}
    return df.select(*[F.expr(v).alias(k) for k, v in (other | flags | {"body": body}).items()])


def misnested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parser finds in misnested pages."""
    links = F.array_join(F.transform("links", lambda x: F.concat(x["url"], F.lit(" "), x["text"])), "; ")
    columns = ["url", "title", "description", "h1", "h2", "words", "dom.n_elements", "dom.n_body_child_meta", F.size("images").alias("n_images"), links.alias("links")]
    return html.page_records(misnested_responses(spark, sf_dir), columns=["url", "title", "description", "h1", "h2", "words", "dom", "images", "links"]).select(*columns)


def misnested_sql() -> str:
    """The same facts by the standard, as constants of each kind of page."""
    of = lambda values: "CASE " + f"{K} % {len(MISNESTED)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    text, url = TEXT.replace("STRING", "VARCHAR"), MISNESTED_URL.replace("STRING", "VARCHAR")
    whole = lambda ref: f"concat({url}, '{ref}')" if ref.startswith("?") else f"'https://site.example{ref}'"
    links = ["concat(" + ", '; ', ".join(f"{whole(u)}, ' {t}'" for u, t in x[4]) + ")" if x[4] else "''" for x in MISNESTED]
    head, h2 = (of([str(int(x)) for x in flags]) for flags in ([bool(x[0]) for x in MISNESTED], ["<h2>" in x[1] for x in MISNESTED]))
    return (
        f"SELECT {url} AS url, concat('T', {text}) AS title, '' AS description, concat('H', {text}) AS h1, CASE {h2} WHEN 1 THEN 'a c &amp; d' ELSE '' END AS h2, "
        f"2 + {of([x[3] for x in MISNESTED])} AS words, 6 + {of([x[2] for x in MISNESTED])} AS n_elements, {head} AS n_body_child_meta, {head} AS n_images, "
        f"{of(links)} AS links FROM orders"
    )
