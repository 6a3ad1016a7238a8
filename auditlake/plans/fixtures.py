"""Deterministic site tables over the driver's star schema, for queries at join scale.

No crawl facts exist in the test data, so they are derived by integer arithmetic on keys; every such table is synthetic. One
expression serves Spark and, through `duck`, DuckDB. `orders` are pages, `lineitem` rows are links and language alternates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.shared import written


def url(k: str) -> str:
    return (
        f"concat(CASE WHEN ({k}) % 11 = 0 THEN 'http' ELSE 'https' END, '://', CASE WHEN ({k}) % 97 = 0 THEN 'localhost' ELSE concat('site', CAST(({k}) % 5 AS STRING), '.example') END, "
        f"CASE ({k}) % 7 WHEN 0 THEN '/p_x/' WHEN 1 THEN '/p//y/' WHEN 2 THEN '/p z/' ELSE '/p/' END, CAST(({k}) AS STRING), CASE ({k}) % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.html' WHEN 2 THEN '.png' WHEN 3 THEN '.zzz' ELSE '' END)"
    )


K = "o_orderkey"
STATUS = f"CASE {K} % 10 WHEN 3 THEN 301 WHEN 4 THEN 404 WHEN 5 THEN 500 WHEN 7 THEN 204 WHEN 8 THEN 0 WHEN 9 THEN 302 ELSE 200 END"
TARGET = f"CASE WHEN {K} % 10 = 3 THEN {K} + 6 WHEN {K} % 3 = 0 THEN {K} - 6 ELSE {K} + 4 END"
#: name -> expression; the flat facts that the nested record is built from come last
PAGE = {
    "id": K,
    "crawl_id": f"CAST(1 + ({K} / 7500) % 2 AS BIGINT)",
    "url": url(K),
    "status_code": STATUS,
    "redirect_url": f"CASE WHEN {K} % 10 IN (3, 9) THEN {url(TARGET)} ELSE '' END",
    "media_type": f"CASE {K} % 8 WHEN 0 THEN 'image/png' WHEN 1 THEN '' WHEN 2 THEN 'text/javascript' ELSE 'text/html' END",
    "lang": f"CASE {K} % 9 WHEN 0 THEN '' WHEN 1 THEN 'e1' WHEN 2 THEN 'en,fr' WHEN 3 THEN 'en, fr' WHEN 4 THEN 'pt-BR' ELSE 'en' END",
    "title": f"CASE WHEN {K} % 13 = 0 THEN '' WHEN {K} % 2 = 0 THEN repeat('é', CAST({K} % 41 AS INT)) ELSE repeat('t', CAST({K} % 83 AS INT)) END",
    "description": f"CASE WHEN {K} % 17 = 0 THEN '' ELSE repeat('d', CAST({K} % 211 AS INT)) END",
    "canonical": f"CASE {K} % 5 WHEN 1 THEN {url(K)} WHEN 2 THEN {url(K + ' + 5')} WHEN 3 THEN {url(K + ' + 1')} ELSE '' END",
    "robots": f"CASE {K} % 19 WHEN 0 THEN 'noindex,nofollow' WHEN 1 THEN 'nosnippet' WHEN 2 THEN 'max-snippet:0' WHEN 3 THEN 'noimageindex' WHEN 4 THEN 'nofollow' ELSE '' END",
    "noindex": f"{K} % 19 = 0",
    "nofollow": f"{K} % 19 IN (0, 4)",
    "crawled": f"{K} % 23 <> 0",
    "robotstxt_blocked": f"{K} % 29 = 0",
    "in_sitemap": f"{K} % 2 = 0",
    "timeout": f"{K} % 101 = 0",
    "depth": f"CAST({K} % 10 - 1 AS INT)",
    "ttfb": f"CAST(({K} * 37) % 1200 AS INT)",
    "size": f"CAST(({K} * 7919) % 1000000 AS BIGINT)",
    "words": f"CAST(({K} * 31) % 500 AS INT)",
    "h1": f"CASE WHEN {K} % 6 = 0 THEN '' ELSE 'Heading' END",
    "h2": f"CASE WHEN {K} % 4 = 0 THEN '' ELSE 'Part' END",
    "content_type": f"CASE {K} % 8 WHEN 0 THEN 'image/png' WHEN 1 THEN '' WHEN 2 THEN 'text/javascript' ELSE 'text/html; charset=utf-8' END",
    "body_hash": f"CASE WHEN {K} % 8 < 3 THEN '' ELSE concat('h', CAST({K} % 4000 AS STRING)) END",
}
LINK_COUNT = f"CASE WHEN {K} % 31 = 0 THEN 0 WHEN {K} % 37 = 0 THEN 120 ELSE {K} % 5 END"
FLAT = {
    "n_links": f"CAST({LINK_COUNT} AS INT)", "n_external": f"CAST({K} % 3 AS INT)", "external_status": f"CAST(CASE {K} % 5 WHEN 0 THEN 301 WHEN 1 THEN 404 WHEN 2 THEN -1 ELSE 200 END AS INT)", "external_nofollow": f"{K} % 4 = 0", "external_local": f"{K} % 43 = 0", "http_link": f"{K} % 12 = 0",
    "n_images": f"CAST({K} % 3 AS INT)", "alt_length": f"CAST(({K} * 3) % 130 AS INT)", "hreflang_kind": f"CAST({K} % 6 AS INT)",
    "n_head_title": f"CAST({K} % 3 AS INT)", "n_head_meta_description": f"CAST({K} % 4 AS INT)", "n_head_canonical": f"CAST({K} % 4 AS INT)", "first_canonical_href": f"CASE WHEN {K} % 4 = 0 THEN '' WHEN {K} % 2 = 0 THEN '/relative' ELSE 'https://site.example/c' END",
    "link_header": f"CASE {K} % 7 WHEN 0 THEN '<https://site.example/c>; rel=\"canonical\"' WHEN 1 THEN '<https://site.example/d>; rel=\"canonical\"' ELSE '' END", "n_body_child_meta": f"CAST({K} % 2 AS INT)", "n_elements": f"CAST(({K} * 13) % 3000 AS INT)", "has_duplicate_id": f"{K} % 10 = 1", "picture_without_img": f"{K} % 14 = 3", "img_missing_size": f"{K} % 15 = 6",
    "level": f"CAST({K} % 4 AS INT)", "form": f"CAST({K} % 3 AS INT)", "viewport": f"CASE WHEN {K} % 3 = 0 THEN '' ELSE 'width=device-width' END", "has_csp_meta": f"{K} % 2 = 1", "csp": f"CASE WHEN {K} % 6 = 0 THEN 'default-src' ELSE '' END", "hsts": f"CASE {K} % 4 WHEN 0 THEN '' WHEN 1 THEN 'max-age=x; preload' ELSE 'max-age=300; preload' END", "nosniff": f"CASE WHEN {K} % 5 = 0 THEN 'nosniff' ELSE '' END", "pagination": f"CAST({K} % 4 AS INT)", "alternate": f"CASE WHEN {K} % 8 = 5 THEN '/fr' ELSE 'https://site.example/fr' END",
}
LINK = {
    "pagereport_id": "l_orderkey",
    "crawl_id": "CAST(1 + (l_orderkey / 7500) % 2 AS BIGINT)",
    "line": "CAST(l_linenumber AS INT)",
    "url": url("l_orderkey - l_orderkey % 300 + l_partkey % 290"),
    "nofollow": "l_returnflag = 'R'",
    "text": "concat('part ', CAST(l_partkey AS STRING))",
}
ALTERNATE = {
    "pagereport_id": "l_orderkey",
    "crawl_id": LINK["crawl_id"],
    "line": LINK["line"],
    "from_lang": "'en'",
    "to_lang": "CASE l_partkey % 4 WHEN 0 THEN 'x-default' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END",
    "from_url": url("l_orderkey"),
    "to_url": url("CASE WHEN l_partkey % 3 = 0 THEN l_orderkey ELSE l_orderkey - l_orderkey % 50 + l_partkey % 40 END"),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int_div(sql: str) -> str:
    return sql.replace("(o_orderkey / 7500)", "(o_orderkey DIV 7500)").replace("(l_orderkey / 7500)", "(l_orderkey DIV 7500)")


def flat_pages(spark: SparkSession, sf_dir: str, flat: bool = True) -> DataFrame:
    columns = PAGE | (FLAT if flat else {})
    df = _table(spark, sf_dir, "orders").selectExpr(*[f"{_int_div(v)} AS {k}" for k, v in columns.items()])
    return df.withColumn("url_hash", F.sha2("url", 256)).withColumn(
        "redirect_hash",
        F.when(F.col("redirect_url") == "", "").otherwise(F.sha2("redirect_url", 256)),
    ).withColumn("scheme", F.regexp_extract("url", "^([a-z]+):", 1))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested records that row rules read, built from the flat facts."""
    header = lambda name, column: f"IF({column} = '', NULL, struct('{name}' AS key, array({column}) AS value))"
    return flat_pages(spark, sf_dir).selectExpr(
        *PAGE,
        "transform(IF(n_links = 0, CAST(array() AS array<int>), sequence(1, n_links)), i -> named_struct('url', concat(IF(http_link, 'http', 'https'), '://site.example/', i), 'nofollow', i = 3)) AS links",
        "CAST(array() AS array<struct<url:string,nofollow:boolean>>) AS internal_links",
        "transform(IF(n_external = 0, CAST(array() AS array<int>), sequence(1, n_external)), i -> named_struct('url', IF(external_local, 'http://localhost/x', 'https://other.example/'), 'nofollow', external_nofollow, 'status_code', external_status)) AS external_links",
        "transform(IF(n_images = 0, CAST(array() AS array<int>), sequence(1, n_images)), i -> named_struct('url', 'i.png', 'alt', repeat('a', alt_length))) AS images",
        "CASE hreflang_kind WHEN 0 THEN array(named_struct('url', url, 'lang', 'en'), named_struct('url', 'https://o.example/', 'lang', 'x-default')) WHEN 1 THEN array(named_struct('url', url, 'lang', 'fr')) WHEN 2 THEN array(named_struct('url', 'https://o.example/', 'lang', 'fr')) ELSE CAST(array() AS array<struct<url:string,lang:string>>) END AS hreflangs",
        "map_from_entries(array_compact(array(" + ", ".join(
            header(*x) for x in (
                ("link", "link_header"),
                ("content-security-policy", "csp"),
                ("strict-transport-security", "hsts"),
                ("x-content-type-options", "nosniff"),
            )
        ) + "))) AS headers",
        "named_struct('n_head_title', n_head_title, 'n_head_meta_description', n_head_meta_description, 'n_head_canonical', n_head_canonical, 'first_canonical_href', first_canonical_href, 'n_body_child_meta', n_body_child_meta, 'n_elements', n_elements, 'has_duplicate_id', has_duplicate_id, 'picture_without_img', picture_without_img, 'img_missing_size', img_missing_size, "
        "'heading_levels', array(level, 1, 3), 'form_actions', CASE form WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('http://site.example/f') ELSE array('/f') END, 'viewport_content', viewport, 'has_csp_meta', has_csp_meta, 'pagination_hrefs', IF(pagination = 0, CAST(array() AS array<string>), array(concat('https://site.example/', pagination))), 'alternate_hrefs', array(alternate)) AS dom",
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(*[f"{_int_div(v)} AS {k}" for k, v in LINK.items()]).withColumn("url_hash", F.sha2("url", 256))


def hreflangs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr(*[f"{_int_div(v)} AS {k}" for k, v in ALTERNATE.items()])
    return rows.withColumn("from_hash", F.sha2("from_url", 256)).withColumn("to_hash", F.sha2("to_url", 256))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"pagereports": flat_pages(spark, sf_dir, flat=False), "links": links(spark, sf_dir), "hreflangs": hreflangs(spark, sf_dir)}


class Stored(dict):
    """Tables that are written when they are first asked for, as an audit has them, with their hashes: the cross-page rules read
    each several times, and a rule writes no table that it doesn't read."""

    def __init__(self, made: dict[str, DataFrame]):
        super().__init__()
        self.made = made

    def __missing__(self, name: str) -> DataFrame:
        self[name] = written(self.made[name], name)
        return self[name]


def stored_tables(spark: SparkSession, sf_dir: str) -> Stored:
    """tables(), each written once for the caller."""
    return Stored(tables(spark, sf_dir))


def duck(*names: str) -> str:
    """WITH clause of the named synthetic tables for DuckDB."""
    fix = lambda sql: sql.replace(" / 7500)", " // 7500)").replace("AS STRING", "AS VARCHAR")
    select = lambda columns: ", ".join(f"{fix(v)} AS {k}" for k, v in columns.items())
    made = {
        "pagereports": f"SELECT *, sha256(url) AS url_hash, CASE WHEN redirect_url = '' THEN '' ELSE sha256(redirect_url) END AS redirect_hash, regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM (SELECT {select(PAGE | FLAT)} FROM orders)",
        "links": f"SELECT *, sha256(url) AS url_hash FROM (SELECT {select(LINK)} FROM lineitem)",
        "hreflangs": f"SELECT *, sha256(from_url) AS from_hash, sha256(to_url) AS to_hash FROM (SELECT {select(ALTERNATE)} FROM lineitem)",
    }
    return "WITH " + ", ".join(f"{n} AS ({made[n]})" for n in names)
