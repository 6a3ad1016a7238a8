"""Crawl semantics over a static site table: admission, robots rules, sitemaps and the breadth-first frontier.

The frontier is a DataFrame that is joined to the link table level by level; the seen-set is an anti-join. Each level is
written to the checkpoint folder, so lineage stays short."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls


def allowed(url: Column, main: str, subdomains: bool = False) -> Column:
    """The main host and its www form; with subdomains every host that ends in the main one, as the crawler has it."""
    host = urls.authority(url)
    return host.isin(main, f"www.{main}") | (host.endswith(main) if subdomains else F.lit(False))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, allow, prefix) of the group whose name is the longest beginning of the agent's, or of * where none is; groups of one
    name count together; robots(host, body)."""
    lines = robots.select("host", F.posexplode(F.split("body", "\r?\n")).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*", "")))
    lines = lines.select(
        "host",
        "at",
        F.lower(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)).alias("k"),
        F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("v"),
    ).where("k IN ('user-agent', 'allow', 'disallow')")
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("at")
    # consecutive user-agent lines open one group
    opens = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    grouped = lines.withColumn("g", F.sum(opens.cast("int")).over(w))
    named = grouped.where("k = 'user-agent'").select("host", "g", F.lower("v").alias("agent"))
    # the weakest match is *
    match = F.when(F.col("agent") == "*", 0).when(F.lit(agent.lower()).startswith(F.col("agent")) & (F.col("agent") != ""), F.length("agent"))
    best = named.withColumn("match", match).where("match IS NOT NULL").withColumn(
        "most",
        F.max("match").over(Window.partitionBy("host")),
    ).where("match = most").select("host", "g").distinct()
    return grouped.where("k <> 'user-agent' AND v <> ''").join(best, ["host", "g"]).select("host", (F.col("k") == "allow").alias("allow"), F.col("v").alias("prefix"))


def sorted_query(query: Column) -> Column:
    """A query's pairs in order of their keys, escaped anew, as robots rules are asked about it."""
    escaped = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x, i: F.struct(
            F.try_url_decode(F.substring_index(x, "=", 1)).alias("k"),
            i.alias("i"),
            F.try_url_decode(F.when(x.contains("="), F.regexp_extract(x, "^[^=]*=(.*)$", 1)).otherwise("")).alias("v"),
        ),
    )
    good = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    return F.array_join(F.transform(F.array_sort(good), lambda p: F.concat(escaped(p["k"]), F.lit("="), escaped(p["v"]))), "&")


def blocked(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages(url) with robotstxt_blocked: the longest matching rule wins, allow on a tie; * and $ are patterns."""
    path, query = F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    uri = F.concat(path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), sorted_query(query))))
    asked = pages.select("url").distinct().withColumn("host", urls.authority(F.col("url"))).withColumn("uri", F.when(uri == "", "/").otherwise(uri))
    escaped = F.regexp_replace(F.regexp_replace("prefix", r"([.+?^(){}\[\]|\\])", r"\\$1"), r"\*", ".*")
    hits = asked.join(rules.withColumn("pattern", F.concat(F.lit("^"), escaped)), "host").where("uri RLIKE pattern")
    best = hits.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return pages.join(best, "url", "left").withColumn("robotstxt_blocked", ~F.coalesce("allow", F.lit(True))).drop("allow")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    return robots.select("host", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^sitemap:\s*(\S+)"), F.lit(1))).alias("sitemap"))


def _locations(sitemaps: DataFrame, of_index: bool) -> DataFrame:
    kind = F.coalesce(F.col("body").rlike("(?is)<sitemapindex[\\s>]"), F.lit(False))
    found = sitemaps.where(kind if of_index else ~kind).select(
        "sitemap",
        F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url"),
    )
    return found.withColumn("url", F.regexp_replace(F.regexp_replace("url", "&amp;", "&"), "^([a-zA-Z]+://[^/?#]+)$", "$1/"))


def sitemap_children(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, url) of the further sitemaps that index files among sitemaps(sitemap, body) name."""
    return _locations(sitemaps, True)


def sitemap_urls(sitemaps: DataFrame, most: int = 20000) -> DataFrame:
    """(sitemap, url) of the page lists among sitemaps(sitemap, body); an empty path is /; at most `most` URLs, as a feature."""
    return _locations(sitemaps, False).orderBy("sitemap", "url").limit(most)


def sitemaps_of(hosts: DataFrame, robots: DataFrame, rules: DataFrame, ignore_robots: bool = False) -> DataFrame:
    """(host, sitemap, sitemap_blocked) of hosts(host, scheme): those that robots(host, body) names, else /sitemap.xml.

    Blocked ones are left out unless robots are ignored."""
    named = robots_sitemaps(robots)
    usual = hosts.join(named.select("host").distinct(), "host", "left_anti").select(
        "host",
        F.concat("scheme", F.lit("://"), "host", F.lit("/sitemap.xml")).alias("sitemap"),
    )
    asked = blocked(named.unionByName(usual).withColumnRenamed("sitemap", "url"), rules)
    asked = asked.select("host", F.col("url").alias("sitemap"), F.col("robotstxt_blocked").alias("sitemap_blocked"))
    return asked if ignore_robots else asked.where("NOT sitemap_blocked")


def expand_links(pages: DataFrame, follow_nofollow: bool = False) -> DataFrame:
    """(crawl_id, source, url, kind, ignore_domain) of everything that page records lead to, in one explode.

    Links are followed unless the page or the link says nofollow; `indirect` URLs and `resource` URLs always are, and
    resources on any host. Resources are also what style sheets name and what a page preloads."""
    follow = lambda x: F.lit(True) if follow_nofollow else ~x["nofollow"] & ~F.col("nofollow")
    as_kind = lambda urls_of, kind: F.transform(urls_of, lambda u: F.struct(u.alias("url"), F.lit(kind).alias("kind")))
    of = lambda column: F.transform(column, lambda x: x["url"])
    links = F.concat(*[F.transform(F.filter(c, follow), lambda x: x["url"]) for c in ("links", "external_links")])
    indirect = F.concat(of("hreflangs"), "iframes", F.array("redirect_url", "canonical"))
    resources = F.concat("scripts", "styles", "audios", of("images"), of("videos"), F.transform("videos", lambda x: x["poster"]), "dom.css_urls", "dom.preload_hrefs")
    everything = F.concat(as_kind(links, "link"), as_kind(indirect, "indirect"), as_kind(resources, "resource"))
    rows = pages.select("crawl_id", F.col("url").alias("source"), F.explode(everything).alias("x")).select("crawl_id", "source", "x.url", "x.kind")
    return rows.where("url IS NOT NULL AND url <> ''").withColumn("ignore_domain", F.col("kind") == "resource")


def blocked_rows(urls_of: DataFrame) -> DataFrame:
    """Page rows of URLs(crawl_id, url) that robots.txt keeps out: nothing but the URL is known, and no page rule runs on them."""
    return urls_of.select(
        "crawl_id",
        "url",
        urls.scheme(F.col("url")).alias("scheme"),
        F.lit(0).alias("status_code"),
        F.lit(True).alias("robotstxt_blocked"),
        F.lit(False).alias("crawled"),
    )


def reach(seeds: DataFrame, links: DataFrame, main: str, subdomains: bool = False, limit: int = 20000) -> DataFrame:
    """(url, depth) of every page that a crawl from seeds(url) admits; links(source, target) are already expanded.

    A URL is marked seen before its domain is asked for, and counts once. `limit` stops the crawl at a level's end."""
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0)).withColumn("admitted", allowed(F.col("url"), main, subdomains)).checkpoint()
    frontier, total = seen.where("admitted"), 0
    for depth in count(1):
        total += frontier.count()
        if total >= limit:
            break
        found = links.join(frontier.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).distinct()
        fresh = found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)).withColumn(
            "admitted",
            allowed(F.col("url"), main, subdomains),
        ).checkpoint()
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh).checkpoint()
        frontier = fresh.where("admitted")
    return seen.where("admitted").select("url", "depth")
