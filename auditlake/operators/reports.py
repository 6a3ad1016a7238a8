"""Dashboard aggregates, listings and views over the audit's tables. Every function is lazy and filters crawl_id first, so a
table partitioned by crawl_id is pruned; the 79-row dimension is broadcast, its size being fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE = 25
HTML_OK = "media_type = 'text/html' AND status_code BETWEEN 200 AND 299"
SELF = "(canonical = '' OR canonical = url)"


def of_crawl(df: DataFrame, crawl_id: int) -> DataFrame:
    return df.where(F.col("crawl_id") == crawl_id)


# aggregates


def canonical_count(pages: DataFrame) -> DataFrame:
    return pages.where(HTML_OK).agg(F.count_if(F.expr(SELF)).alias("canonical"), F.count_if(~F.expr(SELF)).alias("non_canonical"))


def image_alts(images: DataFrame) -> DataFrame:
    return images.agg(F.count_if(F.col("alt") != "").alias("alt"), F.count_if(F.col("alt") == "").alias("non_alt"))


def scheme_count(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count_if(F.col("scheme") == "https").alias("https"), F.count_if(F.col("scheme") != "https").alias("http"))


def count_by(pages: DataFrame, column: str) -> DataFrame:
    """(key, value) of crawled pages, largest first; equal counts by key."""
    return pages.where("crawled").groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "key")


def status_by_depth(pages: DataFrame) -> DataFrame:
    """Depths 1 to 8, those without a page as zeros."""
    s = F.col("status_code")
    kinds = {"status_100": s < 200, "status_200": s.between(200, 299), "status_300": s.between(300, 399), "status_400": s.between(400, 499), "status_500": s >= 500}
    found = pages.where("depth BETWEEN 1 AND 8").groupBy("depth").agg(*[F.count_if(w).alias(n) for n, w in kinds.items()])
    spine = pages.sparkSession.range(1, 9).select(F.col("id").cast("int").alias("depth"))
    return spine.join(found, "depth", "left").select("depth", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in kinds]).orderBy("depth")


def top_with_other(items: DataFrame, top: int = 4) -> DataFrame:
    """A chart's items: of more than `top`, those from the last place on become one item `Other`. items are aggregates."""
    rank = F.row_number().over(Window.orderBy(F.desc("value"), "key"))
    ranked = items.withColumn("rank", rank).withColumn("n", F.count("*").over(Window.partitionBy()))
    key = F.when((F.col("n") > top) & (F.col("rank") >= top), "Other").otherwise(F.col("key"))
    return ranked.groupBy(key.alias("key")).agg(F.sum("value").alias("value"))


def issues_by_type(issues: DataFrame, types: DataFrame, priority: int) -> DataFrame:
    return issues.join(F.broadcast(types), "issue_type_id").where(F.col("priority") == priority).groupBy("type", "priority").agg(
        F.count_distinct("pagereport_id").alias("n")
    ).orderBy(F.desc("n"), "type")


def passed_issues(issues: DataFrame, types: DataFrame) -> DataFrame:
    return types.join(
        issues.select("issue_type_id").distinct(),
        "issue_type_id",
        "left_anti",
    ).select("type", "priority", F.lit(0).cast("long").alias("n")).orderBy("type")


def issues_by_priority(issues: DataFrame, types: DataFrame) -> DataFrame:
    """Issue rows, not distinct pages, of each priority, and a total; priorities without any are zeros."""
    counted = issues.join(F.broadcast(types), "issue_type_id").agg(
        *[F.count_if(F.col("priority") == p).alias(n) for p, n in ((1, "critical"), (2, "alert"), (3, "warning"))]
    )
    return counted.withColumn("total", F.col("critical") + F.col("alert") + F.col("warning"))


def page_count(rows: DataFrame, counted: Column | None = None) -> DataFrame:
    return rows.agg(F.ceil(F.count(F.lit(1) if counted is None else counted) / PAGE_SIZE).alias("pages"))


def issue_page_count(issues: DataFrame, code: int) -> DataFrame:
    return issues.where(F.col("issue_type_id") == code).agg(F.ceil(F.count_distinct("pagereport_id") / PAGE_SIZE).alias("pages"))


def error_types_of_page(issues: DataFrame, types: DataFrame, pagereport_id: int) -> DataFrame:
    return issues.where(F.col("pagereport_id") == pagereport_id).select("issue_type_id").distinct().join(F.broadcast(types), "issue_type_id").select("type", "priority")


def crawl_counters(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Per crawl: pages, noindex and blocked pages, and links by follow; a nofollow page makes its links nofollow."""
    p = pages.groupBy("crawl_id").agg(
        F.count("*").alias("total_urls"),
        F.count_if("noindex").alias("noindex"),
        F.count_if("robotstxt_blocked").alias("blocked_by_robotstxt"),
    )
    own = links.join(pages.select(F.col("id").alias("pagereport_id"), "crawl_id", F.col("nofollow").alias("page_nofollow")), ["pagereport_id", "crawl_id"])
    no = F.col("nofollow") | F.col("page_nofollow")
    return p.join(own.groupBy("crawl_id").agg(F.count_if(~no).alias("internal_follow"), F.count_if(no).alias("internal_nofollow")), "crawl_id", "left").fillna(0)


def link_counters(records: DataFrame) -> DataFrame:
    """Per crawl, over page records: links by follow, and sponsored and user-made external links; one pass, no join."""
    no = lambda link: link["nofollow"] | F.col("nofollow")
    many = lambda column, of: F.coalesce(F.sum(F.size(F.filter(column, of))), F.lit(0)).alias
    return records.groupBy("crawl_id").agg(
        many("links", lambda x: ~no(x))("internal_follow"), many("links", no)("internal_nofollow"), many(
            "external_links",
            lambda x: ~no(x),
        )("external_follow"), many("external_links", no)("external_nofollow"),
        many("external_links", lambda x: x["sponsored"])("sponsored"), many("external_links", lambda x: x["ugc"])("ugc"),
    )


def link_totals(counters: DataFrame) -> DataFrame:
    """Sums of the follow kinds, for the chart of link types."""
    return counters.select(
        "crawl_id",
        (F.col("internal_follow") + F.col("internal_nofollow")).alias("internal"),
        (F.col("external_follow") + F.col("external_nofollow")).alias("external"),
        "sponsored",
        "ugc",
    )


def pages_by_type(issues: DataFrame) -> DataFrame:
    """(issue_type_id, n): distinct pages of each type. A page's types are the bits of a word for each 64 codes, so that a page is
    shuffled once and not once an issue."""
    word, bit = F.shiftright("issue_type_id", 6), F.expr("shiftleft(1L, CAST(issue_type_id & 63 AS INT))")
    pages = issues.where("pagereport_id IS NOT NULL").groupBy("pagereport_id", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    codes = pages.select(F.expr("explode(transform(filter(sequence(0, 63), b -> (shiftright(bits, b) & 1) = 1), b -> CAST(64 * word + b AS INT)))").alias("issue_type_id"))
    return codes.groupBy("issue_type_id").agg(F.count("*").alias("n"))


def issues_count(issues: DataFrame, types: DataFrame) -> DataFrame:
    """Every issue type with its priority and the number of its pages, zero for those that passed: one frame for the dashboard."""
    found = pages_by_type(issues)
    return F.broadcast(types).join(found, "issue_type_id", "left").select("type", "priority", F.coalesce("n", F.lit(0)).alias("n"))


#: Tabs of a page's report that go by another name than their table.
TABS = {"internal": "links", "external": "external_links"}


def tab_page_count(tables: dict[str, DataFrame], page_id: int, tab: str) -> DataFrame:
    """Pages of a tab; links are all counted, though the tab lists those with a target only."""
    tab = TABS.get(tab, tab)
    if tab in ("links", "external_links"):
        return page_count(tables[tab].where(F.col("pagereport_id") == page_id))
    one = tables["pagereports"].where(F.col("id") == page_id).select("url_hash")
    if tab == "inlinks":
        return page_count(tables["links"].join(one, "url_hash", "left_semi"))
    if tab == "redirections":
        return page_count(tables["pagereports"].join(one.select(F.col("url_hash").alias("redirect_hash")), "redirect_hash", "left_semi"))
    raise ValueError(f"no such tab: {tab}")


def index_timeline(crawls: DataFrame) -> DataFrame:
    return crawls.select("crawl_id", (F.col("total_urls") - F.col("noindex")).alias("index"), "noindex")


# listings


def page(rows: DataFrame, number: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * PAGE_SIZE).limit(PAGE_SIZE)


def paginator(number: int, total: int, empty_is_valid: bool = True) -> dict[str, int]:
    """Explorer pages accept page 1 of nothing; issue pages do not."""
    if number < 1 or (number > total and (total > 0 or not empty_is_valid)):
        raise ValueError("page out of bounds")
    return {"current": number, "previous": number - 1 if number > 1 else 0, "next": number + 1 if number < total else 0, "total": total}


def pages_with_issue(pages: DataFrame, issues: DataFrame, code: int) -> DataFrame:
    return pages.join(issues.where(F.col("issue_type_id") == code).select(F.col("pagereport_id").alias("id"), "crawl_id"), ["id", "crawl_id"], "left_semi")


#: Words that a natural-language search passes over.
STOPWORDS = "a about an are as at be by com de en for from how i in is it la of on or that the this to was what when where who will with und the www".split()


def tokens(text: Column) -> Column:
    words = F.split(F.lower(text), "[^\\p{L}\\p{N}_]+")
    return F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(STOPWORDS))


def search(pages: DataFrame, term: str) -> DataFrame:
    """Crawled pages whose URL shares a word with the term; an empty term finds all. An exact URL comes first."""
    found = pages.where("crawled")
    if term:
        found = found.where(F.arrays_overlap(tokens(F.col("url")), tokens(F.lit(term))))
    return found.orderBy((F.col("url") == term).desc(), "url", "id")


def last_crawl(crawls: DataFrame) -> DataFrame:
    """Newest crawl of each project; it is still crawling unless both ends are set."""
    newest = crawls.withColumn("rn", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("start"), F.desc("id")))).where("rn = 1").drop("rn")
    return newest.withColumn("crawling", F.col("end").isNull() | F.col("issues_end").isNull())


def last_crawls(crawls: DataFrame, limit: int = 5) -> DataFrame:
    return crawls.orderBy(F.desc("start"), F.desc("id")).limit(limit).orderBy("start", "id")


# views


def links_with_target(links: DataFrame, pages: DataFrame) -> DataFrame:
    target = pages.select("crawl_id", "url_hash", F.col("id").alias("target_id"), "status_code", "title")
    return links.join(target, ["crawl_id", "url_hash"])


def in_links(links: DataFrame, pages: DataFrame, url_hash: str) -> DataFrame:
    source = pages.select(F.col("id").alias("pagereport_id"), "crawl_id", F.col("url").alias("source"))
    return links.where(F.col("url_hash") == url_hash).join(source, ["pagereport_id", "crawl_id"]).select("pagereport_id", "source", "nofollow", "text")


def redirecting_to(pages: DataFrame, url_hash: str) -> DataFrame:
    return pages.where(F.col("redirect_hash") == url_hash).select("id", "url", "title")


def page_by_id(pages: DataFrame, page_id: int) -> DataFrame:
    """The page with `nofollow` told from its robots text, as stored pages have no such column."""
    return pages.where(F.col("id") == page_id).withColumn("nofollow", F.contains("robots", F.lit("nofollow")) | F.contains("robots", F.lit("none")))


def sitemap_pages(pages: DataFrame) -> DataFrame:
    return pages.where(f"{HTML_OK} AND coalesce({SELF}, true) AND crawled").select("url")


def page_report(tables: dict[str, DataFrame], page_id: int, tab: str, number: int = 1) -> DataFrame:
    """One tab of a page's report; the tables are those of a single crawl."""
    pages = tables["pagereports"]
    one = pages.where(F.col("id") == page_id).select("url_hash")
    own = lambda name: tables[name].where(F.col("pagereport_id") == page_id)
    if tab == "internal":
        return page(links_with_target(own("links"), pages), number, "line", "url")
    if tab == "inlinks":
        rows = tables["links"].join(one, "url_hash", "left_semi").join(
            pages.select(F.col("id").alias("pagereport_id"), "crawl_id", F.col("url").alias("source")),
            ["pagereport_id", "crawl_id"],
        )
        return page(rows.select("pagereport_id", "source", "nofollow", "text"), number, "pagereport_id", "text")
    if tab == "redirections":
        return page(pages.join(one.select(F.col("url_hash").alias("redirect_hash")), "redirect_hash", "left_semi").select("id", "url", "title"), number, "id")
    if tab in ("external", "external_links"):
        return page(own("external_links"), number, "line", "url")
    if tab in ("images", "scripts", "styles", "iframes", "audios", "videos", "hreflangs"):
        return own(tab)
    raise ValueError(f"no such tab: {tab}")


def page_report_view(tables: dict[str, DataFrame], issues: DataFrame, types: DataFrame, page_id: int, tab: str, number: int = 1) -> dict[str, DataFrame | dict[str, int]]:
    """A page's report: the page, its hreflangs, the types of its issues, the rows of one tab, and its paginator."""
    paged = tab in ("internal", "external", "inlinks", "redirections")
    total = tab_page_count(tables, page_id, tab).first()[0] if paged else 1
    return {
        "page": page_by_id(tables["pagereports"], page_id), "hreflangs": tables["hreflangs"].where(
            F.col("pagereport_id") == page_id
        ), "error_types": error_types_of_page(issues, types, page_id),
        "rows": page_report(tables, page_id, tab, number), "paginator": {
            "current": number,
            "previous": number - 1 if number > 1 else 0,
            "next": number + 1 if number < total else 0,
            "total": total,
        },
    }
