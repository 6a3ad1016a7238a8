"""CSV and sitemap exports as projections, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Headings of the page export.
PAGE_COLUMNS = [
    "Status Code",
    "URL",
    "Title",
    "Title Length",
    "Description",
    "Description Length",
    "Language",
    "H1",
    "H2",
    "Nº of words",
    "Content Type",
    "Media Type",
    "Robots",
    "Canonical",
    "Size",
    "TTFB",
    "Depth",
]


def page_reports(pages: DataFrame) -> DataFrame:
    """Lengths count characters, the size is shown in KB of 1024 bytes, ties to even."""
    return pages.select(
        F.col("status_code").alias("Status Code"), F.col("url").alias("URL"), F.col("title").alias("Title"), F.char_length("title").alias("Title Length"), F.col("description").alias("Description"), F.char_length("description").alias("Description Length"),
        F.col("lang").alias("Language"), F.col("h1").alias("H1"), F.col("h2").alias("H2"), F.col("words").alias("Nº of words"), F.col("content_type").alias("Content Type"), F.col("media_type").alias("Media Type"), F.col("robots").alias("Robots"), F.col("canonical").alias("Canonical"),
        F.format_string("%.1f KB", F.bround(F.col("size") / 1024, 1)).alias("Size"), F.format_string("%d ms", "ttfb").alias("TTFB"), F.col("depth").alias("Depth"),
    )


#: Resource -> (columns of the child table, headings after Origin)
RESOURCES = {
    "internal": (["url", "text"], ["Destination", "Text"]),
    "external": (["url", "text"], ["Destination", "Text"]),
    "images": (["url", "alt"], ["Image URL", "Alt"]),
    "scripts": (["url"], ["Script URL"]),
    "styles": (["url"], ["Style URL"]),
    "iframes": (["url"], ["Iframe URL"]),
    "audios": (["url"], ["Audio URL"]),
    "videos": (["url"], ["Video URL"]),
    "hreflangs": (["from_lang", "to_url", "to_lang"], ["Origin Language", "Hreflang", "Hreflang Language"]),
}


def resource(kind: str, rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of a child table under their page's URL; a row without its page keeps a null Origin."""
    columns, names = RESOURCES[kind]
    origin = pages.select(F.col("id").alias("pagereport_id"), "crawl_id", F.col("url").alias("Origin"))
    child = rows.select("pagereport_id", "crawl_id", *[F.col(c).alias(n) for c, n in zip(columns, names)])
    return child.join(origin, ["pagereport_id", "crawl_id"], "left").select("Origin", *names)


def all_issues(issues: DataFrame, types: DataFrame, pages: DataFrame, translations: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """URL, type (translated where a (key, text) row exists) and priority in words. ordered: most urgent first, for a sink."""
    rows = issues.join(F.broadcast(types), "issue_type_id", "left").join(
        pages.select(F.col("id").alias("pagereport_id"), "crawl_id", F.col("url").alias("URL")),
        ["pagereport_id", "crawl_id"],
        "left",
    )
    name = F.col("type")
    if translations is not None:
        rows = rows.join(translations.select(F.col("key").alias("type"), "text"), "type", "left")
        name = F.coalesce("text", "type")
    words = F.when(F.col("priority") == 1, "Critical").when(F.col("priority") == 2, "Alert").otherwise("Warning")
    if ordered:
        rows = rows.orderBy("priority", "issue_type_id", "URL")
    return rows.select("URL", name.alias("Issue Type"), words.alias("Issue Priority"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def write_sitemap(urls: DataFrame, path: str) -> None:
    urls.select(F.col("url").alias("loc")).write.mode("overwrite").format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
