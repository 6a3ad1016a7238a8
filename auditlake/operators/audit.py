"""A live audit: breadth-first crawl by levels, then the tables, the issues and the archive of what was found.

A level is fetched in the tasks and written once to the shared folder, so a lost executor never makes a page be asked for
twice from a later step; admission, robots rules and the seen-set are joins."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.issue_types import issue_types
from auditlake.operators import crawl, graph_rules, lifecycle, page_rules, reports
from auditlake.sources import fetch
from auditlake.sources.html import page_records


@dataclass(frozen=True)
class Options:
    follow_nofollow: bool = False
    include_noindex: bool = False
    ignore_robots: bool = False
    subdomains: bool = False
    crawl_sitemap: bool = False
    check_external: bool = False
    limit: int = 20000
    hours: float = 2.0
    project_id: int = 0


class Audit:
    """root: a folder that all nodes see; it keeps responses, page records, and the tables under tables/."""

    def __init__(self, spark: SparkSession, root: str, seed: str, crawl_id: int = 1, client: fetch.Client = fetch.Client(), options: Options = Options()):
        self.spark, self.root, self.seed, self.crawl_id, self.client, self.options = spark, root.rstrip("/"), seed, crawl_id, client, options
        self.steps = 0
        self.stopped = False

    def stop(self) -> None:
        """End the crawl after the level that is being fetched; what has been found is reported. For another thread."""
        self.stopped = True

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}/crawl_id={self.crawl_id}/step={self.steps}"
        self.steps += 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _texts(self, asked: DataFrame, name: str) -> DataFrame:
        """asked with the body of the 200 responses to its url."""
        got = fetch.fetch(
            asked.select(
                F.lit(self.crawl_id).cast("long").alias("crawl_id"),
                "url",
                F.lit(0).alias("depth"),
                F.lit(False).alias("in_sitemap"),
            ).distinct(),
            self.client,
        )
        return asked.join(self._keep(got.where("status_code = 200").select("url", "body"), name), "url")

    def _robots(self, hosts: DataFrame) -> DataFrame:
        return self._texts(hosts.select("host", F.concat("scheme", F.lit("://"), "host", F.lit("/robots.txt")).alias("url")), "robots").select("host", "body")

    def run(self) -> DataFrame:
        """Page records with id, blocked URLs among them; everything that the reports need is then under tables/."""
        o, spark = self.options, self.spark
        began, self.stopped = time.monotonic(), False
        lifecycle.save_crawl_row(
            spark,
            f"{self.root}/tables",
            id=self.crawl_id,
            project_id=o.project_id,
            url=self.seed,
            start=datetime.now(UTC).replace(tzinfo=None),
            end=None,
            issues_end=None,
        )
        scheme, main = self.seed.partition("://")[0], self.seed.partition("://")[2].partition("/")[0]
        start = spark.createDataFrame([(self.seed,)], "url string")
        host_of = lambda df: df.select(
            urls.authority(F.col("url")).alias("host"),
            urls.scheme(F.col("url")).alias("scheme"),
        ).groupBy("host").agg(F.min("scheme").alias("scheme"))
        known = self._keep(host_of(start), "hosts")
        robots = self._robots(known)
        mapped = self._sitemap_urls(spark.createDataFrame([(main, scheme)], "host string, scheme string"), robots)
        seen, frontier, records, kept_out = self._keep(start, "seen"), start.withColumn("depth", F.lit(0)), [], []
        total, from_sitemap = 0, False
        while True:
            asked = frontier.join(mapped.withColumn("in_sitemap", F.lit(True)), "url", "left").select(
                F.lit(self.crawl_id).cast("long").alias("crawl_id"),
                "url",
                "depth",
                F.coalesce("in_sitemap", F.lit(False)).alias("in_sitemap"),
            )
            got = self._keep(page_records(self._keep(fetch.fetch(asked, self.client), "responses"), o.follow_nofollow), "records")
            records.append(got)
            total += got.count()
            if total >= o.limit or self.stopped or time.monotonic() - began > o.hours * 3600:
                break
            led = crawl.expand_links(got, o.follow_nofollow).groupBy("url").agg(F.bool_or("ignore_domain").alias("ignore_domain"))
            fresh = self._keep(led.join(seen, "url", "left_anti"), "fresh")
            depth = -1 if from_sitemap else len(records)
            if fresh.isEmpty() and o.crawl_sitemap and not from_sitemap:
                fresh, depth, from_sitemap = self._keep(mapped.join(seen, "url", "left_anti").withColumn("ignore_domain", F.lit(True)), "fresh"), 0, True
            if fresh.isEmpty():
                break
            seen = seen.unionByName(fresh.select("url"))
            admitted = fresh.where(F.col("ignore_domain") | crawl.allowed(F.col("url"), main, o.subdomains)).select("url", F.lit(depth).alias("depth"))
            if not o.ignore_robots:
                more = self._keep(host_of(admitted).join(known, "host", "left_anti"), "hosts")
                known, robots = known.unionByName(more), robots.unionByName(self._robots(more))
                asked_of = self._keep(crawl.blocked(admitted, crawl.robots_rules(robots, self.client.agent)), "admitted")
                kept_out.append(asked_of.where("robotstxt_blocked").select(F.lit(self.crawl_id).cast("long").alias("crawl_id"), "url"))
                admitted = asked_of.where("NOT robotstxt_blocked").drop("robotstxt_blocked")
            frontier = self._keep(admitted, "frontier")
            if frontier.isEmpty() and (not o.crawl_sitemap or from_sitemap):
                break
        pages = records[0]
        for more in records[1:]:
            pages = pages.unionByName(more)
        found = {"robotstxt_exists": not robots.where(F.col("host") == main).isEmpty(), **self.sitemaps}
        return self._finish(pages, kept_out, found)

    def _sitemap_urls(self, hosts: DataFrame, robots: DataFrame) -> DataFrame:
        named = crawl.sitemaps_of(hosts, robots, crawl.robots_rules(robots, self.client.agent), True)
        named = self._keep(
            named.join(fetch.statuses(named.select(F.col("sitemap").alias("url")), self.client), F.col("sitemap") == F.col("url"), "left"),
            "named-sitemaps",
        )
        self.sitemaps = named.agg(
            F.coalesce(F.bool_or(F.col("status_code").between(200, 299)), F.lit(False)).alias("sitemap_exists"),
            F.coalesce(F.bool_or("sitemap_blocked"), F.lit(False)).alias("sitemap_blocked"),
        ).first().asDict()
        asked = named if self.options.ignore_robots else named.where("NOT sitemap_blocked")
        named = self._texts(asked.select(F.col("sitemap").alias("url")).distinct(), "sitemaps").withColumnRenamed("url", "sitemap")
        below = self._texts(crawl.sitemap_children(named).select("url").distinct(), "sitemaps").withColumnRenamed("url", "sitemap")
        return self._keep(crawl.sitemap_urls(named.unionByName(below), self.options.limit).select("url").distinct(), "sitemap-urls")

    def _finish(self, pages: DataFrame, kept_out: list[DataFrame], found: dict[str, bool]) -> DataFrame:
        o, tables = self.options, f"{self.root}/tables"
        if not o.include_noindex:
            pages = pages.where("NOT noindex")
        if o.check_external:
            outside = self._keep(fetch.statuses(pages.select(F.explode("external_links.url").alias("url")), self.client), "external")
            pages = fetch.with_external_status(pages, outside)
        with_id = lambda df: df.withColumn("id", F.xxhash64("crawl_id", "url"))
        pages = self._keep(with_id(pages), "pages")
        whole = pages
        for rows in kept_out:
            whole = whole.unionByName(with_id(crawl.blocked_rows(rows)), allowMissingColumns=True)
        lifecycle.save_crawl(whole, tables, [self.crawl_id])
        now = lambda: datetime.now(UTC).replace(tzinfo=None)
        links = reports.link_counters(pages).drop("crawl_id").first()
        counts = whole.agg(
            F.count("*").alias("total_urls"),
            F.count_if("noindex").alias("noindex"),
            F.count_if("robotstxt_blocked").alias("blocked_by_robotstxt"),
        ).first()
        lifecycle.save_crawl_row(self.spark, tables, id=self.crawl_id, end=now(), **found, **counts.asDict(), **(links.asDict() if links else {}))
        saved = {n: lifecycle.load(self.spark, tables, n, self.crawl_id) for n in ("pagereports", "links", "hreflangs")}
        lifecycle.save_issues(page_rules.page_issues(pages).unionByName(graph_rules.graph_issues(saved)), tables, [self.crawl_id])
        issues = lifecycle.load(self.spark, tables, "issues", self.crawl_id)
        lifecycle.save_crawl_row(self.spark, tables, id=self.crawl_id, issues_end=now(), **reports.issues_by_priority(issues, issue_types(self.spark)).first().asDict())
        return whole
