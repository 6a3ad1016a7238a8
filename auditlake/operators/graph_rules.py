"""The 18 cross-page rules. Each returns issue rows with the multiplicity of its join; crawls never mix.

Tables: pagereports (id, crawl_id, url, url_hash, redirect_hash, status_code, media_type, lang, title, description,
canonical, noindex, crawled, body_hash), links (pagereport_id, crawl_id, url_hash, nofollow), hreflangs (pagereport_id,
crawl_id, to_lang, from_hash, to_hash). Joins are equi-joins on (crawl_id, hash), so AQE may broadcast, split or coalesce;
semi and anti joins are written as such. What is shuffled are ids and 16 bytes in place of a hash or text (`_key`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class GraphRule:
    code: int
    name: str
    find: Callable[[Tables], DataFrame]
    default: bool = True


HTML_OK = "media_type = 'text/html' AND status_code BETWEEN 200 AND 299"
NON_CANONICAL = "canonical <> '' AND canonical <> url"
SELF = "(canonical = '' OR canonical = url)"
IDS = ["id", "crawl_id"]


def _key(column: str) -> Column:
    """128 bits of a text's SHA-256, by which texts of any length and hashes in hex are compared."""
    return F.substring(F.unhex(F.sha2(column, 256)), 1, 16)


def _same(column: str, outer: str) -> Callable[[Tables], DataFrame]:
    def find(t: Tables) -> DataFrame:
        p = t["pagereports"]
        own = [*IDS, _key(column).alias("key"), "lang"]
        groups = p.where(f"{HTML_OK} AND {SELF} AND crawled").select(*own).groupBy("crawl_id", "key", "lang").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        return p.where(f"{HTML_OK} AND octet_length({column}) > 0 AND {outer}").select(*own).join(groups, ["crawl_id", "key", "lang"]).select(*IDS)

    return find


def duplicated_content(t: Tables) -> DataFrame:
    p = t["pagereports"].where("media_type = 'text/html' AND body_hash <> ''").select(*IDS, _key("body_hash").alias("key"))
    return p.join(p.groupBy("crawl_id", "key").agg(F.count("*").alias("n")).where("n > 1"), ["crawl_id", "key"], "left_semi").select(*IDS)


def _redirects(t: Tables) -> DataFrame:
    return t["pagereports"].where("redirect_hash <> '' AND crawled").select(*IDS, _key("url_hash").alias("url_hash"), _key("redirect_hash").alias("redirect_hash"))


def _pages(t: Tables, where: str = "true") -> DataFrame:
    return t["pagereports"].where(where).select(*IDS, _key("url_hash").alias("url_hash"))


def redirect_chains(t: Tables) -> DataFrame:
    a = _redirects(t)
    return a.join(a.select("crawl_id", F.col("url_hash").alias("redirect_hash")), ["crawl_id", "redirect_hash"]).select(*IDS)


def redirect_loops(t: Tables) -> DataFrame:
    a = _redirects(t)
    return a.join(
        a.select("crawl_id", F.col("url_hash").alias("redirect_hash"), F.col("redirect_hash").alias("url_hash")),
        ["crawl_id", "redirect_hash", "url_hash"],
    ).select(*IDS)


def orphans(t: Tables) -> DataFrame:
    return _pages(t, "media_type = 'text/html'").join(t["links"].select("crawl_id", _key("url_hash").alias("url_hash")).distinct(), ["crawl_id", "url_hash"], "left_anti").select(*IDS)


def nofollow_indexable(t: Tables) -> DataFrame:
    links = t["links"].where("nofollow").select("pagereport_id", "crawl_id", _key("url_hash").alias("url_hash")).distinct()
    targets = _pages(t, "crawled AND NOT noindex").drop("id")
    return links.join(targets, ["crawl_id", "url_hash"]).select(F.col("pagereport_id").alias("id"), "crawl_id")


def follow_nofollow(t: Tables) -> DataFrame:
    both = t["links"].groupBy("crawl_id", _key("url_hash").alias("url_hash")).agg(F.min("nofollow").alias("a"), F.max("nofollow").alias("b")).where("a <> b")
    return _pages(t).join(both, ["crawl_id", "url_hash"], "left_semi").select(*IDS)


def hreflang_return(t: Tables) -> DataFrame:
    h = t["hreflangs"]
    asking = h.where("to_lang <> 'x-default'").select("pagereport_id", "crawl_id", _key("from_hash").alias("from_hash")).distinct()
    lone = asking.join(h.select("crawl_id", _key("to_hash").alias("from_hash")).distinct(), ["crawl_id", "from_hash"], "left_anti")
    pages = t["pagereports"].where(f"status_code < 300 AND {SELF} AND crawled")
    return pages.join(lone.select("crawl_id", F.col("pagereport_id").alias("id")), IDS, "left_semi").select(*IDS).distinct()


def hreflang_to_non_canonical(t: Tables) -> DataFrame:
    pages = _pages(t, f"{HTML_OK} AND crawled AND {NON_CANONICAL}")
    return pages.join(t["hreflangs"].select("crawl_id", _key("to_hash").alias("url_hash")), ["crawl_id", "url_hash"]).select(*IDS)


def hreflang_no_indexable(t: Tables) -> DataFrame:
    return t["pagereports"].where("noindex AND crawled").join(t["hreflangs"].select("crawl_id", F.col("pagereport_id").alias("id")), IDS, "left_semi").select(*IDS)


def _languages(t: Tables) -> DataFrame:
    """(crawl_id, url_hash, several): whether alternates of more than one language lead to a page."""
    langs = t["hreflangs"].where("to_lang <> 'x-default'").groupBy("crawl_id", _key("to_hash").alias("url_hash")).agg(F.min("to_lang").alias("a"), F.max("to_lang").alias("b"))
    return langs.select("crawl_id", "url_hash", (F.col("a") != F.col("b")).alias("several"))


def multiple_lang_reference(t: Tables) -> DataFrame:
    return _pages(t).join(_languages(t).where("several"), ["crawl_id", "url_hash"], "left_semi").select(*IDS)


def canonicalized_to_non_canonical(t: Tables) -> DataFrame:
    p = t["pagereports"].where("crawled")
    own = p.where(NON_CANONICAL).select(*IDS, _key("url").alias("url"))
    return own.join(p.where("canonical <> ''").select("crawl_id", _key("canonical").alias("url")), ["crawl_id", "url"]).select(*IDS)


def canonicalized_to_non_indexable(t: Tables) -> DataFrame:
    p = t["pagereports"]
    bad = p.where(NON_CANONICAL).select("crawl_id", _key("url").alias("canonical"))
    return p.where("noindex").select(*IDS, _key("canonical").alias("canonical")).join(bad, ["crawl_id", "canonical"], "left_semi").select(*IDS)


def _hreflang_to(status: str) -> Callable[[Tables], DataFrame]:
    def find(t: Tables) -> DataFrame:
        targets = t["pagereports"].where(status).select("crawl_id", _key("url_hash").alias("to_hash"))
        own = t["hreflangs"].select("crawl_id", F.col("pagereport_id").alias("id"), _key("to_hash").alias("to_hash")).join(targets, ["crawl_id", "to_hash"]).select("crawl_id", "id")
        return t["pagereports"].join(own, IDS).select(*IDS)

    return find


def _canonical_to(status: str) -> Callable[[Tables], DataFrame]:
    def find(t: Tables) -> DataFrame:
        targets = t["pagereports"].where(status).select("crawl_id", _key("url").alias("canonical"))
        return t["pagereports"].where("canonical <> ''").select(*IDS, _key("canonical").alias("canonical")).join(targets, ["crawl_id", "canonical"]).select(*IDS)

    return find


#: Codes 39 to 42 are written here as they were meant, and are off by default.
GRAPH_RULES = [
    GraphRule(59, "duplicated_content", duplicated_content),
    GraphRule(14, "redirect_chain", redirect_chains),
    GraphRule(23, "redirect_loop", redirect_loops),
    GraphRule(4, "duplicated_title", _same("title", f"{SELF} AND crawled")),
    # the outer filter of this rule asks for `crawled` only where the canonical is the page itself
    GraphRule(5, "duplicated_description", _same("description", "(canonical = '' OR (canonical = url AND crawled))")),
    GraphRule(30, "orphan", orphans),
    GraphRule(26, "nofollow_indexable", nofollow_indexable),
    GraphRule(34, "follow_nofollow", follow_nofollow),
    GraphRule(18, "hreflang_return", hreflang_return),
    GraphRule(25, "hreflang_to_non_canonical", hreflang_to_non_canonical),
    GraphRule(28, "hreflang_no_indexable", hreflang_no_indexable),
    GraphRule(58, "multiple_lang_reference", multiple_lang_reference),
    GraphRule(22, "canonicalized_non_canonical", canonicalized_to_non_canonical),
    GraphRule(38, "canonicalized_non_indexable", canonicalized_to_non_indexable),
    GraphRule(39, "hreflang_redirect", _hreflang_to("status_code BETWEEN 300 AND 399"), False),
    GraphRule(41, "hreflang_error", _hreflang_to("status_code >= 400"), False),
    GraphRule(40, "canonical_redirect", _canonical_to("status_code BETWEEN 300 AND 399"), False),
    GraphRule(42, "canonical_error", _canonical_to("status_code >= 400"), False),
]


#: Rules that ask what leads to a page, and of which a page breaks each once: they share one pass over links and one over hreflangs.
BY_TARGET = (30, 34, 58)
#: Rules that compare a page with another by its canonical or its hreflangs, once for each such pair: they share their join.
BY_CANONICAL, BY_HREFLANG = (22, 40, 42), (25, 39, 41)
#: Rules about a page's redirect and the next one, and about a page's own alternates.
BY_REDIRECT, BY_ALTERNATES = (14, 23), (18, 28)


def _exploded(rows: DataFrame, when: dict[int, str], codes: set[int]) -> DataFrame:
    fired = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(F.expr(w), F.lit(False)),
                    F.struct(F.lit(c).alias("code"), F.expr(of).alias("id")),
                ) for c, (w, of) in when.items() if c in codes
            ]
        )
    )
    return rows.select("crawl_id", F.explode(fired).alias("x")).select(F.col("x.id").alias("pagereport_id"), "crawl_id", F.col("x.code").alias("issue_type_id"))


def by_target(t: Tables, codes: set[int]) -> DataFrame:
    links = t["links"].groupBy("crawl_id", _key("url_hash").alias("url_hash")).agg(F.min("nofollow").alias("least"), F.max("nofollow").alias("most"), F.lit(True).alias("linked"))
    html = F.coalesce(F.col("media_type") == "text/html", F.lit(False)).alias("html")
    rows = t["pagereports"].select(*IDS, _key("url_hash").alias("url_hash"), html)
    if codes & {30, 34}:
        rows = rows.join(links, ["crawl_id", "url_hash"], "left")
    if 58 in codes:
        rows = rows.join(_languages(t), ["crawl_id", "url_hash"], "left")
    return _exploded(rows, {30: ("html AND linked IS NULL", "id"), 34: ("least <> most", "id"), 58: ("several", "id")}, codes)


def by_canonical(t: Tables, codes: set[int]) -> DataFrame:
    """Pairs of a page with a canonical (a) and the page that it names (b)."""
    p = t["pagereports"]
    a = p.where("canonical <> ''").select("crawl_id", F.col("id").alias("a"), F.col("crawled").alias("a_crawled"), _key("canonical").alias("url"))
    b = p.select(
        "crawl_id",
        _key("url").alias("url"),
        F.col("id").alias("b"),
        F.col("crawled").alias("b_crawled"),
        F.expr(NON_CANONICAL).alias("other"),
        F.col("status_code").alias("status"),
    )
    return _exploded(
        a.join(b, ["crawl_id", "url"]),
        {22: ("a_crawled AND b_crawled AND other", "b"), 40: ("status BETWEEN 300 AND 399", "a"), 42: ("status >= 400", "a")},
        codes,
    )


def by_hreflang(t: Tables, codes: set[int]) -> DataFrame:
    """Pairs of a page with an alternate (a) and the page that this is (b); only pages that can break a rule are met."""
    wanted = " OR ".join(
        w for c, w in {
            25: f"{HTML_OK} AND crawled AND {NON_CANONICAL}",
            39: "status_code BETWEEN 300 AND 399",
            41: "status_code >= 400",
        }.items() if c in codes
    )
    b = t["pagereports"].where(wanted).select(
        "crawl_id",
        _key("url_hash").alias("to_hash"),
        F.col("id").alias("b"),
        F.col("status_code").alias("status"),
        F.expr(f"{HTML_OK} AND crawled AND {NON_CANONICAL}").alias("other"),
    )
    a = t["hreflangs"].select("crawl_id", _key("to_hash").alias("to_hash"), F.col("pagereport_id").alias("a"))
    if codes & {39, 41}:
        known = t["pagereports"].select("crawl_id", F.col("id").alias("a"), F.lit(True).alias("known"))
        a = a.join(known, ["crawl_id", "a"], "left")
    return _exploded(
        a.join(b, ["crawl_id", "to_hash"]),
        {25: ("other", "b"), 39: ("known AND status BETWEEN 300 AND 399", "a"), 41: ("known AND status >= 400", "a")},
        codes,
    )


def by_redirect(t: Tables, codes: set[int]) -> DataFrame:
    """Pairs of a redirect and the redirect that it leads to."""
    a = _redirects(t)
    b = a.select("crawl_id", F.col("url_hash").alias("redirect_hash"), F.col("redirect_hash").alias("back"))
    return _exploded(a.join(b, ["crawl_id", "redirect_hash"]), {14: ("true", "id"), 23: ("back = url_hash", "id")}, codes)


def by_alternates(t: Tables, codes: set[int]) -> DataFrame:
    """Pages with alternates, and whether one of these is of a page that no alternate leads back to."""
    h = t["hreflangs"]
    led_to = h.select("crawl_id", _key("to_hash").alias("from_hash")).distinct().withColumn("linked", F.lit(True))
    # a page's alternates are folded before they are dealt out
    asks = F.max(F.expr("coalesce(to_lang <> 'x-default', false)")).alias("asks")
    each = h.groupBy("crawl_id", F.col("pagereport_id").alias("id"), _key("from_hash").alias("from_hash")).agg(asks)
    own = each.join(led_to, ["crawl_id", "from_hash"], "left").groupBy(*IDS).agg(F.max(F.expr("asks AND linked IS NULL")).alias("lone"))
    pages = t["pagereports"].select(*IDS, F.expr(f"status_code < 300 AND {SELF} AND crawled").alias("whole"), F.expr("noindex AND crawled").alias("hidden"))
    return _exploded(pages.where("whole OR hidden").join(own, IDS), {18: ("lone AND whole", "id"), 28: ("hidden", "id")}, codes)


SHARED = {BY_TARGET: by_target, BY_CANONICAL: by_canonical, BY_HREFLANG: by_hreflang, BY_REDIRECT: by_redirect, BY_ALTERNATES: by_alternates}


def graph_issues(tables: Tables, rules: list[GraphRule] | None = None) -> DataFrame:
    """issues(pagereport_id, crawl_id, issue_type_id) of all given rules, the registered ones by default. Rules that need the
    same join are found by one; the tables are read several times, so they should be stored."""
    rules = [r for r in GRAPH_RULES if r.default] if rules is None else rules
    out = None
    for group, find in SHARED.items():
        codes = {r.code for r in rules if r.code in group}
        if len(codes) > 1:
            rules = [r for r in rules if r.code not in codes]
            rows = find(tables, codes).select("pagereport_id", "crawl_id", "issue_type_id")
            out = rows if out is None else out.unionByName(rows)
    for rule in rules:
        rows = rule.find(tables).select(F.col("id").alias("pagereport_id"), "crawl_id", F.lit(rule.code).alias("issue_type_id"))
        out = rows if out is None else out.unionByName(rows)
    return out
