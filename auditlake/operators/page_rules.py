"""The 61 single-page rules as Catalyst expressions, evaluated in one projection over page records.

A page record is what sources.html.parse() returns: one row with the nested arrays `links`, `external_links`,
`internal_links`, `images`, `hreflangs`, the struct `dom` and the map `headers` (lower-case keys to arrays).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import mime, urls
from auditlake.functions.languages import valid_tag


@dataclass(frozen=True)
class Rule:
    code: int
    name: str
    when: str | Callable[[], Column]  # called where a session is at hand

    @property
    def column(self) -> Column:
        return F.coalesce(F.expr(self.when) if isinstance(self.when, str) else self.when(), F.lit(False))


HTML = "crawled AND media_type = 'text/html'"
OK = HTML + " AND status_code BETWEEN 200 AND 299"
NOT_3XX = HTML + " AND NOT (status_code BETWEEN 300 AND 399)"
HEADER = "coalesce(try_element_at(try_element_at(headers, '{}'), 1), '')"
#: The last Link entry whose one parameter names it canonical.
LINK_CANONICAL = "try_element_at(filter(transform(split(" + HEADER.format("link") + r""", ','), e -> regexp_extract(e, '^\\s*<([^>]*)>\\s*;\\s*rel="?canonical"?\\s*$', 1)), e -> e <> ''), -1)"""
RELATIVE = "NOT ({0} RLIKE '^[a-zA-Z][a-zA-Z0-9+.-]*:')"


def invalid_language() -> Column:
    """Whether one of the page's languages, parted by commas, is no tag of registered subtags."""
    return F.expr(f"{NOT_3XX} AND lang <> '' AND exists(split(lang, ','), x -> NOT {valid_tag('x')})")


def dom_size(most: int) -> Rule:
    """A rule made from a parameter: pages with more than `most` elements."""
    return Rule(77, "dom_size", f"{OK} AND dom.n_elements > {int(most)}")


def page_rules(strict: bool = False, most_elements: int = 1500) -> list[Rule]:
    """strict: apply what rules 20 and 33 are named for, where the audit's own predicates differ."""
    r = Rule
    http = lambda array, at: f"exists({array}, x -> x.{at} LIKE 'http://%')"
    return [
        r(1, "status_30x", "crawled AND status_code BETWEEN 300 AND 399"),
        r(2, "status_40x", "crawled AND status_code BETWEEN 400 AND 499"),
        r(3, "status_50x", "crawled AND status_code >= 500"),
        r(6, "empty_title", f"{OK} AND title = ''"),
        r(7, "short_title", f"{HTML} AND octet_length(title) BETWEEN 1 AND 19"),
        r(8, "long_title", f"{HTML} AND octet_length(title) > 60"),
        r(55, "multiple_titles", f"{HTML} AND dom.n_head_title > 1"),
        r(9, "empty_description", f"{OK} AND description = ''"),
        r(10, "short_description", f"{OK} AND octet_length(description) BETWEEN 1 AND 79"),
        r(11, "long_description", f"{OK} AND octet_length(description) > 160"),
        r(56, "multiple_descriptions", f"{HTML} AND dom.n_head_meta_description > 1"),
        r(27, "no_indexable", "noindex"),
        r(29, "blocked", "robotstxt_blocked"),
        r(31, "noindex_in_sitemap", "in_sitemap AND noindex"),
        r(32, "blocked_in_sitemap", "in_sitemap AND robotstxt_blocked"),
        r(33, "non_canonical_in_sitemap", f"{HTML} AND canonical <> '' AND canonical <> url" + " AND in_sitemap" * strict),
        r(43, "multiple_canonical_tags", f"{HTML} AND dom.n_head_canonical > 1"),
        r(44, "relative_canonical", f"{HTML} AND dom.n_head_canonical > 0 AND {RELATIVE.format('dom.first_canonical_href')}"),
        r(49, "canonical_mismatch", f"{HTML} AND dom.n_head_canonical > 0 AND dom.first_canonical_href <> {LINK_CANONICAL}"),
        r(57, "page_depth", "media_type = 'text/html' AND status_code BETWEEN 200 AND 299 AND depth > 4"),
        r(72, "nosnippet", f"{HTML} AND (contains(robots, 'nosnippet') OR contains(robots, 'max-snippet:0'))"),
        r(71, "metas_in_body", f"{HTML} AND dom.n_body_child_meta > 0"),
        r(19, "too_many_links", f"{OK} AND size(links) > 100"),
        r(
            20,
            "internal_nofollow",
            f"{OK} AND ((nofollow AND size({'links' if strict else 'internal_links'}) > 0) "
            f"OR exists({'links' if strict else 'internal_links'}, x -> x.nofollow))",
        ),
        r(21, "external_without_nofollow", f"{OK} AND NOT nofollow AND exists(external_links, x -> NOT x.nofollow)"),
        r(17, "http_links", f"{OK} AND {http('links', 'url')}"),
        r(37, "dead_end", f"{OK} AND size(links) + size(external_links) = 0"),
        r(60, "external_link_redirect", f"{HTML} AND exists(external_links, x -> x.status_code BETWEEN 300 AND 399)"),
        r(61, "external_link_broken", f"{HTML} AND exists(external_links, x -> x.status_code < 0 OR x.status_code > 399)"),
        r(
            79,
            "localhost_links",
            lambda: F.expr(HTML) & ~urls.authority(F.col("url")).isin("localhost", "127.0.0.1") & F.exists(
                "external_links",
                lambda x: urls.authority(x["url"]).isin("localhost", "127.0.0.1"),
            ),
        ),
        r(13, "images_no_alt", f"{HTML} AND exists(images, x -> x.alt = '')"),
        r(54, "long_alt_text", f"{HTML} AND exists(images, x -> char_length(x.alt) > 100)"),
        r(53, "large_image", "media_type LIKE 'image%' AND size > 500000"),
        r(69, "noimageindex", f"{HTML} AND contains(robots, 'noimageindex')"),
        r(70, "picture_missing_img", f"{HTML} AND dom.picture_without_img"),
        r(73, "img_size_attr", f"{HTML} AND dom.img_missing_size"),
        Rule(35, "invalid_lang", invalid_language),
        r(16, "no_lang", f"{NOT_3XX} AND lang = ''"),
        r(45, "hreflang_xdefault", f"{HTML} AND size(hreflangs) > 0 AND NOT exists(hreflangs, x -> x.lang = 'x-default')"),
        r(46, "hreflang_self_reference", f"{HTML} AND size(hreflangs) > 0 AND NOT exists(hreflangs, x -> x.url = url)"),
        r(47, "hreflang_mismatching_lang", f"{HTML} AND lang <> '' AND exists(hreflangs, x -> x.url = url AND x.lang <> 'x-default' AND x.lang <> lang)"),
        r(48, "hreflang_relative_url", f"{HTML} AND exists(dom.alternate_hrefs, x -> {RELATIVE.format('x')})"),
        r(15, "no_h1", f"{HTML} AND h1 = ''"),
        r(24, "not_valid_headings", f"{HTML} AND exists(zip_with(dom.heading_levels, concat(array(0), dom.heading_levels), (x, p) -> x > p + 1), b -> b)"),
        r(12, "little_content", f"{OK} AND words < 200"),
        r(74, "incorrect_media_type", lambda: mime.mismatch(F.col("url"), F.col("media_type"))),
        r(75, "duplicated_id", f"{OK} AND dom.has_duplicate_id"),
        dom_size(most_elements),
        r(78, "pagination_links", f"{NOT_3XX} AND exists(dom.pagination_hrefs, p -> NOT exists(links, x -> x.url = p))"),
        r(36, "http_scheme", "crawled AND status_code BETWEEN 200 AND 299 AND url LIKE 'http://%'"),
        r(
            50,
            "missing_hsts",
            f"{HEADER.format('strict-transport-security')} = '' OR exists(split({HEADER.format('strict-transport-security')}, ';'), "
            f"x -> startswith(x, 'max-age=') AND try_cast(substr(x, 9) AS BIGINT) IS NULL)",
        ),
        r(51, "missing_csp", f"media_type = 'text/html' AND NOT dom.has_csp_meta AND {HEADER.format('content-security-policy')} = ''"),
        r(52, "content_type_options", f"media_type = 'text/html' AND {HEADER.format('x-content-type-options')} <> 'nosniff'"),
        r(62, "timeout", "timeout"),
        r(63, "underscore_url", "contains(url, '_')"),
        r(67, "space_url", "contains(url, ' ')"),
        r(68, "multiple_slashes", lambda: F.contains(urls.path(F.col("url")), F.lit("//"))),
        r(64, "slow_ttfb", "ttfb > 800"),
        r(65, "http_form", f"{HTML} AND url NOT LIKE 'https://%' AND size(dom.form_actions) > 0"),
        r(66, "insecure_form", f"{HTML} AND exists(dom.form_actions, x -> x LIKE 'http://%')"),
        r(76, "missing_viewport", f"{HTML} AND coalesce(dom.viewport_content, '') = ''"),
    ]


def page_issues(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """issues(pagereport_id, crawl_id, issue_type_id): all rules in one scan and one projection, then one generator."""
    rules = page_rules() if rules is None else rules
    fired = F.array_compact(F.array(*[F.when(r.column, F.lit(r.code)) for r in rules]))
    return pages.select(F.col("id").alias("pagereport_id"), "crawl_id", F.explode(fired).alias("issue_type_id"))
