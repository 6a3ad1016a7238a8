"""The rules once more, in DuckDB SQL over the flat synthetic facts and tables: the oracle's own formulation."""

from __future__ import annotations

from auditlake.plans.fixtures import duck

HTML = "crawled AND media_type = 'text/html'"
OK = HTML + " AND status_code >= 200 AND status_code < 300"
NOT_3XX = HTML + " AND (status_code < 300 OR status_code >= 400)"
EXT = r"regexp_extract(regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1), '\.([^./]*)$', 1)"

PAGE_RULE_SQL = {
    1: "crawled AND status_code >= 300 AND status_code < 400",
    2: "crawled AND status_code >= 400 AND status_code < 500",
    3: "crawled AND status_code >= 500",
    6: f"{OK} AND title = ''",
    7: f"{HTML} AND strlen(title) > 0 AND strlen(title) < 20",
    8: f"{HTML} AND strlen(title) > 60",
    9: f"{OK} AND description = ''",
    10: f"{OK} AND strlen(description) > 0 AND strlen(description) < 80",
    11: f"{OK} AND strlen(description) > 160",
    12: f"{OK} AND words < 200",
    13: f"{HTML} AND n_images > 0 AND alt_length = 0",
    15: f"{HTML} AND h1 = ''",
    16: f"{NOT_3XX} AND lang = ''",
    17: f"{OK} AND n_links > 0 AND http_link",
    19: f"{OK} AND n_links > 100",
    20: "false",
    21: f"{OK} AND NOT nofollow AND n_external > 0 AND NOT external_nofollow",
    24: f"{HTML} AND (level > 1 OR 1 > level + 1 OR 3 > 2)",
    27: "noindex",
    29: "robotstxt_blocked",
    31: "in_sitemap AND noindex",
    32: "in_sitemap AND robotstxt_blocked",
    33: f"{HTML} AND canonical <> '' AND canonical <> url",
    35: f"{NOT_3XX} AND lang IN ('e1', 'en, fr')",
    36: "crawled AND status_code >= 200 AND status_code < 300 AND scheme = 'http'",
    37: f"{OK} AND n_links + n_external = 0",
    43: f"{HTML} AND n_head_canonical > 1",
    44: f"{HTML} AND n_head_canonical > 0 AND first_canonical_href NOT LIKE 'https:%'",
    45: f"{HTML} AND hreflang_kind IN (1, 2)",
    46: f"{HTML} AND hreflang_kind = 2",
    47: f"{HTML} AND lang <> '' AND ((hreflang_kind = 0 AND lang <> 'en') OR (hreflang_kind = 1 AND lang <> 'fr'))",
    48: f"{HTML} AND alternate NOT LIKE 'https:%'",
    49: f"{HTML} AND n_head_canonical > 0 AND link_header <> '' AND concat('<', first_canonical_href, '>; rel=\"canonical\"') <> link_header",
    50: "hsts = '' OR hsts LIKE 'max-age=x%'",
    51: "media_type = 'text/html' AND NOT has_csp_meta AND csp = ''",
    52: "media_type = 'text/html' AND nosniff <> 'nosniff'",
    53: "starts_with(media_type, 'image') AND size > 500000",
    54: f"{HTML} AND n_images > 0 AND alt_length > 100",
    55: f"{HTML} AND n_head_title > 1",
    56: f"{HTML} AND n_head_meta_description > 1",
    57: "media_type = 'text/html' AND status_code >= 200 AND status_code < 300 AND depth > 4",
    60: f"{HTML} AND n_external > 0 AND external_status >= 300 AND external_status < 400",
    61: f"{HTML} AND n_external > 0 AND (external_status < 0 OR external_status > 399)",
    62: "timeout",
    63: "position('_' IN url) > 0",
    64: "ttfb > 800",
    65: f"{HTML} AND scheme <> 'https' AND form > 0",
    66: f"{HTML} AND form = 1",
    67: "position(' ' IN url) > 0",
    68: "regexp_matches(url, '://.*//')",
    69: f"{HTML} AND robots LIKE '%noimageindex%'",
    70: f"{HTML} AND picture_without_img",
    71: f"{HTML} AND n_body_child_meta > 0",
    72: f"{HTML} AND (robots LIKE '%nosnippet%' OR robots LIKE '%max-snippet:0%')",
    73: f"{HTML} AND img_missing_size",
    74: f"media_type = '' OR CASE {EXT} WHEN 'js' THEN media_type NOT IN ('text/javascript', 'application/javascript') WHEN 'png' THEN media_type <> 'image/png' WHEN 'html' THEN media_type <> 'text/html' WHEN '' THEN media_type <> 'text/html' ELSE false END",
    75: f"{OK} AND has_duplicate_id",
    76: f"{HTML} AND viewport = ''",
    77: f"{OK} AND n_elements > 1500",
    78: f"{NOT_3XX} AND pagination > 0 AND (http_link OR pagination > n_links)",
    79: f"{HTML} AND url NOT LIKE '%://localhost/%' AND n_external > 0 AND external_local",
}

HTML_OK = "media_type = 'text/html' AND status_code >= 200 AND status_code < 300"
SELF = "(canonical = '' OR canonical = url)"
OTHER = "canonical <> '' AND canonical <> url"


def _same(column: str, outer: str) -> str:
    return (
        f"SELECT y.id, y.crawl_id FROM pagereports y JOIN (SELECT crawl_id, {column}, lang FROM pagereports WHERE {HTML_OK} AND {SELF} AND crawled GROUP BY ALL HAVING count(*) > 1) d "
        f"ON d.crawl_id = y.crawl_id AND d.{column} = y.{column} AND d.lang = y.lang WHERE {HTML_OK} AND strlen(y.{column}) > 0 AND ({outer})"
    )


P, L, H = ("pagereports",), ("pagereports", "links"), ("pagereports", "hreflangs")
GRAPH_RULE_SQL = {
    59: (
        P,
        "SELECT id, crawl_id FROM pagereports p WHERE media_type = 'text/html' AND body_hash <> '' AND (SELECT count(*) FROM pagereports q "
        "WHERE q.crawl_id = p.crawl_id AND q.body_hash = p.body_hash AND q.media_type = 'text/html') > 1",
    ),
    14: (
        P,
        "SELECT a.id, a.crawl_id FROM pagereports a JOIN pagereports b ON a.crawl_id = b.crawl_id AND a.redirect_hash = b.url_hash "
        "WHERE a.redirect_hash <> '' AND b.redirect_hash <> '' AND a.crawled AND b.crawled",
    ),
    23: (
        P,
        "SELECT a.id, a.crawl_id FROM pagereports a JOIN pagereports b ON a.crawl_id = b.crawl_id AND a.redirect_hash = b.url_hash "
        "AND b.redirect_hash = a.url_hash WHERE a.crawled AND b.crawled",
    ),
    4: (P, _same("title", "(y.canonical = '' OR y.canonical = y.url) AND y.crawled")),
    5: (P, _same("description", "y.canonical = '' OR y.canonical = y.url AND y.crawled")),
    30: (
        L,
        "SELECT p.id, p.crawl_id FROM pagereports p LEFT JOIN links l ON l.crawl_id = p.crawl_id AND l.url_hash = p.url_hash "
        "WHERE p.media_type = 'text/html' AND l.url IS NULL",
    ),
    26: (
        L,
        "SELECT a.pagereport_id AS id, a.crawl_id FROM (SELECT DISTINCT pagereport_id, crawl_id, url_hash FROM links WHERE nofollow) a "
        "JOIN pagereports p ON p.crawl_id = a.crawl_id AND p.url_hash = a.url_hash WHERE p.crawled AND NOT p.noindex",
    ),
    34: (L, "SELECT id, crawl_id FROM pagereports WHERE (crawl_id, url_hash) IN (SELECT crawl_id, url_hash FROM links GROUP BY ALL HAVING count(DISTINCT nofollow) > 1)"),
    18: (
        H,
        f"SELECT DISTINCT p.id, p.crawl_id FROM hreflangs h LEFT JOIN hreflangs b ON h.crawl_id = b.crawl_id AND h.from_hash = b.to_hash "
        f"JOIN pagereports p ON p.id = h.pagereport_id WHERE h.to_lang <> 'x-default' AND b.to_hash IS NULL AND p.status_code < 300 "
        f"AND {SELF} AND p.crawled",
    ),
    25: (H, f"SELECT p.id, p.crawl_id FROM pagereports p JOIN hreflangs h ON h.crawl_id = p.crawl_id AND h.to_hash = p.url_hash WHERE {HTML_OK} AND {OTHER} AND crawled"),
    28: (H, "SELECT id, crawl_id FROM pagereports WHERE noindex AND crawled AND id IN (SELECT pagereport_id FROM hreflangs)"),
    58: (
        H,
        "SELECT id, crawl_id FROM pagereports WHERE (crawl_id, url_hash) IN (SELECT crawl_id, to_hash FROM hreflangs "
        "WHERE to_lang <> 'x-default' GROUP BY ALL HAVING count(DISTINCT to_lang) > 1)",
    ),
    22: (
        P,
        "SELECT a.id, a.crawl_id FROM pagereports a JOIN pagereports b ON a.crawl_id = b.crawl_id AND a.url = b.canonical "
        "WHERE a.canonical <> '' AND a.canonical <> a.url AND a.crawled AND b.crawled",
    ),
    38: (P, f"SELECT id, crawl_id FROM pagereports WHERE noindex AND (crawl_id, canonical) IN (SELECT crawl_id, url FROM pagereports WHERE {OTHER})"),
    39: (
        H,
        "SELECT h.pagereport_id AS id, h.crawl_id FROM hreflangs h JOIN pagereports p ON p.crawl_id = h.crawl_id "
        "AND p.url_hash = h.to_hash WHERE p.status_code >= 300 AND p.status_code < 400",
    ),
    41: (
        H,
        "SELECT h.pagereport_id AS id, h.crawl_id FROM hreflangs h JOIN pagereports p ON p.crawl_id = h.crawl_id "
        "AND p.url_hash = h.to_hash WHERE p.status_code >= 400",
    ),
    40: (
        P,
        "SELECT a.id, a.crawl_id FROM pagereports a JOIN pagereports b ON a.crawl_id = b.crawl_id AND a.canonical = b.url "
        "WHERE a.canonical <> '' AND b.status_code >= 300 AND b.status_code < 400",
    ),
    42: (
        P,
        "SELECT a.id, a.crawl_id FROM pagereports a JOIN pagereports b ON a.crawl_id = b.crawl_id AND a.canonical = b.url "
        "WHERE a.canonical <> '' AND b.status_code >= 400",
    ),
}


def page_rule(code: int) -> str:
    return f"{duck('pagereports')} SELECT id AS pagereport_id, crawl_id, CAST({code} AS INT) AS issue_type_id FROM pagereports WHERE {PAGE_RULE_SQL[code]}"


def graph_rule(code: int) -> str:
    names, sql = GRAPH_RULE_SQL[code]
    return f"{duck(*names)} SELECT id AS pagereport_id, crawl_id, CAST({code} AS INT) AS issue_type_id FROM ({sql})"


def all_issues() -> str:
    """WITH clause that ends in a table `issues` of all registered rules, and in the tables it is made from."""
    rows = [f"SELECT id AS pagereport_id, crawl_id, {c} AS issue_type_id FROM pagereports WHERE {w}" for c, w in PAGE_RULE_SQL.items()]
    rows += [f"SELECT id AS pagereport_id, crawl_id, {c} AS issue_type_id FROM ({sql})" for c, (_, sql) in GRAPH_RULE_SQL.items() if c not in (39, 40, 41, 42)]
    return f"{duck('pagereports', 'links', 'hreflangs')}, issues AS ({' UNION ALL '.join(rows)})"
