"""The archive's index in CDXJ order, lookups in it, raw HTTP records and replay rewriting."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.sources.tree import ATTRIBUTE, MARKUP, RAW_END, SKIPPED, attribute_text, attributes


def cdxj_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, a bracket, then the request URI; user and port are left out."""
    host = F.array_join(F.reverse(F.split(F.regexp_replace(urls.authority(url), "^.*@|:[0-9]*$", ""), "\\.")), ",")
    uri = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(host, F.lit(")"), F.when(uri == "", "/").otherwise(uri))


def cdxj_index(records: DataFrame) -> DataFrame:
    """records(url, ts, mime, status, digest, offset, length) as sorted index lines."""
    entry = F.to_json(F.struct("url", "mime", "status", "digest", "length", "offset", F.lit("data.warc").alias("filename")))
    return records.select(
        cdxj_key(F.col("url")).alias("key"),
        F.date_format(urls.utc(F.col("ts")), "yyyyMMddHHmmss").alias("stamp"),
        entry.alias("entry"),
    ).select("key", F.concat_ws(" ", "key", "stamp", "entry").alias("line")).orderBy("line")


def lookup(index: DataFrame, url: str) -> DataFrame:
    """The first line of exactly this URL; a longer URL with the same beginning is another key."""
    key = cdxj_key(F.lit(url))
    return index.where(F.col("key") == key).orderBy("line").limit(1)


def parse_http(raw: Column) -> Column:
    """struct(headers, body) of a raw HTTP record: lower-case names to values; the status line is passed over."""
    parts = F.split(raw, "\r\n\r\n", 2)
    lines = F.filter(F.split(parts[0], "\r\n"), lambda x: ~x.startswith("HTTP/") & x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    headers = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"])))
    return F.struct(headers.alias("headers"), F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("body"))


#: Headers of a stored response that a replay must not send on.
UNSAFE_HEADERS = ("set-cookie", "strict-transport-security", "content-security-policy", "access-control-allow-origin", "x-frame-options")
#: A replay is never cached.
NO_CACHE = {"cache-control": "no-store, no-cache, must-revalidate, max-age=0", "pragma": "no-cache", "expires": "0"}


def replay_headers(headers: Column) -> Column:
    """Headers of a replayed response, of a map of lower-case names to values."""
    safe = F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*UNSAFE_HEADERS, *NO_CACHE))
    return F.map_concat(safe, F.create_map(*[x for k, v in NO_CACHE.items() for x in (F.lit(k), F.array(F.lit(v)))]))


CSS_URL = re.compile(r"""url\(\s*["']?(.*?)["']?\s*\)""")
#: Attributes that hold a URL, by element.
URL_ATTRIBUTES = {"img": {"src"}, "script": {"src"}, "link": {"href"}, "iframe": {"src"}, "source": {"src"}, "video": {"src", "poster"}, "audio": {"src"}, "a": {"href"}}
SETS = {"img", "source"}


def replay_url(ref: str, page: str, project: int) -> str:
    target = urljoin(page, ref.strip())
    return f"/replay?pid={project}&url={quote(target, safe='')}" if target.startswith(("http://", "https://")) else ref


def rewrite_css(css: str, to) -> str:
    return CSS_URL.sub(lambda m: f"url({to(m[1])})", css)


def rewrite_srcset(value: str, to) -> str:
    """Entries keep their descriptors."""
    entries = (x.split(maxsplit=1) for x in re.split(r",\s+", value.strip(" ,\t\n\f\r")) if x.strip())
    return ", ".join(" ".join([to(u), *d]) for u, *d in entries)


def start_tags(html: str) -> Iterator[tuple[str, int, int]]:
    """(name, where the attributes begin, the end) of each start tag, in one pass: comments, declarations, and what elements of raw
    text hold are passed over."""
    at = 0
    while m := MARKUP.search(html, at):
        if not m[2]:
            stop = html.find("-->" if m[3] else ">", m.end() if m[3] else m.start())
            at = len(html) if stop < 0 else stop + (3 if m[3] else 1)
            continue
        tag, (_, _, at) = m[2].lower(), attributes(html, m.end())
        if at < 0:
            return
        if not m[1]:
            yield tag, m.end(), at
            if (end := RAW_END.get(tag)) is not None:
                close = end.search(html, at)
                at = close.start() if close else len(html)


def _attribute(tag: str, name: str, value: str, to) -> str:
    if name in URL_ATTRIBUTES.get(tag, ()):
        return to(value)
    if name == "srcset" and tag in SETS:
        return rewrite_srcset(value, to)
    return rewrite_css(value, to) if name == "style" else value


def rewrite_html(html: str, to) -> str:
    """Every fetched or linked URL through to(): in attributes, srcset entries, style attributes and style elements. All else is
    copied as it is, so scripts, comments and texts stay, and attributes without quotes get them only where their value changes."""
    out, done = [], 0

    def put(start: int, stop: int, text: str) -> None:
        nonlocal done
        out.extend((html[done:start], text))
        done = stop

    for tag, start, end in start_tags(html):
        at, seen = start, set()
        while html[(at := SKIPPED.match(html, at).end())] != ">":
            m = ATTRIBUTE.match(html, at)
            at, name = m.end(), m[1].lower()
            group = next((g for g in (2, 3, 4) if m[g] is not None), None)
            if group and name not in seen:
                value = attribute_text(m[group])
                new = _attribute(tag, name, value, to)
                if new != value:
                    quote = 0 if group == 4 else 1
                    escaped = new if attribute_text(new) == new else new.replace("&", "&amp;")
                    put(m.start(group) - quote, m.end(group) + quote, '"' + escaped.replace('"', "&quot;") + '"')
            seen.add(name)
        if tag == "style":
            close = RAW_END[tag].search(html, end)
            stop = close.start() if close else len(html)
            put(end, stop, rewrite_css(html[end:stop], to))
    return "".join([*out, html[done:]])


def inject(html: str, head: str = "", body: str = "") -> str:
    """The fragments at the beginning of head and body. Where a page has no such tag, its head begins behind <html>, or the
    declaration, and its body behind the head."""
    begin: dict[str, int] = {}
    for tag, _, end in start_tags(html):
        if tag in ("html", "head", "body"):
            begin.setdefault(tag, end)
    declared = re.match(r"\s*<!doctype[^>]*>", html, re.I)
    first = begin.get("head", begin.get("html", declared.end() if declared else 0))
    closed = re.compile(r"</head\s*>", re.I).search(html, first)
    second = max(first, begin.get("body", closed.end() if closed and "head" in begin else first))
    return html[:first] + head + html[first:second] + body + html[second:]


def download_name(url: str) -> str:
    name = re.sub(r"[?#].*", "", url).split("://", 1)[-1].partition("/")[2].rstrip("/").rpartition("/")[2] or "index.html"
    return name if "." in name else name + ".html"
