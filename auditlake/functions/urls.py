"""URL expressions in Catalyst, and resolution of references as an Arrow function."""

from __future__ import annotations

import posixpath
import re
from functools import lru_cache
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Host with its port."""
    return F.regexp_extract(url, AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def utc(moment: Column) -> Column:
    """A timestamp to be formatted as UTC, whatever the session's time zone."""
    return F.to_utc_timestamp(moment, F.current_timezone())


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def truncate(s: Column, n: int) -> Column:
    """At most n characters, the last three of a cut string being dots."""
    return F.when(F.char_length(s) > n, F.concat(F.left(s, F.lit(n - 3)), F.lit("..."))).otherwise(s)


def _joined(base: str, ref: str) -> str:
    """Path elements joined and cleaned; a slash at the end of the last one stays."""
    path = posixpath.normpath(posixpath.join("/", base.lstrip("/"), ref.lstrip("/")))
    path = "/" + path.lstrip("/")
    return path + "/" if ref.endswith("/") and not path.endswith("/") else path


def _without_dots(path: str) -> str:
    """Dot segments resolved; empty segments stay."""
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part == ".." and len(out) > 1:
            out.pop()
        elif part not in (".", ".."):
            out.append(part)
        if part in (".", "..") and i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out).lstrip("/") if path.startswith("/") and not "/".join(out).startswith("/") else "/".join(out)


def _referred(page: str, ref: str):
    """RFC 3986: a reference with a scheme is taken as it is."""
    to, own = urlsplit(ref), urlsplit(page)
    if to.scheme:
        return to
    if to.netloc:
        return to._replace(scheme=own.scheme, path=_without_dots(to.path))
    if not to.path:
        return to._replace(scheme=own.scheme, netloc=own.netloc, path=_without_dots(own.path), query=to.query or own.query)
    merged = to.path if to.path.startswith("/") else (own.path or "/")[: (own.path or "/").rfind("/") + 1] + to.path
    return to._replace(scheme=own.scheme, netloc=own.netloc, path=_without_dots(merged))


def resolve(ref: str, page: str, base: str | None = None) -> str | None:
    """Absolute http(s) URL without fragment, an empty path being /; None for other schemes or unreadable references.

    Without a <base>, RFC 3986 applies. With one, a reference without a scheme gives its path only, which is joined to the
    path of the base; the base's query stays, and a host or scheme that it lacks is the page's."""
    try:
        parts = urlsplit(ref.strip())
        if base is not None and not parts.scheme:
            root, own = urlsplit(base.strip()), urlsplit(page)
            target = urlsplit(urlunsplit((root.scheme or own.scheme, root.netloc or own.netloc, _joined(root.path, parts.path), root.query, "")))
        else:
            target = _referred(page, ref.strip())
    except ValueError:
        return None
    if target.scheme not in ("http", "https"):
        return None
    return urlunsplit((target.scheme, target.netloc, target.path or "/", target.query, ""))


#: References and pages without anything that resolving changes: no dot segments, empty ones, or characters that are dropped.
_PLAIN = re.compile(r"(/?)((?:[A-Za-z0-9_~-][A-Za-z0-9_.~-]*/)*[A-Za-z0-9_~-][A-Za-z0-9_.~-]*/?)(\?[A-Za-z0-9_.~=&%+-]+)?(?:#[A-Za-z0-9_.~=&%+/-]*)?")
_WHOLE = re.compile(r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)(/[A-Za-z0-9_.~/%+=,-]*(?:\?[A-Za-z0-9_.~=&%+/-]+)?)?(?:#[A-Za-z0-9_.~=&%+/-]*)?")
_PAGE = re.compile(r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?/(?:[A-Za-z0-9_.~%/+-]*/)?)[^?#/]*")


@lru_cache(1024)
def _prefixes(folder: str, base: str | None) -> tuple[str | None, str | None]:
    """What a plain reference is put behind, without and with a slash in front of it; None where resolving does more."""
    found = [resolve(ref, folder, base) for ref in ("x", "/x")]
    return tuple(x[:-1] if x and x.endswith("/x") else None for x in found)


class Resolver:
    """resolve() for many references of one page: plain ones are put behind a prefix."""

    def __init__(self, page: str, base: str | None = None):
        self.page, self.base = page, base
        own = _PAGE.fullmatch(page)
        self.prefixes = _prefixes(own[1], base) if own else (None, None)

    def __call__(self, ref: str) -> str | None:
        if m := _PLAIN.fullmatch(ref):
            if prefix := self.prefixes[m[1] != ""]:
                return prefix + m[2] + m[3] if m[3] and self.base is None else prefix + m[2]
        elif m := _WHOLE.fullmatch(ref):
            return m[1] + (m[2] or "/")
        elif ref.startswith(("mailto:", "tel:", "javascript:")):
            return None
        return resolve(ref, self.page, self.base)
