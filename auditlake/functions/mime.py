"""Media types by extension: those that the standard library knows without the machine's own tables, so that all machines agree,
and a few that pages need otherwise or besides."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions import urls

#: Extension and media types.
OWN = {
    "html": ["text/html"], "htm": ["text/html"], "css": ["text/css"], "js": ["text/javascript", "application/javascript"], "mjs": ["text/javascript"],
    "json": ["application/json"], "xml": ["text/xml"], "txt": ["text/plain"], "csv": ["text/csv"], "pdf": ["application/pdf"], "zip": ["application/zip"],
    "png": ["image/png"], "jpg": ["image/jpeg"], "jpeg": ["image/jpeg"], "gif": ["image/gif"], "webp": ["image/webp"], "svg": ["image/svg+xml"], "avif": ["image/avif"],
    "mp3": ["audio/mpeg"], "mp4": ["video/mp4"], "webm": ["video/webm"], "woff": ["font/woff"], "woff2": ["font/woff2"], "wasm": ["application/wasm"],
}

TYPES = {k.removeprefix("."): [v] for k, v in sorted(mimetypes.MimeTypes(filenames=()).types_map[True].items())} | OWN


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))


def extension(url: Column) -> Column:
    found = F.lower(F.regexp_extract(urls.path(url), r"\.([^./]*)$", 1))
    return F.when(F.regexp_extract(urls.path(url), r"(\.[^./]*)$", 1) == "", "html").otherwise(found)


def mismatch(url: Column, kind: Column) -> Column:
    """An empty media type, or one that is not the extension's; an unknown extension says nothing."""
    known = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    types = F.try_element_at(known, extension(url))
    return (kind == "") | F.coalesce(~F.array_contains(types, kind), F.lit(False))
