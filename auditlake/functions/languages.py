"""Language tags by BCP 47: the grammar, and subtags that are registered.

The registry is the validity data of the ICU library that Spark brings along (languages of two and three letters, scripts, regions,
variants, private use among them), read once by the driver: some 9,000 short names, which go into the expression as sets."""

from __future__ import annotations

from functools import lru_cache

from py4j.java_gateway import get_field
from pyspark.sql import SparkSession

#: Tags from before the grammar, which are valid as a whole.
GRANDFATHERED = (
    "en-gb-oed i-ami i-bnn i-default i-enochian i-hak i-klingon i-lux i-mingo i-navajo i-pwn i-tao i-tay i-tsu sgn-be-fr sgn-be-nl sgn-ch-de "
    "art-lojban cel-gaulish no-bok no-nyn zh-guoyu zh-hakka zh-min zh-min-nan zh-xiang"
).split()
#: Languages that extended languages may follow.
EXTENDED = "ar kok lv ms sgn sw uz zh".split()
#: Groups: language, extended languages, script, region, variants.
GRAMMAR = (
    "^([a-z]{2,3})((?:-[a-z]{3}){0,3})(?:-([a-z]{4}))?(?:-([a-z]{2}|[0-9]{3}))?((?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*)"
    "(?:-[a-wyz0-9](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?$"
)
PRIVATE = "^x(?:-[a-z0-9]{1,8})+$"


@lru_cache(maxsize=1)
def registry() -> dict[str, frozenset[str]]:
    """Names by kind: language, script, region, variant; a session must be at hand."""
    jvm = SparkSession.active()._jvm
    found: dict[str, set[str]] = {}
    for kind in getattr(jvm.com.ibm.icu.impl, "ValidIdentifiers").getData().entrySet():
        name = str(kind.getKey())
        if name in ("language", "script", "region", "variant"):
            for status in kind.getValue().entrySet():
                found.setdefault(name, set()).update(get_field(status.getValue(), "regularData") or ())
    # names of three letters for languages that have one of two
    for code in jvm.java.util.Locale.getISOLanguages():
        found["language"] |= {code, jvm.com.ibm.icu.util.ULocale(code).getISO3Language()}
    return {k: frozenset(x for x in v if x) for k, v in found.items()}


def _in(value: str, names) -> str:
    return f"{value} IN ({', '.join(repr(x) for x in sorted(names))})"


@lru_cache(maxsize=8)
def valid_tag(tag: str) -> str:
    """SQL: whether the text of an expression is a language tag of registered subtags, in any case, parted by - or _."""
    held, known = f"lower(replace({tag}, '_', '-'))", registry()
    part = lambda i: f"regexp_extract({held}, '{GRAMMAR}', {i})"
    each = lambda i, test: f"forall(filter(split({part(i)}, '-'), s -> s <> ''), s -> {test})"
    rules = [
        f"{held} RLIKE '{GRAMMAR}'",
        _in(part(1), known["language"]),
        f"({part(2)} = '' OR {_in(part(1), EXTENDED)} AND {each(2, _in('s', known['language']))})",
        _in(part(3), known["script"] | {""}),
        _in(part(4), known["region"] | {""}),
        each(5, _in("s", known["variant"])),
    ]
    return f"({' AND '.join(rules)} OR {held} RLIKE '{PRIVATE}' OR {_in(held, GRANDFATHERED)})"
