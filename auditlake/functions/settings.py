"""Settings from a TOML file and the environment, and translations from flat YAML."""

from __future__ import annotations

import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession

SECTIONS = ("server", "database", "crawler", "ui")


def settings(toml: str = "", environment: dict[str, str] | None = None, prefix: str = "AUDITLAKE_") -> dict[str, dict]:
    """Sections of settings; <prefix><SECTION>_<KEY> in the environment overrides the text, with the type that the text gives."""
    found = tomllib.loads(toml)
    out = {s: dict(next((v for k, v in found.items() if k.lower() == s and isinstance(v, dict)), {})) for s in SECTIONS}
    for name, value in (os.environ if environment is None else environment).items():
        section, _, key = name.removeprefix(prefix).lower().partition("_")
        if name.startswith(prefix) and section in out and key:
            kind = type(out[section].get(key, ""))
            out[section][key] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
    return out


def translations(yaml: str) -> dict[str, str]:
    """Texts by key of `key: text` lines; quoted or plain, comments and nested values left out."""
    out = {}
    for line in yaml.splitlines():
        if m := re.match(r"""([A-Za-z0-9_.-]+)\s*:\s+(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^#"'\s].*?))\s*(?:\s#.*)?$""", line):
            out[m[1]] = re.sub(
                r"\\(.)",
                lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]),
                m[2],
            ) if m[2] is not None else m[3].replace("''", "'") if m[3] is not None else m[4]
    return out


def translate(key: str, texts: dict[str, dict[str, str]], lang: str, default: str = "en", **params: object) -> str:
    """The text in a language, else in the default one, else the key; %name% stands for a parameter."""
    text = texts.get(lang, {}).get(key) or texts.get(default, {}).get(key) or key
    return re.sub(r"%(\w+)%", lambda m: str(params[m[1]]) if m[1] in params else m[0], text)


def translation_table(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(key, text), for exports."""
    return spark.createDataFrame(sorted(texts.items()), "key string, text string")
