"""Redaction of every string in untyped JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HOST_PATHS, HOST_URIS, SECRETS

_STEPS = [(f"secret_pattern_{k}", [p], f"[REDACTED_SECRET_{k}]") for k, p in enumerate(SECRETS)]
_STEPS += [("host_path_uri", list(HOST_URIS), "file://[REDACTED_HOST_PATH]"), ("host_path", list(HOST_PATHS), "[REDACTED_HOST_PATH]")]


def sanitized(text: str | None) -> tuple[str | None, int, list[str]]:
    """A JSON text with its strings, keys too, redacted; how many changed; the names of
    the patterns that did.  What isn't JSON is one string; null stays null."""
    if text is None:
        return None, 0, []
    names: set[str] = set()
    changed = 0

    def string(s: str) -> str:
        nonlocal changed
        before = s
        for name, patterns, by in _STEPS:
            after = s
            for p in patterns:
                after = re.sub(p, lambda _: by, after)
            if after != s:
                names.add(name)
            s = after
        changed += s != before
        return s

    def walk(x):
        if isinstance(x, str):
            return string(x)
        if isinstance(x, dict):
            return {string(k): walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    try:
        out = json.dumps(walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    except (ValueError, RecursionError):
        out = string(text)
    return out, changed, sorted(names)


def sanitize_json(column: Column) -> Column:
    """(json, count, categories) of a column of JSON texts."""

    @F.pandas_udf("json string, count int, categories array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sanitized(t) for t in texts], columns=["json", "count", "categories"])

    return run(column)
