"""JSON that a language model wrote: fences, trailing commas, truncation.

A cut-off text is read once, left to right, noting after each complete element which brackets are open;
the last place that parses when those are closed is the answer. One pass finds all places, so a long text is not rescanned for each.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?[^\n`]*\n?(.*?)(?:```|\Z)", re.S)
_COMMA = re.compile(r",\s*([\]}])")


def places(text: str) -> list[tuple[int, str]]:
    """(end of a prefix, brackets that close it) for prefixes that end with a closed bracket or before a comma."""
    out, open_, quoted, i = [], [], False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if open_:
                open_.pop()
            out.append((i + 1, "".join(reversed(open_))))
        elif c == ",":
            out.append((i, "".join(reversed(open_))))
        i += 1
    return out


def repaired(raw: str | None) -> str | None:
    """Compact JSON text, or null when nothing can be recovered."""
    if not raw or not raw.strip():
        return None
    text = raw.strip()
    if "```" in text and (m := _FENCE.search(text)):
        text = m[1].strip()
    bare = _COMMA.sub(r"\1", text)
    for candidate in (text, bare):
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except json.JSONDecodeError:
            pass
    for end, close in reversed(places(bare)):
        try:
            return json.dumps(json.loads(bare[:end] + close), ensure_ascii=False)
        except json.JSONDecodeError:
            continue
    return None


@F.pandas_udf(StringType())
def repair_json(raw: pd.Series) -> pd.Series:
    return raw.map(repaired)
