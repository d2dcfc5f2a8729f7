"""Patterns that each policy brings along: ECMAScript expressions that differ from row to row.

Spark's own expressions take a pattern per row but fail on a broken one, which must be skipped here. So these few run in
Arrow batches; each worker compiles a pattern once. A row without patterns sends no text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

CUSTOM = "array<struct<name: string, regex: string>>"


def python_pattern(pattern: str) -> str:
    """The same expression for Python's ``re`` with ``re.ASCII``."""
    import re

    from .regex import NOT_WS, WS
    same_outside = {"$": r"\Z", ".": r"[^\n\r\u2028\u2029]", r"\s": WS, r"\S": NOT_WS}
    out, in_class = [], False
    for token in re.findall(r"\\.|\(\?<(?=[A-Za-z_])|.", pattern, re.S):
        if token == "(?<" and not in_class:
            token = "(?P<"
        elif not in_class:
            token = same_outside.get(token, token)
        elif token == r"\s":
            token = WS[1:-1]
        if token == "[":
            token, in_class = r"\[" if in_class else "[", True
        elif token == "]":
            in_class = False
        out.append(token)
    return "".join(out)


def compiled(pattern: str, kept: dict):
    """The compiled pattern, or None for one that does not compile; remembered in ``kept``."""
    import re
    if pattern not in kept:
        try:
            kept[pattern] = re.compile(python_pattern(pattern), re.ASCII)
        except (re.error, OverflowError):
            kept[pattern] = None
    return kept[pattern]


def masked(text: str, patterns, kept: dict) -> str:
    for p in patterns:
        rx = compiled(p["regex"], kept)
        if rx is not None:
            label = f"[{p['name'].upper()}-REDACTED]"
            text = rx.sub(lambda _: label, text)
    return text


def custom_found(text: Column, patterns: Column) -> Column:
    """Those of an array of expressions that match the text; null when there are none to try."""
    @pandas_udf("array<string>")
    def hits(texts, asked):
        import pandas as pd
        kept: dict = {}
        return pd.Series([None if t is None else [p for p in asked_here if (rx := compiled(p, kept)) and rx.search(t)]
                          for t, asked_here in zip(texts, asked)], dtype=object)
    return hits(F.when(F.size(patterns) > 0, text), patterns)


def custom_masked(text: Column, patterns: Column) -> Column:
    """The text with every match of the patterns (name and regex) replaced, one pattern after the other."""
    @pandas_udf("string")
    def mask(texts, asked):
        import pandas as pd
        kept: dict = {}
        return pd.Series([None if t is None else masked(t, ps, kept) for t, ps in zip(texts, asked)], dtype=object)
    return F.coalesce(mask(F.when(F.size(patterns) > 0, text), patterns), text)


def custom_masked_each(texts: Column, patterns: Column) -> Column:
    """:func:`custom_masked` for an array of texts; nulls stay."""
    @pandas_udf("array<string>")
    def mask(lists, asked):
        import pandas as pd
        kept: dict = {}
        return pd.Series([None if ts is None else [None if t is None else masked(t, ps, kept) for t in ts]
                          for ts, ps in zip(lists, asked)], dtype=object)
    return F.coalesce(mask(F.when(F.size(patterns) > 0, texts), patterns), texts)
