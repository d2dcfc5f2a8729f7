"""Prompt-injection score as a native column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import DEFAULT_BLOCK_THRESHOLD, GUARD_PATTERNS
from .regex import java_pattern

# One literal per pattern that any match must contain: in lower case, or as is for the case-sensitive patterns. A byte
# search for it is far cheaper than the pattern, and almost no text contains it.
_NEEDLES = ["ignore", "disregard", "forget", "override", "new", "from", "are", "act", "pretend", "restriction",
            "your", "DAN", "anything", "developer", "jailbreak", "grandma", "hypothetically", "scenario", "repeat",
            "reveal", "print", "what", "output", "show", "system", "###", "[SYSTEM]", "---", "<|im_start|>",
            "{system}"]
# A second such literal for the patterns whose first one is an everyday word.
_SECOND = {4: ":", 5: "now", 6: "now", 10: "is", 12: "now", 21: "your", 23: "your", 24: "<"}


def hits(text: Column) -> Column:
    """Array of (weight, label) for each pattern found, in pattern order.

    Built with ``concat`` rather than by filtering an array, so that it compiles and ``lower`` is computed once.
    """
    lowered = F.lower(text)
    empty = F.array().cast("array<struct<weight: double, label: string>>")
    found = []
    for i, (pattern, ignore_case, weight, label) in enumerate(GUARD_PATTERNS):
        where = lowered if ignore_case else text
        cond = F.contains(where, F.lit(_NEEDLES[i]))
        if i in _SECOND:
            cond = cond & F.contains(where, F.lit(_SECOND[i]))
        hit = F.struct(F.lit(weight).alias("weight"), F.lit(label).alias("label"))
        found.append(F.when(cond & text.rlike(java_pattern(pattern, ignore_case)), F.array(hit)).otherwise(empty))
    return F.concat(*found)


def score(found: Column) -> Column:
    """Highest weight among the hits, 0.0 when there are none (weights have two decimals already)."""
    return F.coalesce(F.array_max(F.transform(found, lambda h: h["weight"])), F.lit(0.0))


def labels(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda h: h["label"]))


def blocked(score_col: Column, threshold: float | Column | None = None) -> Column:
    limit = F.lit(DEFAULT_BLOCK_THRESHOLD) if threshold is None else threshold
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return score_col >= F.coalesce(limit, F.lit(DEFAULT_BLOCK_THRESHOLD))
