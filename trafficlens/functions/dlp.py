"""Sensitive-data scan and redaction as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .fixed_values import DLP_LABELS, DLP_PATTERNS, DLP_TYPES, GATEWAY_TOKEN_PREFIX
from .regex import java_pattern, literal_replacement, usable

CustomPattern = tuple[str, str]  # (name, case-sensitive regex)

# Tests that must succeed before the costly pattern can match: literals searched for in the lower-cased text, or a
# pattern without boundaries. Redaction labels hold no digits and none of these literals, so the tests may run on the
# text before any redaction.
_LITERALS = {"email": ["@"], "api_key": ["sk-", GATEWAY_TOKEN_PREFIX, "ghp_", "xoxb-"]}
_SKETCHES = {
    "credit_card": "[0-9]{13}",
    "ssn": "[0-9]{3}[-. ]?[0-9]{2}[-. ]?[0-9]{4}",
    "iban": "[0-9]{7}",
    "phone": r"[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}",
    "passport": "[0-9]{6}",
}
_DIGITS = "[0-9]{3}"
# What every match of a type begins with. As a lookahead it stands before the word boundary, which is by far the
# costlier test at a position and is then made at few of them.
_STARTS = {
    "credit_card": "[2-6][0-9]{12}",
    "ssn": "[0-9]{3}[-. ]?[0-9]{2}",
    "iban": "[A-Z]{2}[0-9]{2}",
    "api_key": f"sk-|{GATEWAY_TOKEN_PREFIX}|ghp_|xoxb-",
    "phone": r"[+(]?[0-9]",
    "passport": "[A-Z]{1,2}[0-9]{6}",
}
_NAMES = "array<string>"


def pattern_of(name: str) -> str:
    return DLP_PATTERNS[name].replace("GATEWAY_PREFIX", GATEWAY_TOKEN_PREFIX)


def _java(name: str) -> str:
    """Java pattern of a type: the matches are those of :func:`pattern_of`."""
    start = f"(?={_STARTS[name]})" if name in _STARTS else ""
    return java_pattern(start + pattern_of(name), ignore_case=True)


def _possible(text: Column, name: str) -> Column:
    if name in _SKETCHES:
        # Every sketch asks for three digits in a row. That test stands first in each, so Spark makes it once a text.
        return text.rlike(_DIGITS) & text.rlike(_SKETCHES[name])
    lowered, out = F.lower(text), F.lit(False)
    for literal in _LITERALS[name]:
        out = out | F.contains(lowered, F.lit(literal))
    return out


def _found(text: Column, name: str) -> Column:
    return _possible(text, name) & text.rlike(_java(name))


def _listed(conditions: list[tuple[Column, str]]) -> Column:
    """Names whose condition holds, in order. ``concat`` compiles; filtering an array would not."""
    none = F.array().cast(_NAMES)
    return F.concat(none, *[F.when(cond, F.array(F.lit(name))).otherwise(none) for cond, name in conditions])


def usable_custom(spark: SparkSession, custom: Sequence[CustomPattern]) -> list[CustomPattern]:
    return [(name, rx) for name, rx in custom if usable(spark, rx)]


def violations(text: Column, detect: Sequence[str], custom: Sequence[CustomPattern] = ()) -> Column:
    """Names found in the text: built-ins in ``detect`` order (unknown names ignored), then custom ones."""
    return _listed([(_found(text, n), n) for n in detect if n in DLP_PATTERNS]
                   + [(text.rlike(java_pattern(rx)), n) for n, rx in custom])


def found_types(text: Column) -> Column:
    """All built-in types found in the text. What a policy makes of them is :func:`violations_of`."""
    return violations(text, DLP_TYPES)


def violations_of(found: Column, detect: Column) -> Column:
    """Violations under a policy's own ``detect`` list, in its order."""
    return F.coalesce(F.filter(detect, lambda d: F.array_contains(found, d)), F.array().cast(_NAMES))


def redact(text: Column, detect: Sequence[str], custom: Sequence[CustomPattern] = ()) -> Column:
    """Replace every match, one type after the other in ``detect`` order. Most texts take no replacement at all."""
    names = [n for n in detect if n in DLP_PATTERNS]
    if names:
        text = _masked(text, _listed([(_possible(text, n), n) for n in names]))
    for name, rx in custom:
        label = literal_replacement(f"[{name.upper()}-REDACTED]")
        text = F.regexp_replace(text, java_pattern(rx), label)
    return text


def redact_by(text: Column, detect: Column) -> Column:
    """As :func:`redact`, with a list of types (and so an order) per row."""
    possible = F.array_intersect(detect, _listed([(_possible(text, n), n) for n in DLP_TYPES]))
    # A type that is listed twice is masked twice; an intersection would name it once.
    return _masked(text, F.when(F.size(F.array_distinct(detect)) == F.size(detect), possible).otherwise(detect))


def _masked(text: Column, detect: Column) -> Column:
    def step(acc: Column, name: Column) -> Column:
        out = None
        for n in DLP_TYPES:
            masked = F.regexp_replace(acc, _java(n), DLP_LABELS[n])
            out = F.when(name == n, masked) if out is None else out.when(name == n, masked)
        return out.otherwise(acc)
    return F.coalesce(F.aggregate(detect, text, step), text)
