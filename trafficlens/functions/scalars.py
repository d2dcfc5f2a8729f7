"""Small scalar functions: rounding, masking, names, token estimates, report periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import PERIODS
from .regex import WS


def js_round(value: Column, digits: int = 0) -> Column:
    """Round half up on the binary double, as ECMAScript does (Spark's ``round`` goes through decimals)."""
    scale = float(10 ** digits)
    return F.floor(value.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, the unit of the token estimate."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)).cast("bigint")


def message_json(role: Column, content: Column) -> Column:
    return F.to_json(F.struct(role.alias("role"), content.alias("content")))


def estimate_tokens(json_length: Column) -> Column:
    """Four characters of JSON per token, rounded up."""
    return F.ceil(json_length / F.lit(4)).cast("bigint")


def estimate_message_tokens(messages: Column) -> Column:
    """Token estimate of a nested ``array<struct<role, content>>`` column."""
    return estimate_tokens(utf16_length(F.to_json(messages)))


def mask_token(token: Column) -> Column:
    return F.concat(F.substring(token, 1, 8), F.lit("•" * 8))


def slugify(name: Column) -> Column:
    trimmed = F.regexp_replace(name, f"^{WS}+|{WS}+$", "")
    return F.regexp_replace(F.lower(trimmed), "[^a-z0-9_-]", "-")


def label_slug(email: Column) -> Column:
    return F.regexp_replace(F.lower(email), "[^a-z0-9._-]", "_")


def _replace_first(text: Column, literal: str, replacement: str) -> Column:
    return F.regexp_replace(text, f"(?s)^(?<before>.*?){literal}", f"${{before}}{replacement}")


def short_model(model: Column) -> Column:
    name = F.element_at(F.split(F.coalesce(model, F.lit("")), "/"), -1)
    name = _replace_first(name, "claude-", "")
    name = F.regexp_replace(name, "-20[0-9]{6}$", "")
    return _replace_first(_replace_first(name, "-4-", "4-"), r"-4\.", "4.")


def strip_bearer(header: Column) -> Column:
    """Drop a leading ``Bearer`` in any letter case, with the white space after it."""
    return F.regexp_replace(header, f"^(?i:Bearer){WS}+", "")


def bearer_value(header: Column) -> Column:
    """The identity token of an Authorization header: exact ``Bearer `` prefix only."""
    return F.when(header.startswith("Bearer "), F.substr(header, F.lit(8))).otherwise(header)


def truncate_prompt(text: Column, size: int = 500) -> Column:
    """Excerpt handed to the tier classifier (500) or echoed back to a caller (100)."""
    return F.substring(text, 1, size)


def tier_of_model(model: Column) -> Column:
    """Display tier of a routing target, by its name."""
    return (F.when(F.contains(model, F.lit("haiku")), "simple")
            .when(F.contains(model, F.lit("sonnet")), "standard").otherwise("complex"))


def period_bounds(as_of: int) -> dict[str, tuple[int, int]]:
    """Inclusive (from, to) unix seconds of every report period."""
    return {name: (as_of - as_of % 86400 if days is None else as_of - days * 86400, as_of)
            for name, days, _ in PERIODS}


def period_divisor(period: str) -> int:
    return {name: divisor for name, _, divisor in PERIODS}[period]
