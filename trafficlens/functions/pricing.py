"""Prices and costs. Money is integer nano-USD until the very end, so sums do not depend on their order."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import PRICES

NANO = 1_000_000_000
PriceRule = tuple[str, float, float]  # (case-insensitive pattern, USD per 1M input tokens, USD per 1M output tokens)


def nano_per_token(usd_per_million: float) -> int:
    """Exact nano-USD per token; a price with a finer part than that is refused rather than rounded."""
    nano = Decimal(str(usd_per_million)) * 1000
    if nano != nano.to_integral_value():
        raise ValueError(f"{usd_per_million} USD per million tokens is no whole number of nano-USD per token")
    return int(nano)


def price_rule(model: Column, prices: Sequence[PriceRule] = PRICES) -> Column:
    """1-based number of the first matching price rule.

    One CASE over a short string: no join, no shuffle, and literal patterns are plain substring tests.
    """
    lowered = F.lower(F.coalesce(model, F.lit("")))
    out = None
    for number, (pattern, _, _) in enumerate(prices, 1):
        if re.fullmatch(r"[\w-]+", pattern):
            cond = F.contains(lowered, F.lit(pattern.lower()))
        elif pattern == ".*":
            cond = F.lit(True)
        else:
            cond = lowered.rlike("(?i)" + pattern)
        out = F.when(cond, F.lit(number)) if out is None else out.when(cond, F.lit(number))
    return out


def price_at(rule: Column, side: str, prices: Sequence[PriceRule] = PRICES) -> Column:
    """Nano-USD per token under a rule number; ``side`` is ``input`` or ``output``."""
    at = {"input": 1, "output": 2}[side]
    return F.get(F.array(*[F.lit(nano_per_token(p[at])).cast("bigint") for p in prices]), rule - 1)


def cost_nano(rule: Column, input_tokens: Column, output_tokens: Column,
              prices: Sequence[PriceRule] = PRICES) -> Column:
    return input_tokens * price_at(rule, "input", prices) + output_tokens * price_at(rule, "output", prices)


def usd(nano: Column) -> Column:
    return nano.cast("double") / F.lit(float(NANO))
