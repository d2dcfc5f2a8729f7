"""Tier routing of requests and the price of a request."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import PRICES, ROUTING_RULES, TIER_MODELS, TIERS
from ..functions.pricing import cost_nano, price_at, price_rule, usd

Rules = Sequence[tuple[str, Sequence[str]]]


def rule_tier(text: Column, rules: Rules = ROUTING_RULES) -> Column:
    """Tier of the first rule one of whose keywords occurs in the text; null when none does."""
    return rule_tier_of_lowered(F.lower(text), rules)


def rule_tier_of_lowered(lowered: Column, rules: Rules = ROUTING_RULES) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for tier, keywords in rules:
        hit = F.lit(False)
        for word in keywords:
            hit = hit | F.contains(lowered, F.lit(word.lower()))
        out = out.when(hit, tier)
    return out


def keyword_rule(lowered: Column, rules: Rules) -> Column:
    """:func:`rule_tier_of_lowered` for many keywords: one pass over a text, however many there are.

    All keywords stand in one automaton, which a task builds once. Each occurrence names the first rule that has the
    keyword, and the least of them wins; a text is left as soon as the first rule of all is found.
    """
    first: dict[str, int] = {}
    for k, (_, words) in enumerate(rules):
        for word in words:
            first.setdefault(word.lower(), k)
    always = first.pop("", len(rules))  # an empty keyword occurs in every text
    tiers = [tier for tier, _ in rules]

    @F.pandas_udf("string")
    def tier_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        import pandas as pd
        automaton = ahocorasick.Automaton()
        for word, k in first.items():
            automaton.add_word(word, k)
        automaton.make_automaton()

        def find(text):
            best = always
            for _, k in automaton.iter(text) if first else ():
                if k < best:
                    best = k
                    if not best:
                        break
            return tiers[best] if best < len(tiers) else None

        for texts in batches:
            yield pd.Series([None if t is None else find(t) for t in texts], dtype=object)

    return tier_of(lowered)


FEW_KEYWORDS = 64  # up to here one search per keyword in generated code is as fast


def route_rules(df: DataFrame, text_col: str, rules: Rules = ROUTING_RULES, out_col: str = "tier") -> DataFrame:
    """Add the rule tier of a text. The lower-case text is a column of its own, so that it is made once per row.

    Long keyword lists are looked for all at once (see :func:`keyword_rule`); the result is the same.
    """
    few = sum(len(words) for _, words in rules) <= FEW_KEYWORDS
    tier = (rule_tier_of_lowered if few else keyword_rule)(F.col("_lowered"), rules)
    return df.withColumn("_lowered", F.lower(F.col(text_col))).withColumn(out_col, tier).drop("_lowered")


def route(header: Column, rule: Column, model: Column, mode: str = "rules", tiers: Mapping[str, str] = TIER_MODELS,
          classified: Column | None = None) -> Column:
    """Struct (tier, method, model): valid header, keyword rule (see :func:`rule_tier`), classifier, default.

    Mode ``off`` switches routing off only for requests without a tier header; an invalid one still runs the rules.
    """
    tier_model = lambda t: F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in tiers.items()])
    made = lambda t, method, m: F.struct(t.alias("tier"), F.lit(method).alias("method"), m.alias("model"))
    default = made(F.lit("standard"), "default", F.coalesce(model, F.lit(tiers["standard"])))
    out = F.when(F.lit(mode == "off") & (header.isNull() | (header == "")), default)
    out = out.when(header.isin(TIERS), made(header, "header", tier_model(header)))
    out = out.when(rule.isNotNull(), made(rule, "rule", tier_model(rule)))
    if mode == "auto" and classified is not None:
        tier = F.when(classified.isin("simple", "complex"), classified).otherwise("standard")
        return out.otherwise(made(tier, "classifier", tier_model(tier)))
    return out.otherwise(default)


def route_model(df: DataFrame, rule_col: str = "rule", header_col: str = "tier_header", model_col: str = "model",
                **options) -> DataFrame:
    """Add ``tier``, ``method`` and ``routed_model`` to requests that carry the rule tier of their text.

    The rule tier is a property of the text: work it out on the table of texts (``route_rules``) and join it.
    """
    routed = df.withColumn("_r", route(F.col(header_col), F.col(rule_col), F.col(model_col), **options))
    return (routed.withColumn("tier", F.col("_r.tier")).withColumn("method", F.col("_r.method"))
            .withColumn("routed_model", F.col("_r.model")).drop("_r"))


def price_join(df: DataFrame, model_col: str = "model", prices=PRICES) -> DataFrame:
    """Add ``price_in`` and ``price_out``, USD per million tokens of the first matching price rule."""
    ruled = df.withColumn("_rule", price_rule(F.col(model_col), prices))
    per_million = lambda side: price_at(F.col("_rule"), side, prices).cast("double") / F.lit(1000.0)
    return (ruled.withColumn("price_in", per_million("input")).withColumn("price_out", per_million("output"))
            .drop("_rule"))


def price_request(log: DataFrame, prices=PRICES) -> DataFrame:
    """Add ``cost_nano``, ``saved_nano`` (exact) and ``cost_usd``, ``saved_usd``.

    A cache hit costs nothing and saves the full price; otherwise a cheaper routed model saves the difference.
    """
    # Rules and costs are columns of their own, so that each is worked out once per row.
    costed = (log.withColumn("_full_rule", price_rule(F.col("original_model"), prices))
              .withColumn("_paid_rule", F.when(F.col("routed_model") == F.col("original_model"), F.col("_full_rule"))
                          .otherwise(price_rule(F.col("routed_model"), prices)))
              .withColumn("_full", cost_nano(F.col("_full_rule"), F.col("input_tokens"), F.col("output_tokens"), prices))
              .withColumn("_paid", cost_nano(F.col("_paid_rule"), F.col("input_tokens"), F.col("output_tokens"), prices)))
    hit, zero = F.col("from_cache") == 1, F.lit(0).cast("bigint")
    priced = (costed.withColumn("cost_nano", F.when(hit, zero).otherwise(F.col("_paid")))
              .withColumn("saved_nano", F.when(hit, F.col("_full"))
                          .otherwise(F.greatest(F.col("_full") - F.col("_paid"), zero))))
    return (priced.withColumn("cost_usd", usd(F.col("cost_nano"))).withColumn("saved_usd", usd(F.col("saved_nano")))
            .drop("_full_rule", "_paid_rule", "_full", "_paid"))
