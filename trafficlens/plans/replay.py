"""Replay of a request log through the whole gateway: govern, cache, routing, price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import PRICES, TIER_MODELS
from ..operators.cache import cache_replay
from ..operators.routing import price_request, route, route_rules
from ..sources.archive import log_row, materialise
from .govern import govern, govern_bodies, redact_key, relay_texts


def replay(requests: DataFrame, prompts: DataFrame, tokens: DataFrame, stored: DataFrame, config: DataFrame,
           ttl: int = 86_400, mode: str = "rules", tiers=TIER_MODELS, prices=PRICES, required: bool = False,
           window_ms: int = 60_000) -> DataFrame:
    """One row per answered request, with cache, routing and cost columns (see :func:`answered_log`).

    The cache key is taken from the text after redaction and before routing. Streamed requests may be served from the
    cache but never fill it, nor do failed ones (a ``failed`` column of 1, where there is one). Tokens of a hit are those of the response it is served.
    """
    # Two narrow tables are written on the way, because several branches read each: the verdicts and the cache keys.
    governed = materialise(govern(requests, prompts, tokens, stored, config, required, window_ms))
    # Redaction, digest and rule tier are worked out once per distinct relayed text. Untouched texts are read where they
    # are stored; only those that some policy redacts are joined to their redaction lists first.
    redacted = relay_texts(governed.filter("redact_with IS NOT NULL"), prompts)
    untouched = prompts.select("prompt_id", F.lit("").alias("redact_key"), F.col("prompt").alias("relay_text"))
    texts = _text_keys(untouched).unionByName(_text_keys(redacted))
    asked = governed.filter("outcome = 'ok'").withColumn("redact_key", redact_key(governed))
    asked = asked.join(texts, (F.col("prompt_id") == F.col("_pid")) & (F.col("redact_key") == F.col("_key")), "left")
    # Same digest, provider and model: same cache key.
    asked = asked.withColumn("cache_key", F.concat_ws("|", "provider_resolved", "model", "digest"))
    return _answer(asked, ttl, mode, tiers, prices)


def replay_bodies(requests: DataFrame, tokens: DataFrame, stored: DataFrame, config: DataFrame, body_col: str = "body",
                  ttl: int = 86_400, mode: str = "rules", tiers=TIER_MODELS, prices=PRICES, required: bool = False,
                  window_ms: int = 60_000) -> DataFrame:
    """:func:`replay` of requests that carry their own JSON body (see ``govern_bodies``)."""
    governed = materialise(govern_bodies(requests, tokens, stored, config, body_col, required, window_ms))
    return _answer(governed.filter("outcome = 'ok'"), ttl, mode, tiers, prices)


def _answer(asked: DataFrame, ttl: int, mode: str, tiers, prices) -> DataFrame:
    """Cache, routing and price of governed requests with ``cache_key`` and ``rule``.

    Streamed requests never fill the cache, nor do those whose ``failed`` is 1.
    """
    routed = asked.withColumn("_r", route(F.col("tier_header"), F.col("rule"), F.col("model"), mode, tiers))
    failed = F.coalesce(F.col("failed"), F.lit(0)) if "failed" in asked.columns else F.lit(0)
    fills = (F.col("is_stream") == 0) & (failed == 0)
    keyed = (routed.withColumn("can_fill", F.when(fills, 1).otherwise(0))
             .select("request_id", "created_at", "label", F.col("provider_resolved").alias("provider"), "model",
                     F.col("_r.tier").alias("tier"), F.col("_r.method").alias("method"),
                     F.col("_r.model").alias("routed_model"), "input_tokens", "output_tokens", "cache_key", "can_fill",
                     "policy_name", "system_prepend", "system_append", F.size("events").alias("n_events")))
    keyed = materialise(keyed)
    served = cache_replay(keyed, ttl, key="cache_key", can_fill="can_fill", payload=("input_tokens", "output_tokens"))
    hit = F.col("hit") == 1
    answered = served.select(
        "request_id", "created_at", F.col("label").alias("user_label"), "provider", "policy_name", "system_prepend",
        "system_append", "n_events", F.col("hit").alias("from_cache"), F.col("model").alias("original_model"),
        F.when(hit, F.col("model")).otherwise(F.col("routed_model")).alias("routed_model"),
        F.when(hit, "cache").otherwise(F.col("method")).alias("routing_method"),
        F.when(hit, "standard").otherwise(F.col("tier")).alias("routing_tier"),
        F.when(hit, F.col("source_input_tokens")).otherwise(F.col("input_tokens")).alias("input_tokens"),
        F.when(hit, F.col("source_output_tokens")).otherwise(F.col("output_tokens")).alias("output_tokens"))
    return price_request(answered, prices)


def _text_keys(texts: DataFrame) -> DataFrame:
    """What the replay needs of a relayed text: ``_pid, _key, digest, rule``."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("relay_text").alias("content")))
    return route_rules(texts, "relay_text", out_col="rule").select(
        F.col("prompt_id").alias("_pid"), F.col("redact_key").alias("_key"),
        F.sha2(F.to_json(message), 256).alias("digest"), "rule")


def answered_log(replayed: DataFrame) -> DataFrame:
    """The replay in the layout of the stored request log."""
    return log_row(replayed)


def lock_events(replayed: DataFrame) -> DataFrame:
    """``system_prompt_injected`` events: cache misses whose policy mandates a system prompt."""
    locked = (F.coalesce("system_prepend", F.lit("")) != "") | (F.coalesce("system_append", F.lit("")) != "")
    return replayed.filter((F.col("from_cache") == 0) & locked).select(
        "request_id", "created_at", "user_label", "policy_name", (F.col("n_events") + 1).cast("bigint").alias("seq"),
        F.lit("system_prompt_injected").alias("action"), F.lit("{}").alias("detail"))
