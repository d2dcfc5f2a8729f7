"""Governance of a request table: identity, allowlist, limiter, policy checks, audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import body as B
from ..functions import dlp, guard
from ..functions.custom import custom_found, custom_masked, custom_masked_each
from ..operators.cache import request_hash_of
from ..operators.history import auth_asof, policy_asof
from ..operators.identity import auth_resolve, model_allowed
from ..operators.limiter import rate_limit
from ..operators.policy import policy_resolve, provider_allowed, provider_resolve
from ..operators.routing import rule_tier
from ..sources.archive import materialise


def identify(requests: DataFrame, tokens: DataFrame, required: bool = False) -> DataFrame:
    """Identity and model allowlist. Adds identity columns and ``outcome`` (ok | 401 | 403_model)."""
    return allowlisted(auth_resolve(requests, tokens, required))


def allowlisted(known: DataFrame) -> DataFrame:
    """Turn the outcome of requests for models that their identity may not use into 403."""
    allowed = ~F.col("known") | model_allowed(F.col("model"), F.col("allowed_models"))
    return known.withColumn("outcome", F.when(F.col("outcome") != "ok", F.col("outcome"))
                            .when(~allowed, "403_model").otherwise("ok"))


def limit(identified: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Turn the outcome of requests over their limit into 429. Only requests that passed so far count."""
    # The limiter shuffles only what it needs; requests without a limit never enter it.
    # They are written once, since it reads them several times: identities are not joined anew for each.
    entering = materialise(identified.filter((F.col("outcome") == "ok") & (F.col("rpm_limit") > 0))
                           .select("request_id", "label", "rpm_limit", (F.col("created_at") * 1000).alias("ts_ms")))
    denied = rate_limit(entering, window_ms).filter("allowed = 0").select(
        F.col("request_id").alias("_denied"))
    return (identified.join(denied, F.col("request_id") == F.col("_denied"), "left")
            .withColumn("outcome", F.when(F.col("_denied").isNotNull(), "429").otherwise(F.col("outcome")))
            .drop("_denied"))


def admit(requests: DataFrame, tokens: DataFrame, required: bool = False, window_ms: int = 60_000) -> DataFrame:
    """Identity, model allowlist and limiter. Adds identity columns and ``outcome`` (ok | 401 | 403_model | 429)."""
    return limit(identify(requests, tokens, required), window_ms)


def text_verdicts(df: DataFrame, text_col: str) -> DataFrame:
    """Add what the patterns say about a text, whatever the policy: ``found_types``, ``score``, ``labels``."""
    return (df.withColumn("found_types", dlp.found_types(F.col(text_col)))
            .withColumn("_hits", guard.hits(F.col(text_col)))
            .withColumn("score", guard.score(F.col("_hits"))).withColumn("labels", guard.labels(F.col("_hits")))
            .drop("_hits"))


_EVENT = "array<struct<seq: bigint, action: string, detail: string>>"


def violations_in(rows: DataFrame) -> Column:
    """Names that a row's policy finds: built-in types in ``detect`` order, then its own patterns."""
    found = dlp.violations_of(F.col("found_types"), F.col("detect"))
    if "custom_found" not in rows.columns:
        return found
    own = F.filter("custom", lambda c: F.array_contains(F.coalesce("custom_found", F.array().cast("array<string>")),
                                                        c["regex"]))
    return F.concat(found, F.coalesce(F.transform(own, lambda c: c["name"]), F.array().cast("array<string>")))


def apply_policy(rows: DataFrame, provider_col: str = "provider") -> DataFrame:
    """Outcome of each row's policy, given the text verdicts: ``outcome``, ``events`` (0-3), ``redact_with``.

    ``redact_with`` is the list of types to redact before relaying, null when the text passes as it is; with policies
    that bring their own patterns, ``redact_custom`` lists those. Only small columns are involved, not the text.
    """
    judged = (rows.withColumn("has_policy", F.col("source").isNotNull())
              .withColumn("violations", violations_in(rows))
              .withColumn("provider_resolved", provider_resolve(F.col(provider_col))))
    active = (F.col("outcome") == "ok") & F.col("has_policy")
    found = active & (F.size("violations") > 0)
    dlp_stop = found & (F.col("dlp_action") == "block")
    guard_stop = active & F.col("guard_enabled") & guard.blocked(F.col("score"), F.col("block_threshold"))
    provider_stop = active & ~provider_allowed(F.col("provider_resolved"), F.col("allowed_providers"))

    def event(cond: Column, action: Column, detail: Column) -> Column:
        return F.when(cond, F.struct(action.alias("action"), detail.alias("detail")))

    dlp_name = F.concat(F.lit("dlp_"), F.when(F.col("dlp_action") == "block", "blocked")
                        .when(F.col("dlp_action") == "redact", "redacted").otherwise("logged"))
    # The first check that stops a request is the last to raise an event.
    raised = F.array_compact(F.array(
        event(found, dlp_name, F.to_json(F.struct("violations"))),
        event(guard_stop & ~dlp_stop, F.lit("injection_blocked"),
              F.to_json(F.struct("score", F.col("labels").alias("matches")))),
        event(provider_stop & ~dlp_stop & ~guard_stop, F.lit("provider_blocked"),
              F.to_json(F.struct(F.col("provider_resolved").alias("provider"))))))
    numbered = F.transform(raised, lambda e, i: F.struct(
        (i + 1).cast("bigint").alias("seq"), e["action"].alias("action"), e["detail"].alias("detail")))
    outcome = (F.when(dlp_stop, "dlp_blocked").when(guard_stop, "injection_blocked")
               .when(provider_stop, "provider_blocked").otherwise(F.col("outcome")))
    keep = [c for c in rows.columns if c not in ("outcome", "found_types", "score", "labels", "custom_found")]
    masks = found & (F.col("dlp_action") == "redact")
    own = ([F.when(masks & (F.size("custom") > 0), F.col("custom")).alias("redact_custom")]
           if "custom_found" in rows.columns else [])
    return judged.select(
        *keep, "provider_resolved", outcome.alias("outcome"), numbered.cast(_EVENT).alias("events"),
        F.when(masks, F.col("detect")).alias("redact_with"), *own)


def govern(requests: DataFrame, prompts: DataFrame, tokens: DataFrame, stored: DataFrame, config: DataFrame,
           required: bool = False, window_ms: int = 60_000) -> DataFrame:
    """Every request with its ``outcome``, ``events`` and ``redact_with``.

    Patterns run once per stored text, not once per request: a popular prompt is scanned a single time, and only its
    small verdict meets the requests. Policies' own patterns (a ``custom`` column, see ``parse_policies``) run once for
    each text and distinct pattern that some request brings together.
    """
    known = auth_resolve(requests, tokens, required)
    return _governed(known, lambda rows: policy_resolve(rows, stored, config), prompts, window_ms)


def govern_asof(requests: DataFrame, prompts: DataFrame, tokens: DataFrame, stored: DataFrame, config: DataFrame,
                required: bool = False, window_ms: int = 60_000) -> DataFrame:
    """:func:`govern` by the identities and stored policies that held at the time of each request.

    ``tokens`` and ``stored`` are histories (see ``operators.history``).
    """
    known = auth_asof(requests, tokens, required)
    return _governed(known, lambda rows: policy_asof(rows, stored, config), prompts, window_ms)


def _governed(known: DataFrame, resolve, prompts: DataFrame, window_ms: int) -> DataFrame:
    admitted = resolve(limit(allowlisted(known), window_ms))
    verdicts = text_verdicts(prompts.select("prompt_id", "prompt"), "prompt").drop("prompt")
    if "custom" in admitted.columns:
        named = resolve(known.select("prompt_id", "policy_name", "created_at"))
        verdicts = verdicts.join(_custom_verdicts(named, prompts), "prompt_id", "left")
    return apply_policy(admitted.join(verdicts, "prompt_id", "left"))


def _custom_verdicts(named: DataFrame, prompts: DataFrame) -> DataFrame:
    """``prompt_id, custom_found`` of the texts that meet policies with patterns of their own."""
    asked = (named.select("prompt_id", "custom.regex").distinct()
             .select("prompt_id", F.explode("regex").alias("regex"))
             .groupBy("prompt_id").agg(F.collect_set("regex").alias("asked")))  # the distinct patterns of all policies
    return asked.join(prompts.select("prompt_id", "prompt"), "prompt_id").select(
        "prompt_id", custom_found(F.col("prompt"), F.col("asked")).alias("custom_found"))


def govern_bodies(requests: DataFrame, tokens: DataFrame, stored: DataFrame, config: DataFrame,
                  body_col: str = "body", required: bool = False, window_ms: int = 60_000) -> DataFrame:
    """:func:`govern` for requests that carry their own JSON body, with ``cache_key`` and ``rule`` of the relayed body.

    The scan sees system text, message strings, text blocks and legacy prompts; redaction rewrites message strings only.
    A body that is no JSON object has outcome ``400`` and says why in ``error``; it counts for no limit. An entry of
    ``messages`` that is no message is passed on as it is, and the others are scanned all the same.
    The key covers provider, model, messages and system after redaction. Each body is read and scanned where it lies;
    only narrow rows reach the limiter.
    """
    raw = F.col(body_col)
    rows = requests.withColumn("_parsed", B.parse_body(raw)).withColumn("error", B.body_error(raw, F.col("_parsed")))
    good = F.col("error").isNull()
    rows = rows.withColumn("_body", F.when(good, F.col("_parsed"))).drop("_parsed")
    rows = policy_resolve(identify(rows, tokens, required), stored, config)
    # What is no request at all is refused before anything else is asked.
    rows = rows.withColumn("outcome", F.when(good, F.col("outcome")).otherwise("400"))
    rows = (rows.withColumn("_entries", B.entries(F.col("_body.messages")))
            .withColumn("_fields", F.when(good, B.entry_fields(raw))))
    rows = text_verdicts(rows.withColumn("_text", B.request_text(F.col("_body"))), "_text")
    has_custom = "custom" in rows.columns
    if has_custom:
        rows = rows.withColumn("custom_found", custom_found(F.col("_text"), F.col("custom.regex")))
    masks = (F.size(violations_in(rows)) > 0) & (F.col("dlp_action") == "redact")
    strings = F.transform("_entries", lambda m: B.string_or_null(B.content_of(m)))
    by_type = F.transform(strings, lambda t: dlp.redact_by(t, F.col("detect")))
    rows = rows.withColumn("_strings", F.when(masks, by_type))
    if has_custom:
        rows = rows.withColumn("_strings", custom_masked_each(F.col("_strings"), F.col("custom")))
    key = request_hash_of(provider_resolve(F.col("provider")), F.col("_body.model"),
                          F.coalesce(F.transform("_entries", _relayed), F.array().cast("array<string>")), F.col("_body.system"))
    asked = B.last_user_text(F.transform("_entries", lambda m, at: F.struct(B.role_of(m).alias("role"), F.coalesce(
        F.get(F.col("_strings"), at).cast("variant"), B.content_of(m)).alias("content"))))
    narrow = rows.withColumn("cache_key", F.when(good, key)).withColumn("rule", rule_tier(asked)).drop(
        body_col, "_body", "_entries", "_fields", "_text", "_strings")
    return apply_policy(limit(narrow, window_ms))


def _relayed(entry: Column, at: Column) -> Column:
    """JSON of an entry, with its redacted string, where it has one, in place of its content; the order of keys stays."""
    text, fields = F.get(F.col("_strings"), at), F.get(F.col("_fields"), at)
    masked = F.transform_values(fields, lambda k, v: F.when((k == "content") & text.isNotNull(), text.cast("variant")).otherwise(v))
    return F.coalesce(F.when(B.is_object(entry), F.to_json(masked)), F.to_json(entry), F.lit("null"))


def relay_texts(governed: DataFrame, prompts: DataFrame) -> DataFrame:
    """``prompt_id, redact_key, relay_text`` for every distinct text that leaves governance.

    Join it back on both keys (see :func:`redact_key`).
    """
    own = ["redact_custom"] if "redact_custom" in governed.columns else []
    wanted = governed.filter("outcome = 'ok'").select(
        F.col("prompt_id").alias("_pid"), redact_key(governed).alias("redact_key"), "redact_with", *own).distinct()
    texts = wanted.join(prompts.select("prompt_id", "prompt"), F.col("_pid") == F.col("prompt_id"), "left")
    relayed = F.when(F.col("redact_with").isNotNull(), dlp.redact_by(F.col("prompt"), F.col("redact_with"))) \
        .otherwise(F.col("prompt"))
    texts = texts.withColumn("relay_text", relayed)
    if own:
        texts = texts.withColumn("relay_text", custom_masked(F.col("relay_text"), F.col("redact_custom")))
    return texts.select(F.col("_pid").alias("prompt_id"), "redact_key", "relay_text")


def redact_key(governed: DataFrame) -> Column:
    """Text form of what a row redacts; empty when its text passes as it is."""
    types = F.coalesce(F.array_join("redact_with", ","), F.lit(""))
    if "redact_custom" not in governed.columns:
        return types
    return F.concat_ws("|", types, F.to_json("redact_custom"))


def audit_events(governed: DataFrame) -> DataFrame:
    """``request_id, created_at, user_label, policy_name, seq, action, detail`` of all audit events."""
    # Not ``explode``: Spark puts a filter before it that works out the events a second time.
    return (governed.select("request_id", "created_at", F.col("label").alias("user_label"), "policy_name",
                            F.posexplode_outer("events").alias("_at", "e")).filter("_at IS NOT NULL")
            .select("request_id", "created_at", "user_label", "policy_name", "e.seq", "e.action", "e.detail"))
