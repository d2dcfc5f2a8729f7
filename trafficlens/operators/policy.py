"""Policies: parsing, resolution, provider rules and system-prompt locks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.custom import CUSTOM
from ..functions.fixed_values import (DEFAULT_BLOCK_THRESHOLD, DEFAULT_PROVIDER, DEFAULT_RETENTION_DAYS,
                                      KEY_PREFIX_PROVIDERS, POLICY_PRESETS, PROVIDERS)
from ..sources.schemas import POLICY_CONFIG
from .identity import csv_list


def parse_policies(policies: DataFrame, config_col: str = "config") -> DataFrame:
    """Flat policy columns from JSON configs. A missing ``enabled`` means on; a missing section keeps its default.

    Without a ``detect`` list nothing is scanned, even when custom patterns are given.
    """
    p = policies.withColumn("_p", F.from_json(config_col, POLICY_CONFIG))
    c = F.col("_p")
    on = lambda flag: F.coalesce(flag, F.lit(True))
    none = F.array().cast("array<string>")
    detect = F.coalesce(c["dlp"]["detect"], none)
    custom = F.filter(c["dlp"]["customPatterns"], lambda x: x["name"].isNotNull() & x["regex"].isNotNull())
    no_custom = F.array().cast(CUSTOM)
    return p.select(
        "name",
        F.when(on(c["dlp"]["enabled"]), detect).otherwise(none).alias("detect"),
        F.when(on(c["dlp"]["enabled"]) & (F.size(detect) > 0), F.coalesce(custom, no_custom)).otherwise(no_custom)
        .alias("custom"),
        F.coalesce(c["dlp"]["action"], F.lit("block")).alias("dlp_action"),
        on(c["promptGuard"]["enabled"]).alias("guard_enabled"),
        F.coalesce(c["promptGuard"]["blockThreshold"], F.lit(DEFAULT_BLOCK_THRESHOLD)).alias("block_threshold"),
        F.coalesce(c["allowedProviders"], none).alias("allowed_providers"),
        c["systemPromptLock"]["prepend"].alias("system_prepend"),
        c["systemPromptLock"]["append"].alias("system_append"),
        F.coalesce(c["outputFilter"]["enabled"] & c["outputFilter"]["redactPII"], F.lit(False)).alias("redact_output"),
        F.coalesce(c["logging"]["retentionDays"], F.lit(DEFAULT_RETENTION_DAYS)).cast("bigint")
        .alias("retention_days"))


def flat_policies(policies: DataFrame, source: str) -> DataFrame:
    """The same columns from an already flattened table (lists as comma-separated text)."""
    prepend = F.col("system_prepend") if "system_prepend" in policies.columns else F.lit(None).cast("string")
    return policies.filter(F.col("source") == source).select(
        "name", csv_list(F.col("detect_csv")).alias("detect"), "dlp_action",
        F.lit(True).alias("guard_enabled"), F.col("block_threshold").cast("double").alias("block_threshold"),
        csv_list(F.col("allowed_providers_csv")).alias("allowed_providers"), prepend.alias("system_prepend"),
        F.lit(None).cast("string").alias("system_append"), F.lit(False).alias("redact_output"), "retention_days")


def presets(spark) -> DataFrame:
    """The built-in policy presets as a table."""
    return spark.createDataFrame(
        [(n, d, a, t, p, r) for n, d, a, t, p, r in POLICY_PRESETS],
        "name string, detect array<string>, dlp_action string, block_threshold double, "
        "allowed_providers array<string>, retention_days bigint")


def list_policies(policies: DataFrame) -> DataFrame:
    return policies.orderBy("name")


def policy_union(stored: DataFrame, config: DataFrame) -> DataFrame:
    """Stored policies and those configured ones whose name is not stored, with ``source``."""
    extra = config.join(stored.select("name"), "name", "left_anti").withColumn("source", F.lit("config"))
    return stored.withColumn("source", F.lit("db")).unionByName(extra, allowMissingColumns=True)


def policy_resolve(named: DataFrame, stored: DataFrame, config: DataFrame, name: str = "policy_name") -> DataFrame:
    """Join each row's policy: the stored one as a whole, else the configured one, else none (``source`` null)."""
    effective = policy_union(stored, config)
    return named.join(effective.withColumnRenamed("name", "_name"), F.col(name) == F.col("_name"), "left") \
        .drop("_name")


def provider_resolve(header: Column, auth_header: Column | None = None, default: str = DEFAULT_PROVIDER,
                     known: Sequence[str] = PROVIDERS) -> Column:
    """Provider of a request: known header value, ``custom``, raw key prefix, else the default."""
    out = F.when(header.isin([*known, "custom"]), header)
    if auth_header is not None:
        for prefix, provider in KEY_PREFIX_PROVIDERS:
            out = out.when(auth_header.startswith(prefix), provider)
    return out.otherwise(F.lit(default))


def provider_allowed(provider: Column, allowed: Column) -> Column:
    allowed = F.coalesce(allowed, F.array().cast("array<string>"))
    return (F.size(allowed) == 0) | F.array_contains(allowed, provider)


def _joined(*parts: Column | str | None) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts if p is not None]
    return F.concat_ws("\n\n", *[F.nullif(c, F.lit("")) for c in cols])


def lock_system_text(system: Column, prepend: Column | str | None, append: Column | str | None) -> Column:
    """System text with the mandated parts around it (providers with a top-level system field)."""
    return _joined(prepend, system, append)


def lock_messages(messages: Column, prepend: str | None, append: str | None) -> Column:
    """The same for a nested ``array<struct<role, content: string>>``: rewrite the first system message or insert one."""
    if not prepend and not append:
        return messages
    at = F.array_position(F.transform(messages, lambda m: m["role"]), F.lit("system"))
    locked = lambda text: F.struct(F.lit("system").alias("role"), _joined(prepend, text, append).alias("content"))
    inserted = F.concat(F.array(locked(F.lit(""))), messages)
    rewritten = F.transform(messages, lambda m, i: F.when(i + 1 == at, locked(m["content"])).otherwise(m))
    return F.when(messages.isNull(), messages).when(at == 0, inserted).otherwise(rewritten)


def prompt_lock(turns: DataFrame, prepend: str | None, append: str | None) -> DataFrame:
    """Turn-table form: the first system turn is rewritten; conversations without one get turn -1."""
    if not prepend and not append:
        return turns
    first = (turns.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "system", F.col("turn"))).alias("_sys"))
             .withColumnRenamed("conv_id", "_conv"))
    is_first = F.coalesce(F.col("turn") == F.col("_sys"), F.lit(False))
    rewritten = (turns.join(first.filter("_sys IS NOT NULL"), (F.col("conv_id") == F.col("_conv"))
                            & (F.col("turn") == F.col("_sys")), "left")
                 .select("conv_id", "turn", "role",
                         F.when(is_first, _joined(prepend, F.col("text"), append)).otherwise(F.col("text"))
                         .alias("text")))
    inserted = first.filter("_sys IS NULL").select(
        F.col("_conv").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"),
        _joined(prepend, append).alias("text"))
    return rewritten.unionByName(inserted)
