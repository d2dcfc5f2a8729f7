"""DataFrame operators over text columns: scan, redact, guard, secret audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dlp, guard
from ..functions.custom import custom_masked
from ..functions.fixed_values import DEFAULT_BLOCK_THRESHOLD, INTERCEPTED_ORIGINS, RAW_KEY_PATTERNS, URL_PROVIDERS
from ..functions.regex import java_pattern


def _custom(df: DataFrame, custom: Sequence[dlp.CustomPattern]) -> list[dlp.CustomPattern]:
    return dlp.usable_custom(df.sparkSession, custom) if custom else []


def dlp_scan(df: DataFrame, text_col: str, detect: Sequence[str], custom: Sequence[dlp.CustomPattern] = (),
             action: str = "block") -> DataFrame:
    """Add ``violations`` (array) and ``blocked`` (boolean)."""
    found = dlp.violations(F.col(text_col), detect, _custom(df, custom))
    return (df.withColumn("violations", found)
            .withColumn("blocked", (F.size("violations") > 0) & F.lit(action == "block")))


def dlp_redact(df: DataFrame, text_col: str, detect: Sequence[str], custom: Sequence[dlp.CustomPattern] = (),
               out_col: str = "redacted") -> DataFrame:
    return df.withColumn(out_col, dlp.redact(F.col(text_col), detect, _custom(df, custom)))


def dlp_filter_block(df: DataFrame, text_col: str, detect: Sequence[str],
                     custom: Sequence[dlp.CustomPattern] = (), action: str = "block") -> DataFrame:
    """Rows that survive the scan."""
    return dlp_scan(df, text_col, detect, custom, action).filter(~F.col("blocked")).drop("violations", "blocked")


def guard_score(df: DataFrame, text_col: str, threshold: float = DEFAULT_BLOCK_THRESHOLD) -> DataFrame:
    """Add ``score``, ``labels`` (array) and ``blocked`` (boolean). Threshold 0 blocks everything."""
    hit = df.withColumn("_hits", guard.hits(F.col(text_col)))
    return (hit.withColumn("score", guard.score(F.col("_hits"))).withColumn("labels", guard.labels(F.col("_hits")))
            .withColumn("blocked", guard.blocked(F.col("score"), threshold)).drop("_hits"))


def label_report(df: DataFrame, labels_col: str) -> DataFrame:
    """Rows per label of an array column."""
    # Not ``explode``: Spark puts a filter before it that works out the array, and all patterns in it, a second time.
    return (df.select(F.posexplode_outer(labels_col).alias("_at", "label")).filter("_at IS NOT NULL").groupBy("label")
            .agg(F.count(F.lit(1)).alias("n")))


def redact_messages(turns: DataFrame, detect: Sequence[str], roles: Sequence[str] | None = None,
                    text_col: str = "text", custom: Sequence[dlp.CustomPattern] = ()) -> DataFrame:
    """Redact message strings of a turn table; only of the given roles when set."""
    redacted = dlp.redact(F.col(text_col), detect, _custom(turns, custom))
    if roles is not None:
        redacted = F.when(F.col("role").isin(list(roles)), redacted).otherwise(F.col(text_col))
    return turns.withColumn(text_col, redacted)


def redact_message_array(messages: Column, detect: Sequence[str]) -> Column:
    """Redact string contents of a nested ``array<struct<role, content: variant>>``; blocks pass untouched."""
    def one(m: Column) -> Column:
        is_string = F.schema_of_variant(m["content"]) == "STRING"
        text = dlp.redact(F.try_variant_get(m["content"], "$", "string"), detect)
        return F.struct(m["role"].alias("role"),
                        F.when(is_string, text.cast("variant")).otherwise(m["content"]).alias("content"))
    return F.transform(messages, one)


def output_redact(turns: DataFrame, detect: Sequence[str], text_col: str = "text") -> DataFrame:
    """Redacted model output: the assistant turns of a turn table."""
    return redact_messages(turns.filter(F.col("role") == "assistant"), detect, text_col=text_col)


def output_redact_policy(outputs: DataFrame, text_col: str = "text") -> DataFrame:
    """Model output under each row's policy: where ``redact_output`` is set, its types and its own patterns are masked."""
    masks = F.coalesce(F.col("redact_output"), F.lit(False))
    text = F.when(masks, dlp.redact_by(F.col(text_col), F.col("detect"))).otherwise(F.col(text_col))
    out = outputs.withColumn(text_col, text)
    if "custom" not in outputs.columns:
        return out
    return out.withColumn(text_col, custom_masked(F.col(text_col), F.when(masks, F.col("custom"))))


def detect_raw_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``is_raw_key``: some column starts like a provider key."""
    pattern = java_pattern("|".join(RAW_KEY_PATTERNS))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return df.withColumn("is_raw_key", hit)


def provider_from_url(df: DataFrame, url_col: str) -> DataFrame:
    """Add ``intercepted`` and, for intercepted URLs, ``provider``."""
    url = F.col(url_col)
    hit = F.lit(False)
    for origin in INTERCEPTED_ORIGINS:
        hit = hit | url.startswith(origin)
    name = None
    for part, provider in URL_PROVIDERS:
        cond = F.contains(url, F.lit(part))
        name = F.when(cond, provider) if name is None else name.when(cond, provider)
    return (df.withColumn("intercepted", F.coalesce(hit, F.lit(False)))
            .withColumn("provider", F.when(F.col("intercepted"), name.otherwise("anthropic"))))
