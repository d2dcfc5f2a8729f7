"""Cost, savings and usage reports over the request log."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import PERIODS
from ..functions.pricing import NANO, usd
from ..functions.scalars import js_round, period_bounds, period_divisor

_COUNTS = {
    "total": lambda: F.lit(True),
    "cached": lambda: F.col("from_cache") == 1,
    # Counts rows answered in zero milliseconds; the name is kept for compatibility.
    "streamed": lambda: F.col("duration_ms") == 0,
    "tier_simple": lambda: F.col("routing_tier") == "simple",
    "tier_standard": lambda: F.col("routing_tier") == "standard",
    "tier_complex": lambda: F.col("routing_tier") == "complex",
    "m_classifier": lambda: F.col("routing_method") == "classifier",
    "m_rule": lambda: F.col("routing_method") == "rule",
    "m_header": lambda: F.col("routing_method") == "header",
    "m_default": lambda: F.col("routing_method") == "default",
    "m_cache": lambda: F.col("from_cache") == 1,
}
_SUMS = {"total_input": "input_tokens", "total_output": "output_tokens", "cost": "cost_nano", "saved": "saved_nano"}
COUNT_COLUMNS = list(_COUNTS)
MEASURES = [*COUNT_COLUMNS, *_SUMS]
REPORT_COLUMNS = COUNT_COLUMNS + ["total_input", "total_output", "actual_usd", "saved_usd",
                                  "would_have_cost_usd", "savings_pct"]


def day_of(seconds: int) -> str:
    """The UTC day of a time, as it names a date folder."""
    return str(date(1970, 1, 1) + timedelta(days=seconds // 86_400))


def _since(log: DataFrame, low: int) -> DataFrame:
    kept = log.filter(F.col("created_at") >= low)
    # Date folders that cannot hold such rows are not even listed.
    return kept.filter(F.col("dt") >= day_of(low)) if "dt" in log.columns else kept


def _within(log: DataFrame, low: int, high: int) -> DataFrame:
    kept = _since(log, low).filter(F.col("created_at") <= high)
    return kept.filter(F.col("dt") <= day_of(high)) if "dt" in log.columns else kept


def measures() -> list[Column]:
    """The counts and sums of a report over a priced log; money in nano-USD."""
    out = [F.sum(F.coalesce(cond(), F.lit(False)).cast("bigint")).alias(name) for name, cond in _COUNTS.items()]
    return out + [F.sum(c).alias(name) for name, c in _SUMS.items()]


def _again() -> list[Column]:
    """Sum the measures once more. Money goes through DECIMAL: all users together may exceed a BIGINT of nano-USD."""
    out = [F.sum(n).alias(n) for n in [*COUNT_COLUMNS, "total_input", "total_output"]]
    return out + [F.sum(F.col(n).cast("decimal(20,0)")).alias(n) for n in ("cost", "saved")]


def _report(divisor: Column) -> list[Column]:
    div = lambda value: js_round(F.coalesce(value, F.lit(0)).cast("double") / divisor, 2)
    actual, saved = (div(F.col(n).cast("double") / F.lit(float(NANO))) for n in ("cost", "saved"))
    # Later parts are computed from the already rounded ones.
    would = js_round(actual + saved, 2)
    pct = F.when(would > 0, js_round(saved / would * F.lit(100.0), 1)).otherwise(F.lit(0.0))
    cols = [div(F.col(n)).alias(n) for n in [*COUNT_COLUMNS, "total_input", "total_output"]]
    return cols + [actual.alias("actual_usd"), saved.alias("saved_usd"), would.alias("would_have_cost_usd"),
                   pct.alias("savings_pct")]


def _divisor_of(period: Column) -> Column:
    out = None
    for name, _, divisor in PERIODS:
        out = (F.when if out is None else out.when)(period == name, F.lit(float(divisor)))
    return out


def _ring(at: Column, starts: list[int]) -> Column:
    """The periods nest, so a time belongs to exactly one of their rings."""
    return F.coalesce(*[F.when(at >= s, F.lit(i)) for i, s in enumerate(starts)])


def _starts(as_of: int) -> list[int]:
    return sorted({low for low, _ in period_bounds(as_of).values()}, reverse=True)


def _cube(per_ring: DataFrame, as_of: int) -> DataFrame:
    """Expand sums per user and ring, of which there are few, to all periods and totals."""
    starts = _starts(as_of)
    member = F.array_compact(F.array(*[
        F.when(F.col("ring") <= starts.index(low), F.lit(name)) for name, (low, _) in period_bounds(as_of).items()]))
    expanded = per_ring.withColumn("period", F.explode(member))
    cube = (expanded.groupingSets([["period", "user_label"], ["period"]], "period", "user_label").agg(*_again()))
    return cube.select("period", "user_label", *_report(_divisor_of(F.col("period"))))


def _per_ring(log: DataFrame, as_of: int) -> DataFrame:
    starts = _starts(as_of)
    rows = _within(log, starts[-1], as_of).withColumn("ring", _ring(F.col("created_at"), starts))
    return rows.groupBy("user_label", "ring").agg(*measures())


def stats_cube(log: DataFrame, as_of: int) -> DataFrame:
    """Every period for every user and for all users (``user_label`` null) in one pass over a priced log."""
    return _cube(_per_ring(log, as_of), as_of)


def daily_sums(log: DataFrame) -> DataFrame:
    """The measures of a dated, priced log per day and user; money in nano-USD."""
    return log.groupBy("dt", "user_label").agg(*measures())


def merged_sums(daily: DataFrame) -> DataFrame:
    """One row per day and user of daily sums that may hold several, whose measures add up."""
    return daily.groupBy("dt", "user_label").agg(*[F.sum(n).alias(n) for n in MEASURES])


def stats_cube_daily(daily: DataFrame, log: DataFrame, as_of: int) -> DataFrame:
    """:func:`stats_cube` from daily sums. Of the ``log`` it reads only the days that a period's end cuts in two."""
    starts = _starts(as_of)
    cut = sorted({day_of(t) for t in [*starts, as_of]})
    start = F.unix_date(F.col("dt").cast("date")).cast("bigint") * 86_400
    whole = (daily.filter((F.col("dt") > day_of(starts[-1])) & (F.col("dt") < day_of(as_of)) & ~F.col("dt").isin(cut))
             .withColumn("ring", _ring(start, starts)).select("user_label", "ring", *MEASURES))
    parts = _per_ring(log.filter(F.col("dt").isin(cut)), as_of)
    return _cube(whole.unionByName(parts), as_of)


def period_stats(log: DataFrame, as_of: int, period: str, user: str | None = None) -> DataFrame:
    """One report row (also for an empty period)."""
    low, high = period_bounds(as_of)[period]
    rows = _within(log, low, high)
    if user is not None:
        rows = rows.filter(F.col("user_label") == user)
    total = rows.groupBy("user_label").agg(*measures()).agg(*_again())
    return total.select(F.lit(period).alias("period"), F.lit(low).cast("bigint").alias("from_ts"),
                        F.lit(high).cast("bigint").alias("to_ts"), *_report(F.lit(float(period_divisor(period)))))


def model_usage(log: DataFrame, as_of: int, period: str) -> DataFrame:
    """``model, cnt`` per routed model."""
    return _scaled(_used(log, as_of, period), period)


def _used(log: DataFrame, as_of: int, period: str) -> DataFrame:
    low, high = period_bounds(as_of)[period]
    return (_within(log, low, high).filter(F.col("routed_model") != "")
            .groupBy(F.col("routed_model").alias("model")).agg(F.count(F.lit(1)).alias("cnt")))


def _scaled(df: DataFrame, period: str) -> DataFrame:
    divisor = period_divisor(period)
    return df.withColumn("cnt", js_round(F.col("cnt") / F.lit(float(divisor))).cast("bigint"))


def top_models(log: DataFrame, as_of: int, period: str, n: int = 8) -> DataFrame:
    return model_usage(log, as_of, period).orderBy(F.desc("cnt"), "model").limit(n)


def routing_switches(log: DataFrame, as_of: int, period: str, n: int = 20) -> DataFrame:
    """``src, dst, cnt`` of the most frequent model changes, ranked on raw counts."""
    low, high = period_bounds(as_of)[period]
    top = (_within(log, low, high)
           .filter((F.col("original_model") != "") & (F.col("routed_model") != "")
                   & (F.col("original_model") != F.col("routed_model")))
           .groupBy(F.col("original_model").alias("src"), F.col("routed_model").alias("dst"))
           .agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "src", "dst").limit(n))
    return _scaled(top, period)


def cache_stats(log: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    total, hits = F.count(F.lit(1)), F.coalesce(F.sum("from_cache").cast("bigint"), zero)
    return log.agg(total.alias("total_requests"), hits.alias("cache_hits"), (total - hits).alias("cache_misses"),
                   F.when(total > 0, hits / total).otherwise(0.0).alias("hit_rate"),
                   F.coalesce(F.sum("input_tokens"), zero).alias("total_input_tokens"),
                   F.coalesce(F.sum("output_tokens"), zero).alias("total_output_tokens"),
                   F.coalesce(js_round(F.avg("duration_ms")).cast("bigint"), zero).alias("avg_duration_ms"))


def user_stats(log: DataFrame) -> DataFrame:
    """``user_label, reqs, cost, saved`` over all time."""
    return (log.groupBy("user_label")
            .agg(F.count(F.lit(1)).alias("reqs"), F.sum("cost_nano").alias("cost"), F.sum("saved_nano").alias("saved"))
            .select("user_label", "reqs", usd(F.col("cost")).alias("cost"), usd(F.col("saved")).alias("saved")))


def recent_events(policy_log: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest audit events; the limit is 50 by default, 200 at most."""
    n = min(limit or 50, 200)
    if n < 0:
        raise ValueError("limit must not be negative")
    return (policy_log.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
            .select("id", "created_at", "user_label", "policy_name", "action", "detail"))


def purge_logs(log: DataFrame, as_of: int, days: int) -> DataFrame:
    """Log rows kept by a retention of ``days``; 0 or less keeps everything."""
    return log if days <= 0 else _since(log, as_of - days * 86_400)


def retention_days(tokens: DataFrame, policies: DataFrame) -> DataFrame:
    """``_label, retention_days`` of the users whose policy sets a retention."""
    return (tokens.join(policies.select(F.col("name").alias("_name"), "retention_days"),
                        F.col("policy_name") == F.col("_name"))
            .select(F.col("label").alias("_label"), "retention_days"))


def purge_by_policy(log: DataFrame, tokens: DataFrame, policies: DataFrame, as_of: int) -> DataFrame:
    """Log rows kept by each user's own policy retention; rows without a policy keep to no limit here.

    ``policies`` is the effective list (see ``policy_union``). A retention of 0 keeps everything. Every row is read and
    returned; ``sources.tables.purge_policy_folders`` purges a stored log in place and leaves whole days alone.
    """
    joined = log.join(retention_days(tokens, policies), F.col("user_label") == F.col("_label"), "left")
    keep = F.col("retention_days").isNull() | (F.col("retention_days") <= 0) \
        | (F.col("created_at") >= F.lit(as_of) - F.col("retention_days") * 86_400)
    return joined.filter(keep).drop("_label", "retention_days")
