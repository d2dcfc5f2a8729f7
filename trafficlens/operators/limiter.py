"""Requests-per-window limiter over a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchored import anchored_windows, assign_windows


PARTS = 256  # parts of a window that are summed by themselves


def _sums_before(points: DataFrame, window_ms: int) -> DataFrame:
    """``_label, _ts, _before``: for each point, the sum of ``_n`` at the earlier times of its window."""
    part = F.floor((F.col("_ts") - F.col("_start")) * PARTS / F.lit(window_ms + 1)).cast("int")
    points = points.withColumn("_part", part)
    parts = points.groupBy("_label", "_start", "_part").agg(F.sum("_n").alias("_sum"))
    earlier = lambda *by: Window.partitionBy("_label", "_start", *by).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_label").alias("_l"), F.col("_start").alias("_s"), F.col("_part").alias("_p"), F.coalesce(
        F.sum("_sum").over(earlier().orderBy("_part")), F.lit(0)).alias("_lead"))
    inside = points.withColumn("_inside", F.coalesce(F.sum("_n").over(earlier("_part").orderBy("_ts")), F.lit(0)))
    on = (F.col("_label") == F.col("_l")) & (F.col("_start") == F.col("_s")) & (F.col("_part") == F.col("_p"))
    return inside.join(parts, on).select("_label", "_ts", (F.col("_lead") + F.col("_inside")).alias("_before"))


def rate_limit(requests: DataFrame, window_ms: int = 60_000, label: str = "label", limit: str = "rpm_limit",
               ts_ms: str = "ts_ms", row_id: str = "request_id") -> DataFrame:
    """Add ``allowed`` (1/0) to every row.

    A window is anchored at its first request and runs out once more than ``window_ms`` have passed. Denied requests
    count too. Limit 0 means unlimited; such rows, and rows without a label or time, skip the limiter altogether.

    Requests are counted per label and time before anything is shuffled, and those counts are summed along each window.
    A window is cut into ``PARTS`` parts whose totals are summed first, so no task sums a whole window of a busy label.
    A row is compared with the sum at its own time; only equal times are ranked, so a busy label spreads over its times.
    """
    counts = (F.col(limit) > 0) & F.col(label).isNotNull() & F.col(ts_ms).isNotNull()
    limited = requests.filter(counts)
    free = requests.filter(~F.coalesce(counts, F.lit(False))).withColumn("allowed", F.lit(1).cast("bigint"))
    points = (limited.groupBy(F.col(label).alias("_label"), F.col(ts_ms).alias("_ts"))
              .agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_n")))
    windows = anchored_windows(points, "_label", "_ts", "_first", window_ms)
    placed = assign_windows(points, windows, "_label", "_ts", "_first", window_ms)
    summed = _sums_before(placed.select("_label", "_ts", F.col("win.start").alias("_start"), "_n"), window_ms)
    joined = limited.join(summed, (limited[label] == summed["_label"]) & (limited[ts_ms] == summed["_ts"]))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_label", "_ts").orderBy(row_id))
    ranked = joined.withColumn("allowed", (rank <= F.col(limit)).cast("bigint")).drop("_label", "_ts", "_before")
    return ranked.unionByName(free)
