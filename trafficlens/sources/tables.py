"""Stored tables of which a change rewrites only the folders it touches.

Keyed tables (cache entries, identities, policies, sessions) lie in a fixed number of hash buckets, logs in a folder a
day. An upsert or a deletion reads and replaces the buckets of its own keys; a purge drops whole days, rewrites those in
which rows of both kinds lie, and does not read the others. Which folders that are is decided on narrow columns or on
file names alone. A replaced folder is written beside the old one and put in its place when the job commits, so a lost
executor or a repeated task does no harm; a change that was broken off between folders is completed by running it again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.stats import MEASURES, daily_sums, day_of, merged_sums, purge_by_policy, retention_days

BUCKETS = 256
BUCKET = "bucket"
DAY = "dt"
_LEDGER = "_purged.json"  # readers of the table pass over names with an underscore


def _read(spark: SparkSession, path: str, schema: StructType, column: str, kind: DataType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField(column, kind)])).parquet(path)


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str, column: str) -> dict[str, tuple[str, ...]]:
    """Names of the data files in each folder ``column=value`` of a table, by value."""
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return {}
    lead = f"{column}="
    found = [f.getPath() for f in fs.listStatus(place) if f.isDirectory() and f.getPath().getName().startswith(lead)]
    data = lambda folder: (f.getPath().getName() for f in fs.listStatus(folder))
    return {p.getName()[len(lead):]: tuple(sorted(n for n in data(p) if n[0] not in "_.")) for p in found}


def drop_folders(spark: SparkSession, path: str, column: str, values: Iterable[str]) -> None:
    for value in values:
        fs, place = _fs(spark, f"{path}/{column}={value}")
        fs.delete(place, True)


def replace_folders(rows: DataFrame, path: str, column: str, values: Iterable[str]) -> None:
    """Put ``rows`` in place of all rows of the folders ``values``; a folder that gets none is dropped.

    ``rows`` may be read from these folders.
    """
    spark = rows.sparkSession
    before = folders(spark, path, column)
    (rows.hint("rebalance", F.col(column)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(column).parquet(path))
    after = folders(spark, path, column)
    drop_folders(spark, path, column, [v for v in values if v in before and after.get(v) == before[v]])


# --- Keyed tables in hash buckets ------------------------------------------------------------------------------------

def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A new keyed table."""
    placed = rows.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    placed.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: StructType, only: list[int] | None = None) -> DataFrame:
    rows = _read(spark, path, schema, BUCKET, IntegerType())
    return (rows if only is None else rows.filter(F.col(BUCKET).isin(only))).drop(BUCKET)


def change_buckets(spark: SparkSession, path: str, schema: StructType, key: str, keys: DataFrame,
                   change: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Replace the buckets of ``keys`` by ``change`` of their rows; returns their numbers."""
    at = bucket_of(F.col(key), buckets)
    touched = sorted(r[0] for r in keys.select(at).distinct().collect())  # no more than there are buckets
    if touched:
        rows = change(read_buckets(spark, path, schema, touched)).withColumn(BUCKET, at)
        replace_folders(rows, path, BUCKET, map(str, touched))
    return touched


def upsert_buckets(spark: SparkSession, path: str, schema: StructType, key: str, changes: DataFrame,
                   merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Merge ``changes`` into the stored table; ``merge(stored, changes)`` is the operator that does so for a whole one."""
    return change_buckets(spark, path, schema, key, changes, lambda rows: merge(rows, changes), buckets)


def delete_buckets(spark: SparkSession, path: str, schema: StructType, key: str, doomed: Column, buckets: int = BUCKETS) -> list[int]:
    """Delete all rows of the keys that have a row for which ``doomed`` holds."""
    keys = read_buckets(spark, path, schema).filter(doomed).select(key).distinct()
    return change_buckets(spark, path, schema, key, keys, lambda rows: rows.join(keys, key, "left_anti"), buckets)


# --- Logs in a folder a day ------------------------------------------------------------------------------------------

def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored log with its ``dt``, by which folders are left out."""
    return _read(spark, path, schema, DAY, StringType())


def purge_log_folders(spark: SparkSession, path: str, schema: StructType, as_of: int, days: int) -> dict[str, list[str]]:
    """Keep the rows of the last ``days``; 0 or less keeps everything. Days ``dropped``, ``rewritten`` and ``kept``."""
    held = sorted(folders(spark, path, DAY))
    if days <= 0:
        return {"dropped": [], "rewritten": [], "kept": held}
    low = as_of - days * 86_400
    dropped, edge = [d for d in held if d < day_of(low)], day_of(low)
    drop_folders(spark, path, DAY, dropped)
    rewritten = []
    if edge in held:  # the only day in which rows of both kinds can lie
        rows = read_log(spark, path, schema).filter(F.col(DAY) == edge)
        if not rows.filter(F.col("created_at") < low).isEmpty():
            replace_folders(rows.filter(F.col("created_at") >= low), path, DAY, [edge])
            rewritten = [edge]
    return {"dropped": dropped, "rewritten": rewritten, "kept": [d for d in held if d not in dropped and d not in rewritten]}


def purge_policy_folders(spark: SparkSession, path: str, schema: StructType, tokens: DataFrame, policies: DataFrame,
                         as_of: int) -> dict[str, list[str]]:
    """Purge a stored log by each user's own retention (see ``purge_by_policy``).

    Days younger than the least retention hold nothing to purge. Of the others it is remembered, beside the table, when
    the next of their rows is due; a day that has the same files as then, under the same retentions, is not even read
    before that time. Of the days that are read, a row count by day tells which to drop or rewrite. Days ``dropped``,
    ``rewritten``, ``counted`` (read, nothing due) and ``kept`` (not read).
    """
    days = retention_days(tokens, policies).filter("retention_days > 0")
    least, digest, n = days.agg(F.min("retention_days"), F.bit_xor(F.xxhash64("_label", "retention_days")),
                                F.count(F.lit(1))).first()
    held = folders(spark, path, DAY)
    told = {"dropped": [], "rewritten": [], "counted": [], "kept": sorted(held)}
    if not n:
        return told
    known = _ledger(spark, path)
    state = f"{digest}/{n}"

    def quiet(day: str) -> bool:
        was = known.get(day)
        return bool(was) and was["files"] == list(held[day]) and was["state"] == state and (was["due"] is None or was["due"] > as_of)

    asked = [d for d in sorted(held) if d <= day_of(as_of - least * 86_400) and not quiet(d)]
    told["kept"] = [d for d in sorted(held) if d not in asked]
    if not asked:
        return told
    log = read_log(spark, path, schema).filter(F.col(DAY).isin(asked))
    until = F.col("created_at") + F.col("retention_days") * 86_400
    counts = (log.select(DAY, "user_label", "created_at").join(days, F.col("user_label") == F.col("_label"), "left")
              .groupBy(DAY).agg(F.count_if(until < as_of).alias("due"), F.count(F.lit(1)).alias("n"),
                                F.min(F.when(until >= as_of, until)).alias("next")).collect())  # a row a day
    told["dropped"] = sorted(r[DAY] for r in counts if r["due"] == r["n"])
    told["rewritten"] = sorted(r[DAY] for r in counts if 0 < r["due"] < r["n"])
    told["counted"] = sorted(r[DAY] for r in counts if not r["due"])
    drop_folders(spark, path, DAY, told["dropped"])
    if told["rewritten"]:
        rows = log.filter(F.col(DAY).isin(told["rewritten"]))
        replace_folders(purge_by_policy(rows, tokens, policies, as_of), path, DAY, told["rewritten"])
    left = folders(spark, path, DAY)
    due = {r[DAY]: r["next"] for r in counts}
    # a row is due the second after its last one
    noted = {d: {"files": list(left[d]), "state": state, "due": None if due[d] is None else due[d] + 1} for d in due if d in left}
    _note(spark, path, {**{d: v for d, v in known.items() if d in left}, **noted})
    return told


# --- Daily sums of a log ---------------------------------------------------------------------------------------------

_SUMMED = "_summed.json"
MOST_PARTS = 8  # files of one day's sums before they are merged
_SUMS = StructType([StructField("user_label", StringType()), *[StructField(n, LongType()) for n in MEASURES]])


def update_daily(spark: SparkSession, log_path: str, schema: StructType, daily_path: str,
                 priced: Callable[[DataFrame], DataFrame]) -> dict[str, list[str]]:
    """Bring a stored table of daily sums up to date with a stored log, reading only files that are new to it.

    New files of a day, late rows included, add rows that hold their sums alone; a day of which files are gone (purged,
    rewritten) is summed anew, as is one whose last update was broken off. Days ``added``, ``redone``, ``dropped``
    and ``merged``.
    """
    held = folders(spark, log_path, DAY)
    # Without a ledger nothing is known of sums that are there.
    known = _ledger(spark, daily_path, _SUMMED) or {d: {"files": [], "open": True} for d in folders(spark, daily_path, DAY)}
    new = {d: sorted(set(files) - set(known.get(d, {}).get("files", ()))) for d, files in held.items()}
    redone = [d for d in sorted(held) if d in known and (known[d]["open"] or set(known[d]["files"]) - set(held[d]))]
    added = [d for d in sorted(held) if new[d] and d not in redone]
    dropped = sorted(set(known) - set(held))
    state = {d: {"files": list(held[d]), "open": False} for d in held}
    # What is about to change is open until all of it is written.
    _note(spark, daily_path, {**known, **state, **{d: {"files": [], "open": True} for d in [*redone, *added]}}, _SUMMED)
    drop_folders(spark, daily_path, DAY, dropped)
    if redone:
        rows = read_log(spark, log_path, schema).filter(F.col(DAY).isin(redone))
        replace_folders(daily_sums(priced(rows)), daily_path, DAY, redone)
    if added:
        paths = [f"{log_path}/{DAY}={d}/{name}" for d in added for name in new[d]]
        files = spark.read.schema(StructType([*schema.fields, StructField(DAY, StringType())])).option("basePath", log_path)
        rows = daily_sums(priced(files.parquet(*paths)))
        rows.hint("rebalance", F.col(DAY)).write.mode("append").partitionBy(DAY).parquet(daily_path)
    _note(spark, daily_path, state, _SUMMED)
    crowded = sorted(d for d, files in folders(spark, daily_path, DAY).items() if len(files) > MOST_PARTS)
    if crowded:
        rows = merged_sums(_read(spark, daily_path, _SUMS, DAY, StringType()).filter(F.col(DAY).isin(crowded)))
        replace_folders(rows, daily_path, DAY, crowded)
    return {"added": added, "redone": redone, "dropped": dropped, "merged": crowded}


def read_daily(spark: SparkSession, daily_path: str) -> DataFrame:
    """``dt, user_label`` and the measures; a day and user may have several rows, whose measures add up."""
    return _read(spark, daily_path, _SUMS, DAY, StringType())


# --- What is known of a table, in a small file beside it ---------------------------------------------------------------

def _ledger(spark: SparkSession, path: str, name: str = _LEDGER) -> dict[str, dict]:
    fs, place = _fs(spark, f"{path}/{name}")
    if not fs.exists(place):
        return {}
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _note(spark: SparkSession, path: str, ledger: dict[str, dict], name: str = _LEDGER) -> None:
    """One entry for each day of the table. The new ledger takes the place of the old one when it is whole."""
    fs, place = _fs(spark, f"{path}/{name}")
    _, fresh = _fs(spark, f"{path}/{name}.new")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(json.dumps(ledger).encode()))
    finally:
        stream.close()
    fs.delete(place, False)
    fs.rename(fresh, place)

