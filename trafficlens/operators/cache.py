"""Exact response cache: keys, lookups as of a time, replay of a log, and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchored import anchored_windows, assign_windows

NEVER = (1 << 63) - 1


def request_hash(provider: Column, model: Column, messages: Column, system: Column | None = None) -> Column:
    """SHA-256 of {provider, model, messages, system}; an absent system is left out, sampling options are no part."""
    fields = [provider.alias("provider"), F.coalesce(model, F.lit("unknown")).alias("model"),
              messages.alias("messages")]
    if system is not None:
        fields.append(system.alias("system"))
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def request_hash_of(provider: Column, model: Column, messages: Column, system: Column | None = None) -> Column:
    """:func:`request_hash` of messages that are given one by one, each as its JSON text."""
    head = F.to_json(F.struct(provider.alias("provider"), F.coalesce(model, F.lit("unknown")).alias("model")))
    tail = F.lit("") if system is None else F.coalesce(F.concat(F.lit(',"system":'), F.to_json(system)), F.lit(""))
    return F.sha2(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"messages":['),
                           F.concat_ws(",", messages), F.lit("]"), tail, F.lit("}")), 256)


def live(expires_at: Column, now: Column | int) -> Column:
    """Serves while ``expires_at`` is absent or later than now."""
    now = now if isinstance(now, Column) else F.lit(now)
    return expires_at.isNull() | (expires_at > now)


def cache_live(entries: DataFrame, now: int) -> DataFrame:
    return entries.filter(live(F.col("expires_at"), now))


def running_max(requests: DataFrame, points: DataFrame, key: str, ts: str, chunk_seconds: int = 86_400) -> DataFrame:
    """Distinct (key, ts) of the requests with ``best`` = greatest ``value`` of the points up to that time.

    Both sides are reduced to one row per key and second first. Days are then independent: each starts from the
    running maximum of the days before it, which is computed on one row per key and day.
    """
    day = F.floor(F.col("t") / F.lit(chunk_seconds)).cast("bigint")
    probes = requests.select(F.col(key).alias("key"), F.col(ts).alias("t")).distinct().withColumn("day", day)
    values = points.withColumn("day", day)
    kind = values.schema["value"].dataType
    daily = (values.groupBy("key", "day").agg(F.max("value").alias("value"))
             .unionByName(probes.select("key", "day").distinct().withColumn("value", F.lit(None).cast(kind)))
             .groupBy("key", "day").agg(F.max("value").alias("value")))
    earlier = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.select("key", "day", F.max("value").over(earlier).alias("value"))
    line = (values.select("key", "day", "t", F.lit(1).alias("kind"), "value")
            .unionByName(carried.select("key", "day", (F.col("day") * chunk_seconds).alias("t"),
                                        F.lit(0).alias("kind"), "value").filter(F.col("value").isNotNull()))
            .unionByName(probes.select("key", "day", "t", F.lit(2).alias("kind"),
                                       F.lit(None).cast(kind).alias("value"))))
    upto = Window.partitionBy("key", "day").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (line.withColumn("best", F.max("value").over(upto)).filter(F.col("kind") == 2)
            .select(F.col("key").alias("_key"), F.col("t").alias("_t"), "best"))


def _served(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct (hash, second) of the requests at which some entry version is stored and unexpired."""
    points = (entries.groupBy(F.col("request_hash").alias("key"), F.col("created_at").alias("t"))
              .agg(F.max(F.coalesce("expires_at", F.lit(NEVER))).alias("value")))
    best = running_max(requests, points, "request_hash", "created_at")
    return best.filter(F.col("best") > F.col("_t"))


def cache_hits(requests: DataFrame, entries: DataFrame) -> DataFrame:
    s = _served(requests, entries)
    return requests.join(s, (requests["request_hash"] == s["_key"]) & (requests["created_at"] == s["_t"]), "left_semi")


def cache_misses(requests: DataFrame, entries: DataFrame) -> DataFrame:
    s = _served(requests, entries)
    return requests.join(s, (requests["request_hash"] == s["_key"]) & (requests["created_at"] == s["_t"]), "left_anti")


def cache_asof(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests with ``entry_id``: the version in place at their time (latest write, then highest id), if live."""
    points = (entries.groupBy(F.col("request_hash").alias("key"), F.col("created_at").alias("t"))
              .agg(F.max("id").alias("id"), F.max_by("expires_at", "id").alias("expires_at"))
              .select("key", "t", F.struct("t", "id", "expires_at").alias("value")))
    best = running_max(requests, points, "request_hash", "created_at")
    served = best.filter(live(F.col("best.expires_at"), F.col("_t")) & F.col("best").isNotNull()) \
        .select("_key", "_t", F.col("best.id").alias("entry_id"))
    return requests.join(served, (requests["request_hash"] == served["_key"])
                         & (requests["created_at"] == served["_t"])).drop("_key", "_t")


def cache_replay(requests: DataFrame, ttl: int, key: str = "request_hash", ts: str = "created_at",
                 row_id: str = "request_id", can_fill: str | None = None,
                 payload: tuple[str, ...] = ()) -> DataFrame:
    """Add ``hit`` (1/0) and, for hits, ``source_id`` (the request whose response is served) to every request.

    A miss stores its response, which serves until ``created_at + ttl`` and is not refreshed by hits; ``ttl=0`` never
    runs out. Rows whose ``can_fill`` column is 0 (streamed, failed) may be served but store nothing. Columns named in
    ``payload`` are taken from the serving request and returned as ``source_<name>``.
    """
    width = None if ttl == 0 else ttl - 1
    fillers = requests if can_fill is None else requests.filter(F.col(can_fill) == 1)
    windows = anchored_windows(fillers, key, ts, row_id, width)
    if payload:
        source = fillers.select(F.col(row_id).alias("first_id"), *payload)
        windows = windows.join(source, "first_id")
    placed = assign_windows(requests, windows, key, ts, row_id, width, payload)
    hit = F.col("win").isNotNull() & (F.col("win.first_id") != F.col(row_id))
    out = placed.withColumn("hit", hit.cast("bigint")).withColumn("source_id", F.when(hit, F.col("win.first_id")))
    for name in payload:
        out = out.withColumn(f"source_{name}", F.when(hit, F.col(f"win.{name}")))
    return out.drop("win")


def cache_upsert(entries: DataFrame, written: DataFrame, ttl: int) -> DataFrame:
    """Cache table after storing ``written`` responses: one row per hash, the latest write wins (then highest id)."""
    expires = F.when(F.lit(ttl) > 0, F.col("created_at") + F.lit(ttl))
    fresh = written.withColumn("expires_at", expires.cast("bigint"))
    both = entries.unionByName(fresh, allowMissingColumns=True)
    # rank = 1 is a group limit: all but one row per hash are dropped before the shuffle.
    newest = F.row_number().over(Window.partitionBy("request_hash").orderBy(F.desc("created_at"), F.desc("id")))
    return both.withColumn("_n", newest).filter("_n = 1").drop("_n")


def purge_cache(entries: DataFrame, now: int) -> DataFrame:
    """Entries kept by the expiry purge; one that expires exactly now is kept, though it no longer serves."""
    return entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now)))
