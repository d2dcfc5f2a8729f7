"""Stored tables: changes give what the operators give, and leave the files of other folders alone."""

import os

from pyspark.sql import functions as F

from trafficlens.operators import cache, identity, stats
from trafficlens.sources import archive, tables

TOKENS = ("label string, token string, upstream_key string, allowed_models_csv string, rpm_limit bigint, revoked bigint, "
          "created_at bigint, policy_name string")
DAY = 86_400


def files(path, column):
    """Data files of each folder, from the disk."""
    return {d.split("=")[1]: sorted(f for f in os.listdir(f"{path}/{d}") if f[0] not in "._")
            for d in os.listdir(path) if d.startswith(f"{column}=")}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_of_few_keys_rewrites_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "tokens")
    tokens = spark.range(10_000).selectExpr(
        "concat('u', id) label", "concat('t', id) token", "cast(null as string) upstream_key", "cast(null as string) allowed_models_csv",
        "id % 7 rpm_limit", "id % 2 revoked", "id created_at", "'p' policy_name")
    changes = spark.range(9_990, 10_090).selectExpr(
        "concat('u', id) label", "concat('n', id) token", "'k' upstream_key", "cast(null as string) allowed_models_csv", "5L rpm_limit",
        "cast(null as string) policy_name", "id changed_at")
    tables.write_buckets(tokens, path, "label")
    before, want = files(path, "bucket"), rows_of(identity.dim_upsert(tokens, changes).select(*tokens.columns))
    touched = tables.upsert_buckets(spark, path, tokens.schema, "label", changes, identity.dim_upsert)
    after = files(path, "bucket")
    assert rows_of(tables.read_buckets(spark, path, tokens.schema).select(*tokens.columns)) == want
    assert 0 < len(touched) <= 100 < len(before) == tables.BUCKETS
    assert {b for b in before if before[b] != after[b]} == set(map(str, touched))
    # the same change again, and none at all
    assert tables.upsert_buckets(spark, path, tokens.schema, "label", changes, identity.dim_upsert) == touched
    assert tables.upsert_buckets(spark, path, tokens.schema, "label", changes.limit(0), identity.dim_upsert) == []
    assert rows_of(tables.read_buckets(spark, path, tokens.schema).select(*tokens.columns)) == want


def test_cache_upsert_of_a_hash_with_many_versions(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "id bigint, request_hash string, created_at bigint, expires_at bigint"
    old = spark.createDataFrame([(i, f"h{i % 50}" if i % 9 else None, i, None if i % 3 else i + 9) for i in range(400)], schema)
    new = spark.createDataFrame([(1000 + i, f"h{i % 3}", 500 + i % 2, None) for i in range(9)] + [(2000, None, 7, None)], schema)
    tables.write_buckets(old, path, "request_hash", 32)
    tables.upsert_buckets(spark, path, old.schema, "request_hash", new.drop("expires_at"), lambda a, b: cache.cache_upsert(a, b, 10), 32)
    whole = cache.cache_upsert(old, new.drop("expires_at"), 10)
    touched = [r[0] for r in new.select(tables.bucket_of(F.col("request_hash"), 32)).distinct().collect()]
    at = tables.bucket_of(F.col("request_hash"), 32)
    got = tables.read_buckets(spark, path, old.schema)
    assert rows_of(got.filter(at.isin(touched))) == rows_of(whole.filter(at.isin(touched)))
    assert rows_of(got.filter(~at.isin(touched))) == rows_of(old.filter(~at.isin(touched)))


def test_a_bucket_that_loses_all_rows_is_dropped(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(f"n{i}", i) for i in range(20)], "name string, x bigint")
    tables.write_buckets(df, path, "name", 64)
    before = files(path, "bucket")
    tables.delete_buckets(spark, path, df.schema, "name", F.col("x") < 15, 64)
    after = files(path, "bucket")
    assert rows_of(tables.read_buckets(spark, path, df.schema)) == sorted(((f"n{i}", i) for i in range(15, 20)), key=str)
    assert len(after) < len(before) and all(after[b] == before[b] or b in after for b in after)
    tables.delete_buckets(spark, path, df.schema, "name", F.lit(True), 64)
    assert files(path, "bucket") == {} and tables.read_buckets(spark, path, df.schema).count() == 0


def log_of(spark, days, users):
    rows = [(d * 1000 + u, d * DAY + 3600 * u, f"u{u}") for d in range(days) for u in range(users)]
    return spark.createDataFrame(rows, "request_id bigint, created_at bigint, user_label string")


def test_purged_days_go_whole_and_one_is_rewritten(spark, tmp_path):
    path, log = str(tmp_path / "log"), log_of(spark, 10, 6)
    archive.write_request_log(log, path)
    before = files(path, "dt")
    as_of = 9 * DAY + 2 * 3600
    told = tables.purge_log_folders(spark, path, log.schema, as_of, 4)
    after = files(path, "dt")
    assert told["dropped"] == [f"1970-01-0{d}" for d in range(1, 6)] and told["rewritten"] == ["1970-01-06"]
    assert all(after[d] == before[d] for d in told["kept"]) and len(told["kept"]) == 4
    assert after["1970-01-06"] != before["1970-01-06"]
    assert rows_of(spark.read.schema(log.schema).parquet(path).select(*log.columns)) == rows_of(stats.purge_logs(log, as_of, 4))
    again = tables.purge_log_folders(spark, path, log.schema, as_of, 4)
    assert again["dropped"] == again["rewritten"] == [] and files(path, "dt") == after
    assert tables.purge_log_folders(spark, path, log.schema, as_of, 0)["kept"] == sorted(after)


def test_purge_by_policy_reads_only_days_with_rows_due(spark, tmp_path):
    path, log = str(tmp_path / "log"), log_of(spark, 12, 4)
    archive.write_request_log(log, path)
    tokens = spark.createDataFrame([("u0", "short"), ("u1", "long"), ("u2", "free"), ("u9", "short")], "label string, policy_name string")
    policies = spark.createDataFrame([("short", 2), ("long", 6), ("free", 0)], "name string, retention_days bigint")
    purge = lambda as_of, p=policies: tables.purge_policy_folders(spark, path, log.schema, tokens, p, as_of)
    want = lambda as_of, p=policies: rows_of(stats.purge_by_policy(log, tokens, p, as_of))
    held = lambda: rows_of(spark.read.schema(log.schema).parquet(path).select(*log.columns))

    before, as_of = files(path, "dt"), 11 * DAY
    told = purge(as_of)
    assert held() == want(as_of)
    assert told["kept"] == ["1970-01-11", "1970-01-12"]  # younger than the least retention
    assert all(files(path, "dt")[d] == before[d] for d in told["kept"])
    # nothing is due: only the one day that still might be is read again, none is rewritten
    before, told = files(path, "dt"), purge(as_of)
    assert told["rewritten"] == told["dropped"] == told["counted"] == [] and files(path, "dt") == before
    # a day later: one day loses short rows, one loses long rows, one has come into reach
    told = purge(as_of + DAY)
    assert held() == want(as_of + DAY) and told["rewritten"] == ["1970-01-06", "1970-01-10"]
    # late rows of an old day are found, and other retentions are judged anew
    archive.write_request_log(log.filter("request_id = 0"), path)
    assert purge(as_of + DAY)["rewritten"] == ["1970-01-01"] and held() == want(as_of + DAY)
    other = spark.createDataFrame([("short", 2), ("long", 3), ("free", 1)], "name string, retention_days bigint")
    purge(as_of + DAY, other)
    assert held() == want(as_of + DAY, other)
    # where nobody is unlimited, whole days go
    every = spark.createDataFrame([(f"u{u}", "short") for u in range(4)], "label string, policy_name string")
    told = tables.purge_policy_folders(spark, path, log.schema, every, policies, as_of + DAY)
    both = set(want(as_of + DAY, other)) & set(rows_of(stats.purge_by_policy(log, every, policies, as_of + DAY)))
    assert len(told["dropped"]) == 10 and set(held()) == both


def test_maintenance_follows_the_clock_of_a_stream(spark, tmp_path):
    from tests.test_streams import feed
    from trafficlens.streaming import queries as streams
    path, log, seen = str(tmp_path / "log"), log_of(spark, 10, 3), []
    archive.write_request_log(log, path)

    def purge(now):
        seen.append(now)
        tables.purge_log_folders(spark, path, log.schema, now, 3)

    clock = feed(spark, str(tmp_path / "in"), [(d * DAY,) for d in range(4, 10)], "created_at bigint", 3)
    streams.run_maintenance(clock, purge)
    assert len(seen) == 3 and max(seen) == 9 * DAY
    assert rows_of(spark.read.schema(log.schema).parquet(path).select(*log.columns)) == rows_of(stats.purge_logs(log, 9 * DAY, 3))


def test_daily_sums_read_only_new_files_and_give_the_same_report(spark, tmp_path):
    import random

    from trafficlens.operators.routing import price_request
    rng = random.Random(4)
    columns = ("request_id bigint, created_at bigint, user_label string, original_model string, routed_model string, "
               "routing_method string, routing_tier string, input_tokens bigint, output_tokens bigint, from_cache int, duration_ms bigint")

    def rows(n, days):
        return [(rng.randrange(10**9), DAY * rng.choice(days) + rng.randrange(DAY), f"u{rng.randrange(4)}", "gpt-4o", rng.choice(["gpt-4o", "gpt-4o-mini"]),
                 rng.choice(["rule", "default", "cache"]), rng.choice(["simple", "complex"]), rng.randrange(900), rng.randrange(900),
                 rng.randrange(2), rng.randrange(3)) for _ in range(n)]

    path, daily = str(tmp_path / "log"), str(tmp_path / "daily")
    schema = spark.createDataFrame([], columns).schema
    seen = []

    def priced(df):
        seen.append(sorted({f.split("dt=")[1][:10] for f in df.inputFiles()}))
        return price_request(df)

    def update(new, days):
        archive.write_request_log(spark.createDataFrame(rows(new, days), columns), path)
        seen.clear()
        return tables.update_daily(spark, path, schema, daily, priced)

    def check(as_of):
        log = price_request(tables.read_log(spark, path, schema))
        got = rows_of(stats.stats_cube_daily(tables.read_daily(spark, daily), log, as_of))
        assert got == rows_of(stats.stats_cube(log, as_of)) and got

    update(300, range(100, 141))
    check(140 * DAY + 5000)
    told = update(40, [141])
    assert told["added"] == ["1970-05-22"] and seen == [["1970-05-22"]]
    check(141 * DAY + 70_000)
    assert update(30, [103, 120])["added"] == ["1970-04-14", "1970-05-01"]  # late rows
    check(141 * DAY)
    assert tables.update_daily(spark, path, schema, daily, priced) == {"added": [], "redone": [], "dropped": [], "merged": []}
    # a purge drops days and rewrites one
    tables.purge_log_folders(spark, path, schema, 141 * DAY + 3600 * 12, 28)
    told = tables.update_daily(spark, path, schema, daily, priced)
    assert told["redone"] == ["1970-04-24"] and len(told["dropped"]) == 13 and told["added"] == []
    check(141 * DAY + 70_000)
    # many small updates of one day are merged
    told = [update(5, [141]) for _ in range(9)]
    assert any(t["merged"] == ["1970-05-22"] for t in told)
    check(142 * DAY + 9)
    # an update that was broken off, and a lost ledger
    ledger = tables._ledger(spark, daily, tables._SUMMED)
    tables._note(spark, daily, {**ledger, "1970-05-22": {"files": [], "open": True}}, tables._SUMMED)
    assert tables.update_daily(spark, path, schema, daily, priced)["redone"] == ["1970-05-22"]
    check(142 * DAY + 9)
    os.remove(f"{daily}/{tables._SUMMED}")
    tables.update_daily(spark, path, schema, daily, priced)
    check(142 * DAY + 9)
