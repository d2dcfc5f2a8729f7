"""Memory, compression and reports on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from trafficlens.functions.scalars import period_bounds
from trafficlens.operators import stats, turns
from trafficlens.plans import hooks
from trafficlens.sources import archive

TURN = "conv_id bigint, turn bigint, role string, text string"
MEMORY = "session_id string, turn bigint, role string, content string, created_at bigint"


def test_memory(spark):
    rows = [("a", i, "user" if i % 2 == 0 else "assistant", f"m{i}", 100 + i // 2) for i in range(6)] + [("b", 0, "user", "x", 5)]
    memory = spark.createDataFrame(rows, MEMORY)
    got = [(r.session_id, r.pos, r.content) for r in turns.memory_recall(memory, 1).orderBy("session_id", "pos").collect()]
    assert got == [("a", 1, "m4"), ("a", 2, "m5"), ("b", 1, "x")]
    asked = spark.createDataFrame([(1, "a", [("user", "m5")]), (2, "none", [("user", "q")]), (3, "b", None)],
                                  "request_id int, session_id string, messages array<struct<role: string, content: string>>")
    out = {r.request_id: r.messages and [m.content for m in r.messages]
           for r in turns.memory_inject(asked, turns.memory_recall(memory, 1)).collect()}
    assert out[1] == ["m4", "m5", "m5"] and out[2] == ["q"]
    # One old turn removes the whole session; the cutoff itself is not old.
    assert {r.session_id for r in turns.session_purge(memory, 100).collect()} == {"a"}
    assert turns.session_purge(memory, 101).count() == 0


def test_memory_as_of_the_request(spark):
    rows = [("a", i, "user", f"m{i}", 100 + i) for i in range(6)] + [("a", 5, "user", "m5b", 105), ("b", 0, "user", "x", 90_000)]
    memory = spark.createDataFrame(rows, MEMORY)
    asked = [(1, "a", 100), (2, "a", 101), (3, "a", 104), (4, "a", 200_000), (5, "b", 90_000), (6, "b", 90_001),
             (7, None, 200_000), (8, "none", 200_000), (9, "a", None)]
    df = spark.createDataFrame([(*r, [("user", "q")]) for r in asked], "request_id int, session_id string, "
                               "created_at bigint, messages array<struct<role: string, content: string>>")
    got = {r.request_id: [m.content for m in r.messages] for r in turns.memory_inject_asof(df, memory, 1).collect()}
    assert got == {1: ["q"], 2: ["m0", "q"], 3: ["m2", "m3", "q"], 4: ["m5", "m5b", "q"], 5: ["q"], 6: ["x", "q"],
                   7: ["q"], 8: ["q"], 9: ["q"]}


def test_compression_limits(spark):
    rows = [(1, i, "user", "x" * 40) for i in range(5)] + [(2, i, "user", "x" * 400) for i in range(4)] + [(3, i, "user", "é") for i in range(9)]
    df = spark.createDataFrame(rows, TURN)
    plan = {r.conv_id: tuple(r)[1:] for r in turns.compress_plan(df, 50, 2).collect()}
    # 5 messages of 68 characters, 4 commas and 2 brackets: 346 characters.
    assert plan[1] == (87, 1, 1, 4)
    assert plan[2][1:] == (0, 0, 4)
    out = turns.compress_apply(df, 50, 2).filter("conv_id = 1").orderBy("pos").collect()
    assert [(r.pos, r.role) for r in out] == [(0, "user"), (1, "assistant"), (2, "user"), (3, "user"), (4, "user"), (5, "user")]
    assert out[0].text.startswith("[Previous conversation summary]\n1 messages")
    assert turns.compress_apply(df, 88, 2).filter("conv_id = 1").count() == 5

    def broken(heads):
        raise RuntimeError("no model")
    same = turns.compress_apply(df, 50, 2, lambda head: hooks.summarise(head, broken))
    assert same.filter("conv_id = 1").count() == 5 and same.count() == df.count()


def test_flaky_summariser_runs_once_per_head(spark):
    rows = [(c, i, "user", f"m{c}-{i} " + "x" * 60) for c in range(30) for i in range(9)]
    df = spark.createDataFrame(rows, TURN)
    calls = spark.sparkContext.accumulator(0)

    def flaky(heads):
        if any('"m7-' in h for h in heads):
            raise RuntimeError("bad text")
        calls.add(len(heads))
        return ["short"] * len(heads)
    out = turns.compress_apply(df, 50, 2, lambda head: hooks.summarise(head, flaky))
    sizes = {r.conv_id: r["count"] for r in out.groupBy("conv_id").count().collect()}
    assert sizes == {c: 9 if c == 7 else 6 for c in range(30)}
    assert out.filter("conv_id = 7 AND text LIKE '[Previous%'").count() == 0
    assert calls.value == 29


LOG = ("request_id bigint, created_at bigint, user_label string, original_model string, routed_model string, routing_method string, "
       "routing_tier string, input_tokens bigint, output_tokens bigint, from_cache bigint, duration_ms bigint, cost_nano bigint, saved_nano bigint")
AS_OF = 1_706_616_000


def log(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LOG)


def row(at, user, cost, saved, tier="simple", method="rule", hit=0, ms=5, src="a", dst="b"):
    return (at, user, src, dst, method, tier, 1, 2, hit, ms, cost, saved)


def test_empty_period(spark):
    got = stats.period_stats(log(spark, row(0, "u", 1, 1)), AS_OF, "today").first()
    assert (got.total, got.actual_usd, got.savings_pct, got.from_ts) == (0.0, 0.0, 0.0, AS_OF - AS_OF % 86400)
    assert stats.cache_stats(log(spark, row(0, "u", 1, 1)).limit(0)).first().hit_rate == 0.0


def test_rounding_and_bounds(spark):
    rows = [row(AS_OF, "u", 1_005_000_000, 2_015_000_000), row(AS_OF - AS_OF % 86400, "v", 0, 0, tier="complex", method="cache", hit=1, ms=0),
            row(AS_OF - AS_OF % 86400 - 1, "v", 500_000_000, 0), row(AS_OF + 1, "u", 9, 9)]
    today = stats.period_stats(log(spark, *rows), AS_OF, "today").first()
    assert (today.total, today.cached, today.streamed, today.m_cache, today.tier_complex) == (2.0, 1.0, 1.0, 1.0, 1.0)
    # Half a cent on the binary double: 1.005 rounds down, and the parts below use the rounded values.
    assert (today.actual_usd, today.saved_usd, today.would_have_cost_usd) == (1.0, 2.02, 3.02)
    assert today.savings_pct == 66.9
    assert stats.period_stats(log(spark, *rows), AS_OF, "weekly", "v").first().total == 2.0


def test_cube_agrees_with_single_reports(spark):
    rows = [row(AS_OF - d * 43_200, f"u{d % 3}", d * 7_000_000, d * 3_000_000, tier=["simple", "standard", "complex"][d % 3]) for d in range(70)]
    df = log(spark, *rows)
    cube = {(r.period, r.user_label): r.asDict() for r in stats.stats_cube(df, AS_OF).collect()}
    for period in period_bounds(AS_OF):
        for user in (None, "u1"):
            want = stats.period_stats(df, AS_OF, period, user).first().asDict()
            assert {k: cube[period, user][k] for k in stats.REPORT_COLUMNS} == {k: want[k] for k in stats.REPORT_COLUMNS}
        got = cube[period, None]
        if period != "daily_avg":
            assert got["tier_simple"] + got["tier_standard"] + got["tier_complex"] == got["total"]


def test_switches_and_limits(spark):
    rows = [row(AS_OF, "u", 0, 0, dst=d) for d in ["b"] * 31 + ["c"] * 16 + ["a"] * 3 + [""]]
    df = log(spark, *rows)
    assert [tuple(r) for r in stats.routing_switches(df, AS_OF, "monthly").collect()] == [("a", "b", 31), ("a", "c", 16)]
    assert [tuple(r) for r in stats.routing_switches(df, AS_OF, "daily_avg").collect()] == [("a", "b", 1), ("a", "c", 1)]
    assert [tuple(r) for r in stats.top_models(df, AS_OF, "monthly", 2).collect()] == [("b", 31), ("c", 16)]
    events = spark.range(300).select(F.col("id"), F.lit(1).alias("created_at"), F.lit("u").alias("user_label"), F.lit("x").alias("action"), F.lit("p").alias("policy_name"), F.lit("{}").alias("detail"))
    assert stats.recent_events(events, 500).count() == 200 and stats.recent_events(events).first().id == 299
    with pytest.raises(ValueError):
        stats.recent_events(events, -1)


def test_purges(spark):
    df = log(spark, row(AS_OF - 86_400, "u", 0, 0), row(AS_OF - 86_401, "v", 0, 0))
    assert stats.purge_logs(df, AS_OF, 1).count() == 1 and stats.purge_logs(df, AS_OF, 0).count() == 2
    tokens = spark.createDataFrame([("u", "keep"), ("v", "day")], "label string, policy_name string")
    policies = spark.createDataFrame([("keep", 0), ("day", 1)], "name string, retention_days bigint")
    assert [r.user_label for r in stats.purge_by_policy(df, tokens, policies, AS_OF).collect()] == ["u"]


def test_steps_run_in_priority_order(spark):
    df = spark.range(3).withColumn("trail", F.lit(""))
    add = lambda c: lambda d: d.withColumn("trail", F.concat("trail", F.lit(c)))
    stop = lambda d: d.withColumn("short_circuit", F.when(F.col("id") == 1, "answered"))
    out = {r.id: (r.trail, r.short_circuit) for r in hooks.run_steps(df, [(60, add("z")), (None, add("m")), (20, stop), (10, add("a"))]).collect()}
    assert out == {0: ("amz", None), 1: ("a", "answered"), 2: ("amz", None)}


def test_failing_classifier_is_standard(spark):
    df = spark.createDataFrame([("x",)], "t string")

    def broken(texts):
        raise RuntimeError("down")
    assert hooks.classify(df, "t", broken).first().classified == "standard"


def test_one_bad_text_costs_one_text(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else "text") for i in range(8)], "i int, t string").coalesce(1)

    def fails(texts):
        if "bad" in list(texts):
            raise RuntimeError("bad")
        return ["complex"] * len(texts)
    got = {r.i: r.classified for r in hooks.classify(df, "t", fails).collect()}
    assert got == {i: "standard" if i == 3 else "complex" for i in range(8)}

    def vectors(texts):
        if "bad" in texts:
            raise RuntimeError("bad")
        return [[3.0, 4.0]] * len(texts)
    got = {r.i: r.embedding for r in hooks.embed(df, "t", vectors).collect()}
    assert got[3] is None and [round(x, 6) for x in got[0]] == [0.6, 0.8]


def test_written_log_prunes_days(spark, tmp_path):
    df = log(spark, row(AS_OF, "u", 5, 6), row(AS_OF - 3 * 86_400, "u", 5, 6)).withColumn("provider", F.lit("p")) \
        .withColumn("cost_usd", F.lit(0.0)).withColumn("saved_usd", F.lit(0.0))
    archive.write_request_log(archive.log_row(df), str(tmp_path / "log"))
    back = archive.read_request_log(spark, str(tmp_path / "log"))
    plan = stats.purge_logs(back, AS_OF, 1)._jdf.queryExecution().executedPlan().toString()
    assert "dt" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert back.count() == 2 and len(back.columns) == 19
    plan = stats.period_stats(back.withColumn("cost_nano", F.lit(0)).withColumn("saved_nano", F.lit(0)), AS_OF, "today")
    assert plan.first().total == 1.0
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in text
