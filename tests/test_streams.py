"""Streams fed in several micro-batches give the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_anchored import limiter_loop, replay_loop
from trafficlens.streaming import queries as streams
from trafficlens.streaming import stateful


def feed(spark, path, rows, schema, parts):
    """Write the rows as several files, in order, and stream them one file per micro-batch."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def timed_rows():
    rng = random.Random(11)
    times = sorted(1_700_000_000 + rng.randrange(4000) for _ in range(400))
    return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}", t, i) for i, t in enumerate(times)]


def test_limiter_stream(spark, tmp_path, timed_rows):
    rows = [(r, k, 2, t) for k, t, r in timed_rows]
    src = feed(spark, str(tmp_path / "in"), rows, "request_id bigint, label string, rpm_limit bigint, created_at bigint", 4)
    got = {r.request_id: r.allowed for r in streams.run_available(stateful.stream_rate_limit(src, 60_000), "t").collect()}
    assert got == limiter_loop([(k, t * 1000, r, 2) for k, t, r in timed_rows], 60_000)


def test_cache_stream(spark, tmp_path, timed_rows):
    rows = [(r, k, t, r % 3 % 2) for k, t, r in timed_rows]
    src = feed(spark, str(tmp_path / "in"), rows, "request_id bigint, request_hash string, created_at bigint, can_fill bigint", 4)
    got = {r.request_id: r.hit for r in streams.run_available(stateful.stream_cache(src, 300), "t").collect()}
    assert got == {k: v[0] for k, v in replay_loop([(h, t, r, f) for r, h, t, f in rows], 300).items()}


def test_memory_stream(spark, tmp_path):
    rows = [("s", i, "user", f"m{i}", 1_700_000_000 + i * 10) for i in range(6)]
    rows.append(("s", 6, "user", "late", 1_700_000_050 + 7201))
    src = feed(spark, str(tmp_path / "in"), rows, "session_id string, turn bigint, role string, content string, created_at bigint", 3)
    got = {r.turn: (r.n_recalled, r.context) for r in streams.run_available(stateful.stream_memory(src, 2), "t").collect()}
    assert [got[i][0] for i in range(7)] == [0, 1, 2, 3, 4, 4, 0]
    assert got[5][1].count("content") == 4 and "m1" in got[5][1] and "m0" not in got[5][1]


def test_transcripts_across_batches(spark, tmp_path):
    lines = ['data: {"message":{"usage":{"input_tokens":7}}}\r\n', 'data: {"usage":{"output_', 'tokens":3}}\n', "data: [DONE]\n"]
    rows = [(1, "anthropic", i, c, int(i == 3), 1_700_000_000 + i) for i, c in enumerate(lines)]
    rows = [rows[0], rows[3], rows[1], rows[2]]  # the end marker overtakes
    src = feed(spark, str(tmp_path / "in"), rows, "request_id bigint, provider string, seq bigint, chunk string, is_last bigint, created_at bigint", 2)
    assert [tuple(r) for r in streams.run_available(streams.stream_usage(src), "t").collect()] == [(1, 7, 3, 1)]


def test_stalled_response_is_a_row(spark, tmp_path):
    t = 1_700_000_000
    rows = [(1, "anthropic", 0, 'data: {"usage":{"input_tokens":4,"output_tokens":2}}\n', 0, t),
            (2, "openai", 0, 'data: {"usage":{"prompt_tokens":5}}\n', 1, t + 10_800),
            (3, "openai", 0, "data: [DONE]\n", 1, t + 10_900)]
    src = feed(spark, str(tmp_path / "in"), rows, "request_id bigint, provider string, seq bigint, chunk string, is_last bigint, created_at bigint", 3)
    got = sorted(tuple(r) for r in streams.run_available(streams.stream_usage(src), "t").collect())
    assert got == [(1, 4, 2, 0), (2, 5, 0, 1), (3, 0, 0, 1)]


def test_unlimited_traffic_keeps_no_state(spark, tmp_path):
    rows = [(i, "u" if i % 2 else None, 0 if i % 2 else None, 1_700_000_000) for i in range(6)]
    src = feed(spark, str(tmp_path / "in"), rows, "request_id bigint, label string, rpm_limit bigint, created_at bigint", 2)
    got = {r.request_id: r.allowed for r in streams.run_available(stateful.stream_rate_limit(src), "t").collect()}
    assert got == {i: 1 for i in range(6)}


LOG = ("created_at bigint, user_label string, input_tokens bigint, output_tokens bigint, from_cache int, duration_ms bigint, "
       "routing_tier string, routing_method string, cost_nano bigint, saved_nano bigint")


def log_rows(times):
    return [(t, "u", 1, 2, 0, 0, "simple", "rule", 500_000_000, 0) for t in times]


def test_daily_counters_over_batches(spark, tmp_path):
    rows = log_rows(86_400 * d + i for d in range(2) for i in range(4))
    src = feed(spark, str(tmp_path / "in"), rows, LOG, 4)  # every day is updated by two batches
    got = streams.run_updates(streams.stream_stats(src), ["day_start", "user_label"]).collect()
    assert sorted((r.day_start, r.total, r.streamed, r.tier_simple, r.m_rule, r.total_input, r.total_output, r.total_cost)
                  for r in got) == [(0, 4, 4, 4, 4, 4, 8, 2.0), (86_400, 4, 4, 4, 4, 4, 8, 2.0)]


def test_rows_of_a_closed_day_change_nothing(spark, tmp_path):
    # The second micro-batch closes the first day, the third evicts it, the fourth brings a row of it.
    rows = log_rows([10, 20, *(86_400 * 2 + i for i in range(4)), 30, 86_400 * 2 + 4])
    src = feed(spark, str(tmp_path / "in"), rows, LOG, 4)
    got = streams.run_updates(streams.stream_stats(src), ["day_start", "user_label"]).collect()
    assert sorted((r.day_start, r.total) for r in got) == [(0, 2), (86_400 * 2, 5)]


def test_usage_rules(spark):
    from trafficlens.functions.usage import sse_usage
    rows = [("anthropic", 'data: {"usage":{"input_tokens":5,"output_tokens":1}}\ndata:{"usage":{"output_tokens":0}}', 5, 1),
            # A message usage without input tokens hides the top-level one.
            ("anthropic", 'data: {"message":{"usage":{"output_tokens":9}},"usage":{"input_tokens":5}}', 0, 0),
            ("openai", 'data: {"usage":{"prompt_tokens":4,"completion_tokens":2}}\ndata: {"usage":{"prompt_tokens":6}}\n data: {"usage":{"prompt_tokens":8}}', 6, 2),
            ("openai", "", 0, 0)]
    df = spark.createDataFrame(rows, "provider string, raw string, i bigint, o bigint")
    assert [(r.input_tokens, r.output_tokens) for r in sse_usage(df).collect()] == [(r[2], r[3]) for r in rows]


def test_chunks_delivered_again_after_the_end_make_no_second_row(spark, tmp_path):
    t = 1_700_000_000
    whole = [(1, "openai", 0, 'data: {"usage":{"prompt_tokens":5}}\n', 0, t), (1, "openai", 1, "data: [DONE]\n", 1, t + 1)]
    other = [(2, "openai", 0, "data: [DONE]\n", 1, t + 600), (3, "openai", 0, "data: [DONE]\n", 1, t + 9000)]
    rows = [whole[0], whole[1], whole[0], whole[1], other[0], whole[0], other[1], other[1]]
    src = feed(spark, str(tmp_path / "in"), rows, "request_id bigint, provider string, seq bigint, chunk string, is_last bigint, created_at bigint", 4)
    got = sorted(tuple(r) for r in streams.run_available(streams.stream_usage(src), "t").collect())
    assert got == [(1, 5, 0, 1), (2, 0, 0, 1), (3, 0, 0, 1)]


def test_a_stalled_response_is_reported_once_even_if_it_goes_on(spark, tmp_path):
    t = 1_700_000_000
    rows = [(1, "openai", 0, 'data: {"usage":{"prompt_tokens":5}}\n', 0, t), (2, "openai", 0, "data: [DONE]\n", 1, t + 7000),
            (3, "openai", 0, "data: [DONE]\n", 1, t + 7300), (1, "openai", 1, "data: [DONE]\n", 1, t + 7301)]
    src = feed(spark, str(tmp_path / "in"), rows, "request_id bigint, provider string, seq bigint, chunk string, is_last bigint, created_at bigint", 4)
    got = sorted(tuple(r) for r in streams.run_available(streams.stream_usage(src, idle_seconds=600), "t").collect())
    assert [g for g in got if g[0] == 1] == [(1, 5, 0, 0)] and len(got) == 3


def state_rows(stream):
    """Groups that the state store holds after a run."""
    query = (stream.writeStream.format("noop").option("checkpointLocation", streams.shared_dir(stream.sparkSession))
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])


def test_many_keys_share_few_groups_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 8, raising=False)
    t = 1_700_000_000
    rows = [(i, f"h{i}", t + i, 1) for i in range(300)]
    src = feed(spark, str(tmp_path / "a"), rows, "request_id bigint, request_hash string, created_at bigint, can_fill bigint", 2)
    assert state_rows(stateful.stream_cache(src, 86_400)) <= 8
    rows = [(i, "openai", k, "data: [DONE]\n", k, t + i) for i in range(300) for k in range(2)]
    src = feed(spark, str(tmp_path / "b"), rows, "request_id bigint, provider string, seq bigint, chunk string, is_last bigint, created_at bigint", 2)
    assert state_rows(stateful.assemble_transcripts(src)) <= 8


def test_null_keys_are_a_response_and_a_hash_of_their_own(spark, tmp_path):
    t = 1_700_000_000
    rows = [(1, None, t, 1), (2, None, t + 1, 1), (3, "h", t + 1, 1), (4, "h", None, 1)]
    src = feed(spark, str(tmp_path / "a"), rows, "request_id bigint, request_hash string, created_at bigint, can_fill bigint", 1)
    got = {r.request_id: r.hit for r in streams.run_available(stateful.stream_cache(src, 300), "t").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}
    rows = [(None, "openai", 0, 'data: {"usage":{"prompt_tokens":5}}\n', 1, t), (2**60 + 1, "openai", 0, "data: [DONE]\n", 1, t)]
    src = feed(spark, str(tmp_path / "b"), rows, "request_id bigint, provider string, seq bigint, chunk string, is_last bigint, created_at bigint", 1)
    got = {r.request_id: tuple(r)[1:] for r in streams.run_available(streams.stream_usage(src), "t").collect()}
    assert got == {None: (5, 0, 1), 2**60 + 1: (0, 0, 1)}


def test_governed_stream_carries_no_texts(spark, tmp_path):
    """Texts stay where they are stored: the stream meets their verdicts, and gives what it gives with its own texts."""
    rows = [(1, "b", "openai", 1, 1_700_000_000), (2, "b", "openai", 2, 1_700_000_001), (3, "b", "openai", 9, 1_700_000_002)]
    src = feed(spark, str(tmp_path / "in"), rows, "request_id bigint, bearer string, provider string, prompt_id bigint, created_at bigint", 2)
    prompts = spark.createDataFrame([(1, "My SSN is 123-45-6789."), (2, None)], "prompt_id bigint, prompt string")
    tokens = spark.createDataFrame([("b", "u", 0, None, "p", 0)], "token string, label string, rpm_limit bigint, allowed_models_csv string, policy_name string, revoked int")
    stored = spark.createDataFrame([("p", ["ssn"], "block", True, 0.5, ["groq"], None, None, False, 1)],
                                   "name string, detect array<string>, dlp_action string, guard_enabled boolean, block_threshold double, allowed_providers array<string>, "
                                   "system_prepend string, system_append string, redact_output boolean, retention_days bigint")
    config = stored.limit(0)
    out = streams.stream_govern(src, tokens, stored, config, prompts=prompts)
    narrow = streams.run_available(out.select("request_id", "outcome", "events"), "t").collect()
    own = streams.stream_govern(src.join(prompts, "prompt_id", "left"), tokens, stored, config)
    assert sorted(narrow) == sorted(streams.run_available(own.select("request_id", "outcome", "events"), "t").collect())
    assert {r.request_id: r.outcome for r in narrow} == {1: "dlp_blocked", 2: "provider_blocked", 3: "provider_blocked"}
    assert "prompt" not in out.columns
