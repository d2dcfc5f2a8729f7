"""Limiter and cache replay against a plain loop, with hot keys, ties and windows that cross chunk borders."""

import random

import pytest
from pyspark.sql import functions as F

from trafficlens.operators.anchored import anchored_windows
from trafficlens.operators.cache import cache_asof, cache_hits, cache_misses, cache_replay, cache_upsert, purge_cache
from trafficlens.operators.limiter import rate_limit


def limiter_loop(rows, width):
    state, out = {}, {}
    for label, ts, rid, limit in sorted(rows, key=lambda r: (r[1], r[2])):
        if limit == 0:
            out[rid] = 1
            continue
        start, count = state.get(label, (ts, 0))
        if ts - start > width:
            start, count = ts, 0
        state[label] = (start, count + 1)
        out[rid] = int(count + 1 <= limit)
    return out


def replay_loop(rows, ttl):
    stored, out = {}, {}
    for key, ts, rid, fills in sorted(rows, key=lambda r: (r[1], r[2])):
        entry = stored.get(key)
        if entry is not None and (ttl == 0 or entry[0] + ttl > ts):
            out[rid] = (1, entry[1])
        else:
            out[rid] = (0, None)
            if fills:
                stored[key] = (ts, rid)
    return out


def skewed_times(rng, n, horizon):
    """A third of the rows on one key; dense and sparse stretches, many ties."""
    rows = []
    for rid in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        ts = rng.randrange(horizon) if rng.random() < 0.5 else rng.randrange(horizon // 10)
        rows.append((key, ts - horizon // 20, rid))
    return rows


@pytest.mark.parametrize("width,horizon,seed", [(50, 4000, 1), (7, 4000, 2), (1, 300, 3), (900, 4000, 4)])
def test_limiter_equals_loop(spark, width, horizon, seed):
    rng = random.Random(seed)
    rows = [(k, t, r, 0 if k == "k1" else 2) for k, t, r in skewed_times(rng, 3000, horizon)]
    df = spark.createDataFrame(rows, "label string, ts_ms bigint, request_id bigint, rpm_limit bigint")
    got = {r.request_id: r.allowed for r in rate_limit(df, width).collect()}
    assert got == limiter_loop(rows, width)


@pytest.mark.parametrize("ttl,horizon,seed", [(60, 4000, 5), (1, 200, 6), (0, 500, 7), (3000, 4000, 8)])
def test_replay_equals_loop(spark, ttl, horizon, seed):
    rng = random.Random(seed)
    rows = [(k, t, r, int(rng.random() < 0.6)) for k, t, r in skewed_times(rng, 3000, horizon)]
    df = spark.createDataFrame(rows, "request_hash string, created_at bigint, request_id bigint, can_fill bigint")
    got = {r.request_id: (r.hit, r.source_id) for r in cache_replay(df, ttl, can_fill="can_fill").collect()}
    assert got == replay_loop(rows, ttl)


def test_dense_key_keeps_every_phase(spark):
    """One event per time unit: windows never fall into step, so chunk summaries stay at their largest."""
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.col("id").alias("i"))
    starts = [r.start for r in anchored_windows(df, "k", "t", "i", 9, span=64).orderBy("start").collect()]
    assert starts == list(range(0, 5000, 10))


@pytest.mark.parametrize("block", [1, 2, 3])
@pytest.mark.parametrize("width,horizon,seed", [(50, 9000, 21), (7, 4000, 22), (900, 40_000, 23)])
def test_blocks_of_chunks_thread_the_same_state(spark, monkeypatch, block, width, horizon, seed):
    from trafficlens.operators import anchored
    monkeypatch.setattr(anchored, "BLOCK", block)
    monkeypatch.setattr(anchored, "SPAN_FACTOR", 2)
    rng = random.Random(seed)
    rows = [(k, t, r, 2) for k, t, r in skewed_times(rng, 2000, horizon)]
    df = spark.createDataFrame(rows, "label string, ts_ms bigint, request_id bigint, rpm_limit bigint")
    got = {r.request_id: r.allowed for r in rate_limit(df, width).collect()}
    assert got == limiter_loop(rows, width)


def test_one_key_with_a_million_times_meets_no_task_whole(spark):
    """Largest groups that any one task of the limiter and the window scan handles, for a key that has all rows."""
    from trafficlens.operators import anchored, limiter
    width, span = 999, 16 * 1000
    events = spark.range(1_000_000).select(F.lit("a").alias("key"), (F.col("id") * 7 + F.pmod(F.hash("id"), F.lit(5))).alias("t"),
                                           F.col("id").alias("rid"))
    points = events.withColumn("chunk", F.floor(F.col("t") / span).cast("bigint"))
    blocked = anchored._blocked(points, width, span)
    most = lambda df, *by: df.groupBy(*by).count().agg(F.max("count")).first()[0]
    assert most(points, "key", "chunk") < 2400
    assert most(blocked, "key", "block") < 256 * 200
    assert anchored._composed(blocked, width).count() < 4000  # all that the scan of the whole key reads
    windows = anchored_windows(points, "key", "t", "rid", width).orderBy("start")
    starts = [r.start for r in windows.collect()]
    times, want = [r.t for r in events.orderBy("t").collect()], []
    for t in times:
        if not want or t - want[-1] > width:
            want.append(t)
    assert starts == want
    # one window that holds them all: its sum is made of parts
    whole = events.select(F.col("key").alias("_label"), F.col("t").alias("_ts"), F.lit(0).cast("bigint").alias("_start"),
                          F.lit(1).alias("_n"))
    summed = limiter._sums_before(whole, 7_000_100)
    assert most(whole.withColumn("p", F.floor(F.col("_ts") * limiter.PARTS / 7_000_101)), "p") < 4000
    assert summed.agg(F.max("_before"), F.count("_before"), F.sum("_before")).first() == (999_999, 1_000_000, 999_999 * 500_000)


def test_window_edges(spark):
    rows = [("a", 0, 1, 1), ("a", 60_000, 2, 1), ("b", 0, 3, 1), ("b", 60_001, 4, 1), ("c", 0, 5, 0), ("c", 1, 6, 0),
            # Denied calls count: the third is the one over the limit of 2, and the fourth stays denied.
            ("d", 0, 7, 2), ("d", 1, 8, 2), ("d", 2, 9, 2), ("d", 3, 10, 2)]
    df = spark.createDataFrame(rows, "label string, ts_ms bigint, request_id bigint, rpm_limit bigint")
    got = {r.request_id: r.allowed for r in rate_limit(df).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 0, 10: 0}


def test_cache_lookup_equals_loop(spark):
    rng = random.Random(9)
    entries = [(i, "hot" if rng.random() < 0.4 else f"h{rng.randrange(20)}", t := rng.randrange(400_000),
                None if rng.random() < 0.2 else t + rng.randrange(100_000)) for i in range(600)]
    asked = [(i, "hot" if rng.random() < 0.4 else f"h{rng.randrange(25)}", rng.randrange(500_000)) for i in range(900)]
    e = spark.createDataFrame(entries, "id bigint, request_hash string, created_at bigint, expires_at bigint")
    q = spark.createDataFrame(asked, "request_id bigint, request_hash string, created_at bigint")
    hits, versions = set(), {}
    for rid, h, ts in asked:
        old = [x for x in entries if x[1] == h and x[2] <= ts]
        if any(x[3] is None or x[3] > ts for x in old):
            hits.add(rid)
        if old:
            last = max(old, key=lambda x: (x[2], x[0]))
            if last[3] is None or last[3] > ts:
                versions[rid] = last[0]
    assert {r.request_id for r in cache_hits(q, e).collect()} == hits
    assert {r.request_id for r in cache_misses(q, e).collect()} == {a[0] for a in asked} - hits
    assert {r.request_id: r.entry_id for r in cache_asof(q, e).collect()} == versions


def test_cache_upsert_and_expiry_edge(spark):
    schema = "id bigint, request_hash string, created_at bigint, expires_at bigint"
    base = spark.createDataFrame([(1, "a", 10, 20), (2, "b", 10, None)], schema)
    new = spark.createDataFrame([(3, "a", 30), (4, "a", 40), (5, "c", 5)], "id bigint, request_hash string, created_at bigint")
    got = {r.request_hash: (r.id, r.expires_at) for r in cache_upsert(base, new, 100).collect()}
    assert got == {"a": (4, 140), "b": (2, None), "c": (5, 105)}
    forever = {r.request_hash: r.expires_at for r in cache_upsert(base, new, 0).collect()}
    assert forever["a"] is None
    # An entry that expires exactly now no longer serves, but the purge keeps it.
    kept = spark.createDataFrame([(1, "a", 0, 50)], schema)
    asked = spark.createDataFrame([(9, "a", 50)], "request_id bigint, request_hash string, created_at bigint")
    assert cache_hits(asked, kept).count() == 0
    assert purge_cache(kept, 50).count() == 1 and purge_cache(kept, 51).count() == 0


@pytest.mark.parametrize("width", [3_000_000, 40_000])
def test_one_hot_key_passes_in_batches(spark, width):
    """Half of a million distinct times on one key, also with a window longer than the log; batches stay small."""
    from pyspark.accumulators import AccumulatorParam
    from trafficlens.operators import anchored

    class Largest(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    largest = spark.sparkContext.accumulator(0, Largest())

    def watched(make):
        def outer(*args):
            step = make(*args)

            def run(batches):
                def seen():
                    for batch in batches:
                        largest.add(batch.num_rows)
                        yield batch
                yield from step(seen())
            return run
        return outer

    df = spark.range(1_000_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k"),
        F.col("id").alias("t"), F.col("id").alias("i"))
    kept = {name: getattr(anchored, name) for name in ("_summaries", "_thread_state", "_openers")}
    try:
        for name, make in kept.items():
            setattr(anchored, name, watched(make))
        starts = [r.start for r in anchored.anchored_windows(df, "k", "t", "i", width).filter("key = 'hot'")
                  .orderBy("start").collect()]
    finally:
        for name, make in kept.items():
            setattr(anchored, name, make)
    expected, t = [], 0
    while t < 1_000_000:
        expected.append(t)
        t += width + 2 - width % 2
    assert starts == expected
    assert 0 < largest.value <= int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


@pytest.mark.parametrize("batch", [1, 2, 7])
def test_windows_across_tiny_batches(spark, batch):
    """Every carried state is exercised: batches of a few rows against a plain loop."""
    rng = random.Random(batch)
    rows = skewed_times(rng, 1500, 3000)
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for width, span in ((40, 90), (7, 64), (1, 5), (300, 310)):
            expected, state = set(), {}
            for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
                if k not in state or t - state[k] > width:
                    state[k] = t
                    expected.add((k, t, i))
            got = [tuple(r) for r in anchored_windows(df, "k", "t", "i", width, span=span).collect()]
            assert len(got) == len(expected) and set(got) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def summary_batches(rng, keys, times, width, span, block, sizes):
    """Summaries of the chunks of random points as the scans get them, in batches of random sizes; and the points."""
    import pyarrow as pa
    from trafficlens.operators import anchored

    def batches(rows, names):
        columns = [pa.array(list(c), pa.string() if n == "key" else pa.int64()) for n, c in zip(names, zip(*rows))]
        whole, at = pa.RecordBatch.from_arrays(columns, names), 0
        while at < whole.num_rows:
            size = rng.choice(sizes)
            yield whole.slice(at, size)
            at += size
    points = sorted({(f"k{rng.randrange(keys)}", rng.randrange(-300, times)) for _ in range(rng.choice(sizes) * 40)})
    by_chunk = sorted(((k, t // span, t) for k, t in points), key=lambda r: (r[0], r[1], -r[2]))
    found = [tuple(r.values()) for b in anchored._summaries(width, span)(batches(by_chunk, ["key", "chunk", "t"]))
             for r in b.to_pylist()]
    rows = sorted((k, c // block, c, u, s) for k, c, u, s in found)
    return points, rows, batches


def test_scans_of_summaries_in_batches_of_any_size():
    from trafficlens.operators import anchored
    names = ["key", "block", "chunk", "upto", "last_start"]
    for seed in range(60):
        rng = random.Random(seed)
        width = rng.choice([1, 10, 40, 200])
        span, block = rng.choice([1, 2, 16]) * (width + 1), rng.choice([1, 3, 256])
        points, rows, batches = summary_batches(rng, 5, rng.choice([300, 3000, 20_000]), width, span, block, [1, 3, 20])
        composed = sorted(tuple(r.values()) for b in anchored._compose(width)(batches(rows, names)) for r in b.to_pylist())

        def threaded(rows):
            out = anchored._thread_state(width)(batches(rows, [*names, "before"]))
            return {(r["key"], r["chunk"]): r["entry"] for b in out for r in b.to_pylist()}
        before = threaded([(k, 0, c, u, s, anchored._NONE) for k, c, u, s in composed])
        got = threaded([(*r, before.get(r[:2], anchored._NONE)) for r in rows])
        want, opened = {}, {}
        for k, t in points:
            if k in opened:
                want.setdefault((k, t // span), opened[k])
            else:
                want[k, t // span] = None
            if t - opened.get(k, t - width - 1) > width:
                opened[k] = t
        assert got == {at: start for at, start in want.items() if start is not None}


def test_scans_take_no_python_step_per_chunk():
    """A month of sparse keys: nearly every point is a chunk of its own."""
    import time

    import numpy as np
    import pyarrow as pa
    from trafficlens.operators import anchored
    chunk = np.arange(10_000)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["a"] * 10_000), pa.array(chunk // 256), pa.array(chunk), pa.array(chunk * 976), pa.array(chunk * 976),
         pa.array(np.full(10_000, anchored._NONE))], ["key", "block", "chunk", "upto", "last_start", "before"])
    began = time.process_time()
    for scan in (anchored._compose(60), anchored._thread_state(60)):
        for _ in range(20):
            assert sum(b.num_rows for b in scan([batch])) > 0
    assert time.process_time() - began < 2
