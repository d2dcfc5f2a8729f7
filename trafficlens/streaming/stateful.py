"""Stateful stream operators. State is a few numbers (or one bounded list) per key and expires with event time.

Operators with about as many keys as rows gather their keys in ``BUCKETS`` buckets: a bucket is one group of the state
store, so that a micro-batch calls Python once per bucket and not once per key.

Rows of one micro-batch are handled in (time, id) order, so a stream that arrives in time order gives exactly the batch
result. The size of a micro-batch is the source's ``maxFilesPerTrigger`` / ``maxBytesPerTrigger``. Rows later than the
watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


BUCKETS = 2048


def _bucket(key: str):
    """Bucket of a key. Null is alone in its own, so that the keys of all others stay whole numbers in pandas."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int")


def _keep_until(state, event_ms: int) -> None:
    state.setTimeoutTimestamp(max(event_ms, state.getCurrentWatermarkMs() + 1))


def _with_time(df: DataFrame, seconds_col: str, delay: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds(F.col(seconds_col))).withWatermark("event_time", delay)


def _sorted(batches, columns):
    import pandas as pd
    return pd.concat(list(batches), ignore_index=True).sort_values(columns, kind="stable")


def stream_rate_limit(requests: DataFrame, window_ms: int = 60_000, delay: str = "1 hour") -> DataFrame:
    """Limiter over a stream of ``request_id, label, rpm_limit, created_at``; adds ``allowed``. State: start, count."""
    def step(key, batches, state):
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = _sorted(batches, ["created_at", "request_id"])
        allowed = []
        for seconds, limit in zip(rows["created_at"].tolist(), rows["rpm_limit"].tolist()):
            now = seconds * 1000
            if start is None or now - start > window_ms:
                start, count = now, 0
            count += 1
            allowed.append(int(count <= limit))
        if start is not None:
            state.update((start, count))
            _keep_until(state, start + window_ms + 1)
        yield pd.DataFrame({"request_id": rows["request_id"], "label": key[0], "allowed": allowed})

    timed = _with_time(requests.select("request_id", "label", "rpm_limit", "created_at"), "created_at", delay)
    limited = timed.filter("rpm_limit > 0").groupBy("label").applyInPandasWithState(
        step, "request_id bigint, label string, allowed bigint", "start bigint, cnt bigint", "append",
        GroupStateTimeout.EventTimeTimeout)
    # Traffic without a limit needs no state, and no key gathers it in one task.
    free = requests.filter("rpm_limit IS NULL OR rpm_limit <= 0")
    return limited.unionByName(free.select("request_id", "label", F.lit(1).cast("bigint").alias("allowed")))


def stream_cache(requests: DataFrame, ttl: int, delay: str = "1 hour") -> DataFrame:
    """Exact-cache replay over a stream of ``request_id, request_hash, created_at, can_fill``; adds ``hit``.

    State: the start of each hash of a bucket that may still serve. A row without a time is not served and fills nothing.
    """
    def step(key, batches, state):
        import json

        import pandas as pd
        starts = dict(json.loads(state.get[0])) if state.exists else {}
        if not state.hasTimedOut:
            rows = _sorted(batches, ["created_at", "request_id"])
            hits = []
            for name, now, fills in zip(rows["request_hash"].tolist(), rows["created_at"].tolist(), rows["can_fill"].tolist()):
                start = starts.get(name)
                served = start is not None and (ttl == 0 or start + ttl > now)
                hits.append(int(served))
                if not served and fills and now == now:
                    starts[name] = int(now)
            yield pd.DataFrame({"request_id": rows["request_id"], "hit": hits})
        if ttl:  # what is over before the watermark serves no row that may still come
            over = state.getCurrentWatermarkMs()
            starts = {name: start for name, start in starts.items() if (start + ttl) * 1000 >= over}
        if starts:
            state.update((json.dumps(list(starts.items())),))
            if ttl:
                _keep_until(state, (min(starts.values()) + ttl) * 1000)
        elif state.exists:
            state.remove()

    timed = _with_time(requests.select("request_id", "request_hash", "created_at", "can_fill"), "created_at", delay)
    return timed.withColumn("bucket", _bucket("request_hash")).groupBy("bucket").applyInPandasWithState(
        step, "request_id bigint, hit bigint", "starts string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_memory(turns: DataFrame, top_k: int = 5, ttl_seconds: int = 7200, delay: str = "1 hour") -> DataFrame:
    """Session memory over a stream of turns: each turn with the JSON array of up to ``2 * top_k`` turns before it.

    A session idle for longer than its lifetime starts afresh.
    """
    ttl_seconds = max(ttl_seconds, 60)

    def step(key, batches, state):
        import json

        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        kept, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = _sorted(batches, ["created_at", "turn"])
        counts, contexts = [], []
        for now, role, content in zip(rows["created_at"].tolist(), rows["role"].tolist(), rows["content"].tolist()):
            if last is not None and now - last > ttl_seconds:
                kept = []
            counts.append(len(kept))
            contexts.append(json.dumps(kept, ensure_ascii=False))
            kept = (kept + [{"role": role, "content": content}])[-2 * top_k:]
            last = now
        state.update((json.dumps(kept, ensure_ascii=False), last))
        _keep_until(state, (last + ttl_seconds + 1) * 1000)
        yield pd.DataFrame({"session_id": key[0], "turn": rows["turn"], "n_recalled": counts, "context": contexts})

    timed = _with_time(turns.select("session_id", "turn", "role", "content", "created_at"), "created_at", delay)
    return timed.groupBy("session_id").applyInPandasWithState(
        step, "session_id string, turn bigint, n_recalled bigint, context string", "kept string, last bigint",
        "append", GroupStateTimeout.EventTimeTimeout)


def assemble_transcripts(chunks: DataFrame, idle_seconds: int = 3600, delay: str = "1 hour") -> DataFrame:
    """Whole transcripts from a stream of ``request_id, provider, seq, chunk, is_last, created_at``.

    One row per response: when its last chunk has arrived, with ``complete`` 1, or with what has arrived and
    ``complete`` 0 when it has stalled for ``idle_seconds``. What is delivered again afterwards, as late as the watermark
    lets it come, changes nothing: a mark stays behind for so long. State of a bucket: the marks, as pairs of id and time
    in binary, and the parts of the responses that have not ended.
    """
    idle = idle_seconds * 1000

    def step(key, batches, state):
        import json

        import numpy as np
        import pandas as pd
        watermark = state.getCurrentWatermarkMs()
        marks, open_ = {}, {}
        if state.exists:
            kept = np.frombuffer(state.get[0], np.int64).reshape(-1, 2)
            marks = dict(kept.tolist())
            open_ = {entry["id"]: entry for entry in json.loads(state.get[1])}
        out, seen = [], set()

        def take(rid, provider, seqs, chunks, ends, at):
            """The rows of one response, by ``seq``; what came last of a repeated one holds."""
            until = max((at or 0) + idle, watermark + 1)
            if rid in marks:
                marks[rid] = max(marks[rid], until)
                return
            known = open_.get(rid)
            parts = dict(known["parts"]) if known else {}
            parts.update(zip(seqs, chunks))
            end = ends[-1] if ends else known["end"] if known else None
            if end is not None and len(parts) == end + 1 and all(k in parts for k in range(end + 1)):
                open_.pop(rid, None)
                marks[rid] = until
                out.append((rid, provider, "".join([parts[k] for k in range(end + 1)]), 1))
            else:
                open_[rid] = {"id": rid, "until": until, "provider": provider, "end": end, "parts": list(parts.items())}

        if not state.hasTimedOut:
            rows = _sorted(batches, ["request_id", "seq"])
            ids = rows["request_id"].fillna(0).to_numpy(np.int64)  # null ids are alone in their bucket
            edges = [*np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist(), len(ids)]
            at = np.fmax.reduceat(rows["created_at"].to_numpy(np.float64), edges[:-1])
            ids, provider, seq = ids.tolist(), rows["provider"].tolist(), rows["seq"].tolist()
            chunk, last = rows["chunk"].tolist(), (rows["is_last"] == 1).tolist()
            for lo, hi, when in zip(edges, edges[1:], at.tolist()):
                seen.add(ids[lo])
                take(ids[lo], provider[lo], seq[lo:hi], chunk[lo:hi], [seq[i] for i in range(lo, hi) if last[i]],
                     int(when) * 1000 if when == when else None)
        for rid in [r for r, until in marks.items() if until < watermark and r not in seen]:
            del marks[rid]
        for rid in [r for r, entry in open_.items() if entry["until"] < watermark and r not in seen]:
            entry = open_.pop(rid)
            marks[rid] = max(watermark + idle, watermark + 1)
            out.append((rid, entry["provider"], "".join(c for _, c in sorted(entry["parts"])), 0))
        if marks or open_:
            state.update((np.array(list(marks.items()), np.int64).tobytes(), json.dumps(list(open_.values()))))
            _keep_until(state, min([*marks.values(), *[entry["until"] for entry in open_.values()]]))
        elif state.exists:
            state.remove()
        if out:
            found = pd.DataFrame(out, columns=["request_id", "provider", "raw", "complete"])
            if key[0] == -1:
                found["request_id"] = None
            yield found

    timed = _with_time(chunks.select("request_id", "provider", "seq", "chunk", "is_last", "created_at"),
                       "created_at", delay)
    return timed.withColumn("bucket", _bucket("request_id")).groupBy("bucket").applyInPandasWithState(
        step, "request_id bigint, provider string, raw string, complete bigint", "marks binary, open string", "append",
        GroupStateTimeout.EventTimeTimeout)
