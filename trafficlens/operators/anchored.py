"""Anchored windows: a window opens at the first event after the previous window ran out.

Both the request limiter and the replay of an expiring cache follow this recurrence, which no SQL window frame
expresses: where a window starts depends on where the one before it started. A plain scan per key would put a key
that holds a third of all traffic into one task. Instead time is cut into chunks, and

1. events are reduced to distinct (key, time) points before anything else is shuffled;
2. each (key, chunk), read backwards, works out in parallel where its last window would start for every state it may
   be entered in;
3. each (key, block) of ``BLOCK`` chunks, in parallel, composes their summaries into one for the block;
4. a light scan per key threads the real state through the summaries of its blocks, and then, in parallel, a scan of
   each block threads it through those of its chunks;
5. each (key, chunk), again in parallel, lists the windows it opens.

Points are sorted by Spark and pass through Python in Arrow batches; no row ever holds a list of them. Between batches
steps 4 and 5 carry one number, and steps 2 and 3 the points of one window: 16 bytes for each distinct time in it, however
many requests or windows a key has. Of a key whose windows never fall in step, one task of step 4 meets one row in
``SPAN_FACTOR * BLOCK`` points; of others it meets far fewer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chunk length as a multiple of the window width.
SPAN_FACTOR = 16
# Chunks of a block.
BLOCK = 256


def _int64(column):
    import numpy as np
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _groups(batch, before, part="chunk"):
    """Group number of each row of a batch sorted by (key, ``part``), its parts, and whether the batch goes on with the
    group ``before`` of the last one."""
    import numpy as np
    import pyarrow.compute as pc
    key, chunk = batch.column("key"), _int64(batch.column(part))
    new = (pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False).astype(bool)
           | (chunk[1:] != chunk[:-1]))
    return np.r_[0, np.cumsum(new)], chunk, before == (key[0].as_py(), chunk[0])


def _summaries(width: int, span: int):
    """From points sorted by key and chunk with the latest first: (key, chunk, upto, last_start).

    A chunk entered while a window runs until before ``upto`` has its last window start at ``last_start``. Rows beyond
    those needed, at the edges of batches, say the same as the others and do no harm.
    """
    stride = span + width + 2

    def run(batches):
        import numpy as np
        import pyarrow as pa
        before, held, held_last = None, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group, chunk, goes_on = _groups(batch, before)
            if not goes_on:
                held, held_last = held[:0], held_last[:0]
            # Ascending on one axis, groups too far apart to touch; the points held come last, in the last group.
            group, chunk = (group[-1] - group)[::-1], chunk[::-1]
            t = np.r_[_int64(batch.column("t"))[::-1], held]
            offset = t - np.r_[chunk, np.full(len(held), chunk[-1])] * span
            axis = np.r_[group, np.full(len(held), group[-1])] * stride + offset
            nxt = np.searchsorted(axis, axis + width, side="right")
            inside = (nxt < len(t)) & (np.arange(len(t)) < n)
            inside[inside] = axis[nxt[inside]] // stride == axis[inside] // stride
            last = np.where(inside, nxt, np.arange(len(t)))
            while not np.array_equal(further := last[last], last):
                last = further
            last = np.r_[t[:n], held_last][last]
            # A window from an earlier chunk runs out before offset = width, so the opener is a point below that or the
            # first one after it.
            first = np.r_[True, group[1:] != group[:-1]]
            entry = np.flatnonzero((offset[:n] < width) | first | np.r_[False, offset[:n - 1] < width])
            keep = entry[np.r_[(group[entry][1:] != group[entry][:-1]) | (last[entry][1:] != last[entry][:-1]), True]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(n - 1 - keep)), pa.array(chunk[keep]), pa.array(t[keep]),
                 pa.array(last[keep])], ["key", "chunk", "upto", "last_start"])
            # The next batch goes on below the first group; only what lies up to one window above can matter to it.
            end = np.searchsorted(group, 0, side="right")
            if group[-1] == 0:
                end = len(t)
            end = min(end, np.searchsorted(t[:end], t[0] + width, side="left") + 1)
            before, held, held_last = (batch.column("key")[n - 1].as_py(), chunk[0]), t[:end].copy(), last[:end].copy()
    return run


def _onward(group, upto, after):
    """For each summary, the first one of its group whose ``upto`` lies beyond ``after``; itself where there is none.

    Within a group ``upto`` ascends from chunk to chunk, so the chunks that leave a state alone are skipped by one search.
    """
    import numpy as np
    n = len(upto)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    low = upto[first][group]
    stride = int((upto - low).max()) + 3
    axis = group * stride + (upto - low) + 1
    at = np.searchsorted(axis, group * stride + np.clip(after - low, -1, stride - 3) + 1, side="right")
    end = np.r_[first[1:], n][group]
    return np.where(at < end, at, np.arange(n))


def _compose(width: int):
    """From summaries of chunks, sorted by key, block, chunk and ``upto``, those of blocks, in the same form.

    A state that enters the block at a summary goes on from its ``last_start`` to the next summary that this one's window
    does not cover, and so on to the end. All summaries of a batch are followed at once, in doubling steps.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        place, begins, upto, last = None, 0, None, None

        def rows(key, block, upto, last):
            return pa.RecordBatch.from_arrays([key, pa.array(block), pa.array(upto), pa.array(last)],
                                              ["key", "chunk", "upto", "last_start"])

        def told(upto, last):
            n = len(upto)
            return rows(pa.array([place[0]] * n, pa.string()), np.full(n, place[1]), upto, last)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            block = _int64(batch.column("block"))
            group, _, goes_on = _groups(batch, place, "block")
            if place is not None and not goes_on:
                yield told(upto, last)
            held = len(upto) if goes_on else 0
            ends, starts = _int64(batch.column("upto")), _int64(batch.column("last_start"))
            if held:
                ends, starts = np.r_[upto, ends], np.r_[last, starts]
                group = np.r_[np.zeros(held, np.int64), group]
            to = _onward(group, ends, starts + width)
            while not np.array_equal(further := to[to], to):
                to = further
            final = starts[to]
            # Only states from before the block enter it: they run out below its first time plus the width.
            first = np.r_[True, group[1:] != group[:-1]]
            low = ends[first]
            if goes_on:
                low[0] = begins
            low = low[group]
            entry = np.flatnonzero(first | np.r_[False, ends[:-1] - low[:-1] < width])
            keep = entry[np.r_[(group[entry][1:] != group[entry][:-1]) | (final[entry][1:] != final[entry][:-1]), True]]
            done = keep[group[keep] < group[-1]]
            if len(done):
                here = done[done >= held] - held
                if held:
                    yield told(ends[done[done < held]], final[done[done < held]])
                yield rows(batch.column("key").take(pa.array(here)), block[here], ends[here + held], final[here + held])
            rest = keep[group[keep] == group[-1]]
            if not (goes_on and group[-1] == 0):
                begins = int(low[-1])
            place, upto, last = (batch.column("key")[n - 1].as_py(), int(block[-1])), ends[rest].copy(), final[rest].copy()
        if place is not None:
            yield told(upto, last)
    return run


def _thread_state(width: int):
    """From summaries sorted by key, block, chunk and ``upto``, each with the state ``before`` its block: the start of
    the window that each chunk is entered in.

    The summaries that the state of a block meets are marked all at once, in doubling steps from the first.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        place, at_chunk, state = None, None, _NONE
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            chunk = _int64(batch.column("chunk"))
            ends, starts = _int64(batch.column("upto")), _int64(batch.column("last_start"))
            group, block, goes_on = _groups(batch, place, "block")
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            enters = _int64(batch.column("before"))[first]
            if goes_on:
                enters[0] = state
            to = _onward(group, ends, starts + width)
            # Where the state that a block is entered in runs out: its first summary, when there is none.
            after = np.where(enters == _NONE, ends[first] - 1, enters + width)
            met = np.zeros(n, bool)
            head = first.copy()
            late = np.flatnonzero(ends[first] <= after)
            if len(late):
                head[late] = _onward(group, ends, after[group])[first[late]]
                late = late[head[late] == first[late]]  # the state outlasts all summaries here
            met[np.delete(head, late)] = True
            while True:
                met[to[met]] = True
                if np.array_equal(further := to[to], to):
                    break
                to = further
            latest = np.maximum.accumulate(np.where(met, np.arange(n), -1))
            latest = np.where(latest >= first[group], latest, -1)
            left = np.where(latest >= 0, starts[latest], enters[group])  # the state after each summary
            opens = np.r_[not (goes_on and chunk[0] == at_chunk), (group[1:] != group[:-1]) | (chunk[1:] != chunk[:-1])]
            into = np.r_[_NONE, left[:-1]]
            into[first] = enters
            told = np.flatnonzero(opens & (into != _NONE))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(told)), pa.array(chunk[told]),
                                              pa.array(into[told])], ["key", "chunk", "entry"])
            place, at_chunk, state = (batch.column("key")[n - 1].as_py(), int(block[-1])), int(chunk[-1]), int(left[-1])
    return run


_NONE = -(1 << 63)  # no window was open


def _openers(width: int, span: int):
    """From points sorted by key, chunk and time, each chunk led by its entry (``t`` null): the windows opened."""
    stride = span + width + 2

    def run(batches):
        import numpy as np
        import pyarrow as pa
        before, reach = None, -1
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group, chunk, goes_on = _groups(batch, before)
            rid = _int64(batch.column("rid"))
            is_entry = batch.column("t").is_null().to_numpy(zero_copy_only=False)
            t = _int64(batch.column("t").fill_null(0))
            offset = np.where(is_entry, -2, t - chunk * span)
            axis = (group + 1) * stride + offset
            # How far, within the chunk, the window runs in which each group is entered; -1 is not at all.
            reaches = np.full(group[-1] + 1, -1, np.int64)
            if goes_on:
                reaches[0] = reach
            e = np.flatnonzero(is_entry)
            reaches[group[e]] = np.maximum(rid[e] + width - chunk[e] * span, -1)
            numbers = np.arange(len(reaches))
            frontier = np.searchsorted(axis, (numbers + 1) * stride + reaches, side="right")
            nxt = np.searchsorted(axis, axis + width, side="right")
            opened = []
            owner = numbers
            while True:
                ok = frontier < n
                frontier, owner = frontier[ok], owner[ok]
                ok = group[frontier] == owner
                frontier, owner = frontier[ok], owner[ok]
                if not len(frontier):
                    break
                opened.append(frontier)
                reaches[owner] = offset[frontier] + width
                frontier = nxt[frontier]
            rows = np.concatenate(opened) if opened else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(rows)), pa.array(t[rows]), pa.array(rid[rows])],
                ["key", "start", "first_id"])
            before, reach = (batch.column("key")[n - 1].as_py(), chunk[-1]), reaches[-1]
    return run


IN_ORDER = ["key", "block", "chunk", "upto"]


def _blocked(points: DataFrame, width: int, span: int) -> DataFrame:
    """Summaries of all chunks, dealt out by blocks: one shuffle serves both scans of the blocks."""
    summaries = (points.repartition("key", "chunk").sortWithinPartitions("key", "chunk", F.desc("t"))
                 .mapInArrow(_summaries(width, span), "key string, chunk bigint, upto bigint, last_start bigint"))
    return summaries.withColumn("block", F.floor(F.col("chunk") / F.lit(BLOCK)).cast("bigint")).repartition("key", "block")


def _composed(blocked: DataFrame, width: int) -> DataFrame:
    """Summaries of the blocks; a block stands in ``chunk``."""
    return blocked.sortWithinPartitions(*IN_ORDER).mapInArrow(
        _compose(width), "key string, chunk bigint, upto bigint, last_start bigint")


def _entries(blocked: DataFrame, width: int) -> DataFrame:
    """``key, chunk, entry``: the start of the window that each chunk is entered in."""
    threaded = lambda rows: rows.sortWithinPartitions(*IN_ORDER).mapInArrow(
        _thread_state(width), "key string, chunk bigint, entry bigint")
    entered = threaded(_composed(blocked, width).withColumn("block", F.lit(0).cast("bigint"))
                       .withColumn("before", F.lit(_NONE)).repartition("key"))
    entered = entered.select(F.col("key").alias("_key"), F.col("chunk").alias("_block"), F.col("entry").alias("before"))
    led = blocked.join(entered, (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block")), "left")
    return threaded(led.select(*IN_ORDER, "last_start", F.coalesce("before", F.lit(_NONE)).alias("before")))


def anchored_windows(events: DataFrame, key: str, ts: str, row_id: str, width: int | None,
                     span: int | None = None) -> DataFrame:
    """Windows ``(key, start, first_id)``: one opens at the first event with ``ts - start > width``.

    ``events`` holds only rows that may open a window. ``width=None`` never runs out. Ties in ``ts`` go to the
    lowest ``row_id``. ``key`` must be a string, ``ts`` and ``row_id`` BIGINT.
    """
    points = events.select(F.col(key).alias("key"), F.col(ts).alias("t"), F.col(row_id).alias("rid"))
    if width is None:
        return (points.groupBy("key").agg(F.min("t").alias("start"), F.min_by("rid", F.struct("t", "rid"))
                                          .alias("first_id")))
    span = span or SPAN_FACTOR * (width + 1)
    # Both readers take all columns of the points, so that they plan alike and the shuffle is made once and reused.
    points = (points.withColumn("chunk", F.floor(F.col("t") / F.lit(span)).cast("bigint"))
              .filter(F.col("key").isNotNull() & F.col("chunk").isNotNull())
              .groupBy("key", "chunk", "t").agg(F.min("rid").alias("rid")))
    entries = _entries(_blocked(points, width, span), width)
    led = points.unionByName(entries.select("key", "chunk", F.lit(None).cast("bigint").alias("t"),
                                            F.col("entry").alias("rid")))
    return (led.repartition("key", "chunk").sortWithinPartitions("key", "chunk", F.asc_nulls_first("t"))
            .mapInArrow(_openers(width, span), "key string, start bigint, first_id bigint"))


def assign_windows(rows: DataFrame, windows: DataFrame, key: str, ts: str, row_id: str, width: int | None,
                   payload: Sequence[str] = (), span: int | None = None) -> DataFrame:
    """Add ``win`` to every row: the struct (start, first_id, payload…) of the window it falls into, else null.

    ``windows`` comes from :func:`anchored_windows`, with any payload columns joined on. Rows meet the few windows
    of their own (key, chunk) by equality, so a hot key splits over its chunks and AQE may split those further.
    """
    fields = ["start", "first_id", *payload]
    if width is None:
        listed = windows.select(F.col("key").alias("_key"), F.struct(*fields).alias("win"))
        out = rows.join(listed, rows[key] == listed["_key"], "left").drop("_key")
        return out.withColumn("win", _covering(F.col("win"), ts, row_id, None))
    span = span or SPAN_FACTOR * (width + 1)
    chunk_of = lambda c: F.floor(c / F.lit(span)).cast("bigint")
    listed = (windows
              .withColumn("_chunk", F.explode(F.array_distinct(F.array(
                  chunk_of(F.col("start")), chunk_of(F.col("start") + F.lit(width))))))
              .groupBy(F.col("key").alias("_key"), "_chunk")
              .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_wins")))
    at = rows.withColumn("_at", chunk_of(F.col(ts)))
    out = at.join(listed, (at[key] == listed["_key"]) & (at["_at"] == listed["_chunk"]), "left")
    before = F.filter("_wins", lambda w: (w["start"] < F.col(ts))
                      | ((w["start"] == F.col(ts)) & (w["first_id"] <= F.col(row_id))))
    latest = F.get(before, F.size(before) - 1)
    return (out.withColumn("win", _covering(latest, ts, row_id, width))
            .drop("_at", "_key", "_chunk", "_wins"))


def _covering(win: Column, ts: str, row_id: str, width: int | None) -> Column:
    started = (win["start"] < F.col(ts)) | ((win["start"] == F.col(ts)) & (win["first_id"] <= F.col(row_id)))
    live = F.lit(True) if width is None else F.col(ts) - win["start"] <= F.lit(width)
    return F.when(started & live, win)
