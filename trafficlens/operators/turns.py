"""Conversations as turn tables: request text, last user turn, session memory, context compression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import SUMMARY_ACK, SUMMARY_HEADER
from ..functions.scalars import estimate_tokens, message_json, utf16_length
from ..sources.archive import materialise
from .cache import running_max


def extract_text(turns: DataFrame) -> DataFrame:
    """``conv_id, request_text``: the texts of a request in turn order, joined by newlines.

    The result is one text per request by definition. Archives that keep a request in one row use
    :func:`trafficlens.functions.body.request_text`, which needs no grouping.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["text"]), "\n")
                                        .alias("request_text"))


def last_user_text(turns: DataFrame) -> DataFrame:
    """``conv_id, last_user``; null for a conversation without a user turn."""
    is_user = F.col("role") == "user"
    return turns.groupBy("conv_id").agg(
        F.max_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("last_user"))


def first_system(turns: DataFrame) -> DataFrame:
    """``conv_id, system_turn``; null for a conversation without a system turn."""
    return turns.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "system", F.col("turn"))).alias("system_turn"))


def memory_recall(memory: DataFrame, top_k: int = 5) -> DataFrame:
    """The last ``2 * top_k`` turns of each session, oldest first: ``session_id, pos, role, content``.

    The rank filter is a group limit, so each task keeps at most that many rows per session before the shuffle.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("turn"))
    oldest = Window.partitionBy("session_id").orderBy("created_at", "turn")
    return (memory.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= 2 * top_k)
            .withColumn("pos", F.row_number().over(oldest).cast("bigint"))
            .select("session_id", "pos", "role", "content"))


def memory_inject(requests: DataFrame, recalled: DataFrame, messages: str = "messages") -> DataFrame:
    """Put each session's recalled turns in front of the request's messages (duplicates stay)."""
    context = (recalled.groupBy(F.col("session_id").alias("_session"))
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))),
                                lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
                    .alias("_ctx")))
    joined = requests.join(context, F.col("session_id") == F.col("_session"), "left")
    return joined.withColumn(messages, F.when(F.col("_ctx").isNull(), F.col(messages))
                             .otherwise(F.concat("_ctx", messages))).drop("_session", "_ctx")


def memory_inject_asof(requests: DataFrame, memory: DataFrame, top_k: int = 5, ts: str = "created_at",
                       messages: str = "messages") -> DataFrame:
    """Like :func:`memory_inject`, with the last ``2 * top_k`` turns stored before each request's own time.

    The latest earlier turn is looked up on narrow (session, time) points, cut by day; only turns that some request
    needs bring their texts along. A request without a session, or before its first turn, is left as it is.
    """
    last = (memory.groupBy(F.col("session_id").alias("key"), F.col("created_at"))
            .agg(F.max(F.struct("created_at", "turn")).alias("value"))
            # A turn is visible from the next second on.
            .select("key", (F.col("created_at") + 1).alias("t"), "value"))
    asked = running_max(requests.filter(F.col("session_id").isNotNull() & F.col(ts).isNotNull()), last,
                        "session_id", ts).filter(F.col("best").isNotNull())
    line = Window.partitionBy("session_id").orderBy("created_at", "turn", "role", "content")
    recent = line.rowsBetween(1 - 2 * top_k, Window.currentRow)
    place = F.struct("created_at", "turn")
    context = (memory.select("session_id", place.alias("_place"), F.lead(place).over(line).alias("_next"),
                             F.collect_list(F.struct("role", "content")).over(recent).alias("_ctx"))
               .filter(~F.col("_place").eqNullSafe(F.col("_next"))))  # of turns stored twice, the last has them all
    found = (asked.join(context, (F.col("_key") == F.col("session_id")) & (F.col("best") == F.col("_place")))
             .select("_key", "_t", "_ctx"))
    joined = requests.join(found, (requests["session_id"] == found["_key"]) & (requests[ts] == found["_t"]), "left")
    return joined.withColumn(messages, F.when(F.col("_ctx").isNull(), F.col(messages))
                             .otherwise(F.concat("_ctx", messages))).drop("_key", "_t", "_ctx")


def session_purge(memory: DataFrame, cutoff: int) -> DataFrame:
    """Memory without the sessions that have any turn older than the cutoff, however active they are now."""
    old = memory.filter(F.col("created_at") < cutoff).select("session_id").distinct()
    return memory.join(old, "session_id", "left_anti")


def distinct_sessions(memory: DataFrame, cutoff: int) -> DataFrame:
    return memory.filter(F.col("created_at") < cutoff).select("session_id").distinct()


def conversation_tokens(turns: DataFrame) -> DataFrame:
    """``conv_id, n, est_tokens`` of the JSON array of all messages, without building it."""
    length = utf16_length(message_json(F.col("role"), F.col("text")))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("_len"))
    return sizes.select("conv_id", "n", estimate_tokens(F.col("_len") + F.col("n") + 1).alias("est_tokens"))


def compress_plan(turns: DataFrame, trigger: int = 6000, retain: int = 4) -> DataFrame:
    """``conv_id, est_tokens, compressed, n_head, n_tail``: which turns would be summarised, which kept."""
    keep = 2 * retain
    yes = (F.col("est_tokens") >= trigger) & (F.col("n") > keep)
    return conversation_tokens(turns).select(
        "conv_id", "est_tokens", yes.cast("bigint").alias("compressed"),
        F.when(yes, F.col("n") - keep).otherwise(F.lit(0)).cast("bigint").alias("n_head"),
        F.when(yes, F.lit(keep)).otherwise(F.col("n")).cast("bigint").alias("n_tail"))


def extractive_summary(head: DataFrame) -> DataFrame:
    """Stand-in summariser: first head message, message count. Input ``conv_id, turn, role, text``."""
    return head.groupBy("conv_id").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" messages, starting with: "),
                 F.min_by(F.col("text"), F.col("turn"))).alias("summary"))


def compress_apply(turns: DataFrame, trigger: int = 6000, retain: int = 4,
                   summariser: Callable[[DataFrame], DataFrame] = extractive_summary) -> DataFrame:
    """``conv_id, pos, role, text`` after replacing the head of long conversations by its summary.

    A conversation for which the summariser returns nothing stays as it is. The summaries are written to the shared
    folder when this is called.
    """
    keep = 2 * retain
    whole, newest = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    size = F.sum(utf16_length(message_json(F.col("role"), F.col("text")))).over(whole)
    placed = (turns.select("conv_id", "turn", "role", "text")
              .withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_len", size)
              .withColumn("_back", F.row_number().over(newest)))
    long = (estimate_tokens(F.col("_len") + F.col("_n") + 1) >= trigger) & (F.col("_n") > keep)
    head = placed.filter(long & (F.col("_back") > keep)).select("conv_id", "turn", "role", "text")
    # The model runs once: a second run might answer otherwise, and rows are decided by its answer.
    summaries = materialise(summariser(head).filter(F.col("summary").isNotNull()).select(
        F.col("conv_id").alias("_conv"), F.col("summary").alias("_summary")))
    joined = placed.join(summaries, F.col("conv_id") == F.col("_conv"), "left")

    def message(pos, role, text):
        return F.struct(pos.cast("bigint").alias("pos"), role.alias("role"), text.alias("text"))

    summary = F.array(message(F.lit(0), F.lit("user"), F.concat(F.lit(SUMMARY_HEADER), F.col("_summary"))),
                      message(F.lit(1), F.lit("assistant"), F.lit(SUMMARY_ACK)))
    messages = (F.when(F.col("_summary").isNull(), F.array(message(F.col("turn"), F.col("role"), F.col("text"))))
                .when(F.col("_back") <= keep,
                      F.array(message(F.lit(keep + 2) - F.col("_back"), F.col("role"), F.col("text"))))
                .when(F.col("_back") == F.col("_n"), summary))  # the oldest turn of the head makes room for it
    return joined.select("conv_id", F.explode(messages).alias("m")).select("conv_id", "m.*")
