"""Token usage from response JSON and from event-stream transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import SPACES

_USAGE = "usage struct<input_tokens: bigint, output_tokens: bigint, prompt_tokens: bigint, completion_tokens: bigint>"


def parse_usage(body: Column) -> tuple[Column, Column]:
    """(input, output) tokens of a complete response; 0 when absent."""
    usage = F.from_json(body, _USAGE)["usage"]
    return (F.coalesce(usage["input_tokens"], usage["prompt_tokens"], F.lit(0).cast("bigint")),
            F.coalesce(usage["output_tokens"], usage["completion_tokens"], F.lit(0).cast("bigint")))


def sse_events(raw: Column) -> Column:
    """Parsed ``data:`` events of one transcript, in order; blank, ``[DONE]`` and malformed ones are dropped."""
    data = F.filter(F.split(raw, "\n"), lambda line: line.startswith("data:"))
    data = F.transform(data, lambda line: F.btrim(F.substr(line, F.lit(6)), F.lit(SPACES)))
    data = F.filter(data, lambda text: (text != "") & (text != "[DONE]"))
    schema = f"message struct<{_USAGE}>, {_USAGE}"
    return F.filter(F.transform(data, lambda text: F.from_json(text, schema)), lambda e: e.isNotNull())


def _last_non_zero(values: Column) -> Column:
    kept = F.filter(values, lambda v: v.isNotNull() & (v != 0))
    return F.coalesce(F.get(F.reverse(kept), F.lit(0)), F.lit(0).cast("bigint"))


def sse_usage(df: DataFrame, raw_col: str = "raw", provider_col: str = "provider") -> DataFrame:
    """Add ``input_tokens``, ``output_tokens`` of streamed responses: the last non-zero value of each kind wins.

    Stays inside the row: no explode, no shuffle. Events are a column of their own, so they are parsed once.
    """
    events, provider = F.col("_events"), F.col(provider_col)

    def pick(anthropic, other):
        return F.when(provider == "anthropic", _last_non_zero(F.transform(events, anthropic))) \
            .otherwise(_last_non_zero(F.transform(events, other)))

    tokens_in = pick(
        lambda e: F.when(e["message"]["usage"].isNotNull(), e["message"]["usage"]["input_tokens"])
        .otherwise(e["usage"]["input_tokens"]),
        lambda e: e["usage"]["prompt_tokens"])
    tokens_out = pick(lambda e: e["usage"]["output_tokens"], lambda e: e["usage"]["completion_tokens"])
    return (df.withColumn("_events", sse_events(F.col(raw_col))).withColumn("input_tokens", tokens_in)
            .withColumn("output_tokens", tokens_out).drop("_events"))
