"""Reading archived request bodies and writing the log tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import body as B
from . import schemas


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor can reach, below the cluster's checkpoint folder.

    Only a local session may do without that setting: its driver and executors are one process, and a temporary
    folder serves. Elsewhere a missing setting is an error, as each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="trafficlens-")
    return f"{base.rstrip('/')}/trafficlens-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    For a narrow result of costly work that several branches read: the work then runs once, and a lost executor
    re-reads files instead of repeating it.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def normalise_requests(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Typed columns of a raw body column; keys the schema does not name survive in ``raw``.

    ``outcome`` is ``400`` for a body that is no JSON object, and ``error`` says why; such a row has no other parts.
    """
    raw = F.col(body_col)
    parsed = df.withColumn("_body", B.parse_body(raw)).withColumn("error", B.body_error(raw, F.col("_body")))
    good = parsed.withColumn("_body", F.when(F.col("error").isNull(), F.col("_body")))
    body, messages = F.col("_body"), F.col("_body.messages")
    return good.select(
        *[c for c in df.columns if c != body_col],
        body["model"].alias("model"), B.is_true(body["stream"]).alias("stream"),
        F.coalesce(F.size(B.entries(messages)), F.lit(0)).cast("bigint").alias("n_messages"),
        B.request_text(body).alias("request_text"), B.last_user_text(B.messages_of(messages)).alias("last_user"),
        raw.alias("raw"), F.when(F.col("error").isNull(), "ok").otherwise("400").alias("outcome"), "error")


def read_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Archive of JSON lines ``{"request_id": …, "body": "…"}``, batch or file stream.

    A line that is no such object is kept as a row of its own, with the line in ``raw`` and outcome ``400``.
    """
    reader = (spark.readStream if streaming else spark.read).option("columnNameOfCorruptRecord", "_line")
    lines = reader.schema("request_id bigint, body string, _line string").json(path)
    return normalise_requests(lines.withColumn("body", F.coalesce("body", "_line")).drop("_line"))


def quarantine(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised requests that go on, and those that are rejected, with what was archived and why."""
    rejected = requests.filter("error IS NOT NULL").select("request_id", "outcome", "error", "raw")
    return requests.filter("error IS NULL").drop("error"), rejected


def dated(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Add the UTC day as ``dt``, whatever the session time zone."""
    days = F.floor(F.col(ts) / F.lit(86_400)).cast("int")
    return df.withColumn("dt", F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"))


def _append(df: DataFrame, path: str) -> None:
    # Rows of one day go to few, large files; a day spreads over several tasks when it is large (AQE).
    dated(df).hint("rebalance", F.col("dt")).write.mode("append").partitionBy("dt").parquet(path)


def write_request_log(df: DataFrame, path: str) -> None:
    _append(df, path)


def write_policy_log(df: DataFrame, path: str) -> None:
    _append(df, path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REQUEST_LOG + ", dt string").parquet(path)


def read_policy_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POLICY_LOG + ", dt string").parquet(path)


def log_row(df: DataFrame) -> DataFrame:
    """The 18 stored columns of an answered request; absent ones get their neutral value.

    A duration that nobody measured is null: zero would count as a streamed response.
    """
    have = set(df.columns)

    def col(name: str, default: Column) -> Column:
        return (F.col(name) if name in have else default).alias(name)

    none = F.lit(None).cast("string")
    return df.select(
        (F.col("id") if "id" in have else F.col("request_id").cast("string")).alias("id"), "request_id", "provider",
        F.col("routed_model").alias("model"), "input_tokens", "output_tokens",
        col("duration_ms", F.lit(None).cast("bigint")), F.col("from_cache").cast("bigint").alias("from_cache"),
        F.when(F.col("from_cache") == 1, F.lit("exact")).otherwise(none).alias("cache_source"),
        col("compressed", F.lit(0).cast("bigint")), "created_at", "original_model", "routed_model",
        "routing_method", "routing_tier", "cost_usd", "saved_usd",
        F.coalesce(F.col("user_label"), F.lit("anonymous")).alias("user_label"))


def encode_embeddings(df: DataFrame, column: str) -> DataFrame:
    """Vectors as packed little-endian float32 blobs."""
    def pack(batches):
        import numpy as np
        for pdf in batches:
            pdf[column] = [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in pdf[column]]
            yield pdf
    return _with_type(df, column, "binary", pack)


def decode_embeddings(df: DataFrame, column: str) -> DataFrame:
    """Packed little-endian float32 blobs as ``array<float>``."""
    def unpack(batches):
        import numpy as np
        for pdf in batches:
            pdf[column] = [None if b is None else np.frombuffer(b, dtype="<f4") for b in pdf[column]]
            yield pdf
    return _with_type(df, column, "array<float>", unpack)


def _with_type(df: DataFrame, column: str, data_type: str, fn) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {data_type if f.name == column else f.dataType.simpleString()}"
                       for f in df.schema.fields)
    return df.mapInPandas(fn, fields)
