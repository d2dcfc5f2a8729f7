"""User extension points: ordered request steps and model hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import ROUTING_RULES
from ..functions.scalars import truncate_prompt
from ..operators.routing import rule_tier

Step = Callable[[DataFrame], DataFrame]
DEFAULT_PRIORITY = 50


def in_order(steps: Iterable[tuple[int | None, Step]]) -> list[Step]:
    return [step for _, step in sorted(steps, key=lambda s: DEFAULT_PRIORITY if s[0] is None else s[0])]


def run_steps(requests: DataFrame, steps: Iterable[tuple[int | None, Step]]) -> DataFrame:
    """Apply steps in priority order (lower first, default 50, equal ones in the order given).

    A step adds or changes columns with ``withColumn``; it keeps every row. It may answer a request by setting its
    ``short_circuit`` column: what later steps make of that row is undone. All steps together are one pass.
    """
    current = requests
    if "short_circuit" not in current.columns:
        current = current.withColumn("short_circuit", F.lit(None).cast("string"))
    for step in in_order(steps):
        old = current.columns
        after = step(current.withColumn("_was", F.struct(*old)))
        answered = F.col("_was.short_circuit").isNotNull()
        current = after.select(*[
            F.when(answered, F.col("_was")[c] if c in old else F.lit(None)).otherwise(F.col(c)).alias(c)
            for c in after.columns if c != "_was"])
    return current


def run_response_steps(responses: DataFrame, steps: Iterable[tuple[int | None, Step]]) -> DataFrame:
    """Apply response steps in priority order to answers with ``from_cache``; each sees what the one before it made.

    Steps see a cached answer as well, each as it came out of the cache, but cannot change it.
    """
    current = responses
    for step in in_order(steps):
        old = current.columns
        after = step(current.withColumn("_was", F.struct(*old)))
        cached = F.coalesce(F.col("_was.from_cache") == 1, F.lit(False))
        current = after.select(*[
            F.when(cached, F.col("_was")[c] if c in old else F.lit(None)).otherwise(F.col(c)).alias(c)
            for c in after.columns if c != "_was"])
    return current


def run_error_steps(requests: DataFrame, steps: Iterable[tuple[int | None, Step]]) -> DataFrame:
    """What the error steps report about requests whose ``error`` is set: all reports in one table, with ``step`` from 1.

    A step maps failed requests to report rows; it changes nothing else. All steps report the same columns.
    """
    failed = requests.filter(F.col("error").isNotNull())
    reports = [step(failed).withColumn("step", F.lit(n).cast("bigint")) for n, step in enumerate(in_order(steps), 1)]
    if not reports:
        raise ValueError("no error steps")
    out = reports[0]
    for more in reports[1:]:
        out = out.unionByName(more)
    return out


def one_by_one(model: Callable[[list], list], texts: list) -> list:
    """Answers of a model to a batch of texts. If the batch fails, each text is asked alone, and one that fails is None.
    """
    def ask(part):
        out = list(model(part))
        if len(out) != len(part):
            raise ValueError("the model gave another number of answers than texts")
        return out
    try:
        return ask(texts)
    except Exception:
        answers = []
        for text in texts:
            try:
                answers += ask([text])
            except Exception:
                answers.append(None)
        return answers


def classify(df: DataFrame, text_col: str, model: Callable | None = None) -> DataFrame:
    """Add ``classified``: simple | standard | complex. ``model`` maps a pandas Series of excerpts to labels.

    Any other answer counts as standard, and so does a text on which the model fails.
    """
    excerpt = truncate_prompt(F.col(text_col), 500)
    if model is None:
        return df.withColumn("classified", length_classifier(excerpt))

    @F.pandas_udf("string")
    def answer(texts):
        import pandas as pd
        found = one_by_one(lambda part: list(model(pd.Series(part, dtype=object))), texts.tolist())
        out = pd.Series(found, index=texts.index).astype("string").str.strip().str.lower()
        return out.where(out.isin(["simple", "complex"]), "standard").fillna("standard")

    return df.withColumn("classified", answer(excerpt))


def length_classifier(excerpt: Column) -> Column:
    """Deterministic stand-in for a model: keyword rules, then short excerpts are simple."""
    return F.coalesce(rule_tier(excerpt, ROUTING_RULES),
                      F.when(F.length(excerpt) < 200, "simple").otherwise("standard"))


def embed(df: DataFrame, text_col: str, model: Callable, out_col: str = "embedding") -> DataFrame:
    """Add a normalised vector per text. ``model`` maps a list of texts to a 2-d array; a text on which it fails gets null."""
    columns = [f for f in df.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + f", `{out_col}` array<float>"

    def run(batches):
        import numpy as np
        for pdf in batches:
            vectors = one_by_one(lambda texts: list(np.asarray(model(texts), dtype="float64")), pdf[text_col].tolist())
            scaled = []
            for v in vectors:
                norm = 0.0 if v is None else np.linalg.norm(v)
                scaled.append(None if v is None else (v / norm if norm else v).astype("float32"))
            pdf[out_col] = scaled
            yield pdf

    return df.mapInPandas(run, schema)


def letter_embedder(texts: list[str]):
    """Deterministic stand-in for a model: counts of the 26 letters."""
    import numpy as np
    out = np.zeros((len(texts), 26))
    for i, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("ascii", "ignore"), dtype=np.uint8)
        codes = codes[(codes >= 97) & (codes <= 122)] - 97
        out[i] = np.bincount(codes, minlength=26)
    return out


def summarise(head: DataFrame, model: Callable) -> DataFrame:
    """Summaries of conversation heads by a user model, for ``compress_apply``.

    ``model`` maps a list of head texts (JSON arrays of messages) to summaries; a head on which it fails leaves
    its conversation as it is. A head is one request's messages, so the grouped text is bounded by the size of a request.
    """
    texts = head.groupBy("conv_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("head"))

    def run(batches):
        for pdf in batches:
            pdf["summary"] = one_by_one(lambda heads: list(model(heads)), pdf["head"].tolist())
            yield pdf[["conv_id", "summary"]]

    return texts.mapInPandas(run, "conv_id bigint, summary string")
