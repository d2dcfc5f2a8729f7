"""Tokens: resolution of bearers to identities, allowlists and upkeep of the identity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mask_token

ANONYMOUS = "anonymous"


def csv_list(value: Column) -> Column:
    """Comma-separated text as an array; null and empty text are an empty list."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), ","), lambda x: x != "")


def active_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.filter(F.col("revoked") == 0).orderBy(F.desc("created_at"), "label")


def key_lookup(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``table`` whose ``column`` is among the keys: a batch of point lookups."""
    return table.join(keys.select(column), column, "left_semi")


def auth_resolve(requests: DataFrame, tokens: DataFrame, required: bool = False, bearer: str = "bearer") -> DataFrame:
    """Add ``label``, ``rpm_limit``, ``allowed_models``, ``policy_name``, ``known`` and ``outcome`` (ok | 401).

    Unknown and revoked tokens are anonymous (limit 0) or, when identity is required, rejected.
    """
    live = tokens.filter(F.col("revoked") == 0).select(
        F.col("token").alias("_token"), F.col("label").alias("_label"), F.col("rpm_limit").alias("_rpm"),
        F.col("allowed_models_csv").alias("_models"), F.col("policy_name").alias("_policy"))
    joined = requests.join(live, F.col(bearer) == F.col("_token"), "left")
    return identified(joined.drop("_token"), required)


def identified(joined: DataFrame, required: bool = False) -> DataFrame:
    """Requests with the ``_label, _rpm, _models, _policy`` of their live token, null where there is none, as identities."""
    known = F.col("_label").isNotNull()
    return (joined.withColumn("label", F.coalesce("_label", F.lit(ANONYMOUS)))
            .withColumn("rpm_limit", F.coalesce(F.col("_rpm").cast("bigint"), F.lit(0).cast("bigint")))
            .withColumn("allowed_models", csv_list(F.col("_models")))
            .withColumn("policy_name", F.col("_policy")).withColumn("known", known)
            .withColumn("outcome", F.when(~known & F.lit(required), "401").otherwise("ok"))
            .drop("_label", "_rpm", "_models", "_policy"))


def model_allowed(model: Column, allowed: Column) -> Column:
    """Either name contains the other; no list or no model allows everything."""
    hit = F.exists(allowed, lambda m: F.contains(model, m) | F.contains(m, model))
    return (F.size(allowed) == 0) | model.isNull() | (model == "") | hit


def model_allow(resolved: DataFrame, model: str = "model") -> DataFrame:
    """Add ``allowed`` to requests that carry their identity's ``allowed_models``."""
    return resolved.withColumn("allowed", model_allowed(F.col(model), F.col("allowed_models")))


def model_allow_join(requests: DataFrame, tokens: DataFrame, bearer: str = "bearer") -> DataFrame:
    """Allowlist in bulk: the distinct (identity, model) pairs are matched, then joined back by equality."""
    live = (tokens.filter(F.col("revoked") == 0)
            .select(F.col("token").alias("_token"), F.explode(csv_list(F.col("allowed_models_csv"))).alias("_entry")))
    pairs = requests.filter(F.coalesce(F.col("model"), F.lit("")) != "").select(
        F.col(bearer).alias("_token"), F.col("model").alias("_model")).distinct()
    matched = (pairs.join(live, "_token")
               .groupBy("_token", "_model")
               .agg(F.max(F.contains(F.col("_model"), F.col("_entry"))
                          | F.contains(F.col("_entry"), F.col("_model"))).alias("_ok")))
    joined = requests.join(matched, (F.col(bearer) == F.col("_token")) & (F.col("model") == F.col("_model")), "left")
    return joined.withColumn("allowed", F.coalesce("_ok", F.lit(True))).drop("_token", "_model", "_ok")


def user_summary(tokens: DataFrame, user_stats: DataFrame) -> DataFrame:
    """Every token, revoked ones too, with its all-time numbers; the token is masked."""
    s = user_stats.select(F.col("user_label").alias("_label"), "reqs", "cost", "saved")
    return (tokens.join(s, tokens["label"] == s["_label"], "left")
            .select("label", mask_token(F.col("token")).alias("token_masked"), "rpm_limit", "policy_name", "revoked",
                    F.coalesce("reqs", F.lit(0).cast("bigint")).alias("requests"),
                    F.coalesce("cost", F.lit(0.0)).alias("cost_usd"),
                    F.coalesce("saved", F.lit(0.0)).alias("saved_usd")))


def _change_join(base: DataFrame, changes: DataFrame, key: str, how: str) -> DataFrame:
    c = changes.select(*[F.col(n).alias(f"_{n}") for n in changes.columns])
    return base.join(c, base[key] == c[f"_{key}"], how)


def dim_upsert(tokens: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace identities by label. A replaced identity keeps its creation time and is un-revoked."""
    j = _change_join(tokens, changes, "label", "full_outer")
    hit = F.col("_label").isNotNull()

    def new(name: str) -> Column:
        return F.when(hit, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    return j.select(
        F.coalesce("label", "_label").alias("label"), new("token"), new("upstream_key"), new("allowed_models_csv"),
        F.when(hit, F.coalesce(F.col("_rpm_limit").cast("bigint"), F.lit(0).cast("bigint")))
        .otherwise(F.col("rpm_limit")).alias("rpm_limit"),
        F.when(hit, F.lit(0).cast("bigint")).otherwise(F.col("revoked").cast("bigint")).alias("revoked"),
        F.coalesce("created_at", "_changed_at").alias("created_at"), new("policy_name"))


def policy_upsert(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace stored policies by name; the creation time stays, the update time moves."""
    j = _change_join(policies, changes, "name", "full_outer")
    hit = F.col("_name").isNotNull()
    return j.select(
        F.coalesce("name", "_name").alias("name"),
        F.when(hit, F.col("_display_name")).otherwise(F.col("display_name")).alias("display_name"),
        F.when(hit, F.col("_config")).otherwise(F.col("config")).alias("config"),
        F.coalesce("created_at", "_changed_at").alias("created_at"),
        F.coalesce("_changed_at", "updated_at").alias("updated_at"))


def token_patch(tokens: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial update by label: a field present in the patch is set (null clears it), an absent one stays.

    Presence is carried by ``has_<field>`` columns; ``rpm_limit`` null keeps the old limit. Unknown labels do nothing.
    """
    j = _change_join(tokens, patches, "label", "left")

    def patched(name: str) -> Column:
        return F.when(F.col(f"_has_{name}") == 1, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    keep = [c for c in tokens.columns if c not in ("upstream_key", "allowed_models_csv", "rpm_limit", "policy_name")]
    models = (F.when(F.col("_has_allowed_models") == 1, F.col("_allowed_models_csv"))
              .otherwise(F.col("allowed_models_csv")).alias("allowed_models_csv"))
    return j.select(*keep, patched("upstream_key"), models,
                    F.coalesce(F.col("_rpm_limit").cast("bigint"), F.col("rpm_limit")).alias("rpm_limit"),
                    patched("policy_name"))


def token_revoke(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Soft delete: tokens with ``revoked`` set for the given labels, and ``changed`` telling which those are."""
    j = _change_join(tokens, labels.select("label").distinct(), "label", "left")
    hit = F.col("_label").isNotNull()
    return (j.withColumn("revoked", F.when(hit, F.lit(1)).otherwise(F.col("revoked")).cast("bigint"))
            .withColumn("changed", hit.cast("bigint")).drop("_label"))


def policy_delete(policies: DataFrame, names: DataFrame) -> DataFrame:
    """Hard delete of stored policies by name."""
    return policies.join(names.select("name"), "name", "left_anti")


def touch_last_used(tokens: DataFrame, requests: DataFrame, bearer: str = "bearer") -> DataFrame:
    """Add ``last_used_at``: time of the last request that presented the (live) token."""
    used = requests.groupBy(F.col(bearer).alias("_token")).agg(F.max("created_at").alias("_seen"))
    return (tokens.join(used, tokens["token"] == used["_token"], "left")
            .withColumn("last_used_at", F.when(F.col("revoked") == 0, F.col("_seen"))).drop("_token", "_seen"))
