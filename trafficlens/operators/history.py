"""Identities and policies as they were at the time of each request.

The stored tables say what holds now; the changes that made them say what held when. A history has a row for each
version, valid from ``since`` until ``until`` (null: still). Requests find theirs by an as-of lookup over distinct
(key, second): days are independent, so neither a busy key nor a key of many versions meets a task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cache import running_max
from .identity import identified
from .policy import policy_union

_FIELDS = {"token": "string", "upstream_key": "string", "allowed_models_csv": "string", "rpm_limit": "bigint",
           "policy_name": "string", "revoked": "bigint"}
_ALWAYS = -(1 << 60)  # a time before all requests


def _set(value: Column, kind: str, when: Column | None = None) -> Column:
    """A field that an event sets, perhaps to null; itself null where the event leaves the field alone."""
    held = F.struct(value.cast(kind).alias("v"))
    return held if when is None else F.when(when, held)


def _event(rows: DataFrame, at: str, rank: int, fields: dict[str, Column]) -> DataFrame:
    none = lambda kind: F.lit(None).cast(f"struct<v: {kind}>")
    return rows.select("label", F.coalesce(F.col(at).cast("bigint"), F.lit(_ALWAYS)).alias("since"), F.lit(rank).alias("rank"),
                       *[fields.get(n, none(kind)).alias(n) for n, kind in _FIELDS.items()])


def token_history(tokens: DataFrame, upserts: DataFrame | None = None, patches: DataFrame | None = None,
                  revocations: DataFrame | None = None) -> DataFrame:
    """``label, since, until`` and the fields of every version of every identity.

    ``tokens`` holds from its ``created_at``. Upserts (see ``dim_upsert``) and patches (``token_patch``) carry
    ``changed_at``, revocations ``label, revoked_at``. At one time an upsert comes before a patch, and that before a
    revocation; of versions that begin at once the last holds. Patches and revocations of unknown labels do nothing.
    """
    whole = lambda extra: {n: _set(extra.get(n, F.col(n)), kind) for n, kind in _FIELDS.items()}
    events = [_event(tokens, "created_at", 0, whole({}))]
    if upserts is not None:
        events.append(_event(upserts, "changed_at", 1, whole({
            "rpm_limit": F.coalesce(F.col("rpm_limit").cast("bigint"), F.lit(0).cast("bigint")), "revoked": F.lit(0)})))
    if patches is not None:
        given = lambda name: F.col(f"has_{name}") == 1
        events.append(_event(patches, "changed_at", 2, {
            "upstream_key": _set(F.col("upstream_key"), "string", given("upstream_key")),
            "allowed_models_csv": _set(F.col("allowed_models_csv"), "string", given("allowed_models")),
            "rpm_limit": _set(F.col("rpm_limit"), "bigint", F.col("rpm_limit").isNotNull()),
            "policy_name": _set(F.col("policy_name"), "string", given("policy_name"))}))
    if revocations is not None:
        events.append(_event(revocations, "revoked_at", 3, {"revoked": _set(F.lit(1), "bigint")}))
    rows = events[0]
    for more in events[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("label").orderBy("since", "rank")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    folded = rows.select("label", "since", F.lead("since").over(order).alias("until"), *[
        F.last(n, ignorenulls=True).over(so_far).alias(n) for n in _FIELDS])
    real = folded.filter(F.col("token").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("since"))))
    return real.select("label", "since", "until", *[F.col(f"{n}.v").alias(n) for n in _FIELDS])


def auth_asof(requests: DataFrame, history: DataFrame, required: bool = False, bearer: str = "bearer",
              ts: str = "created_at") -> DataFrame:
    """``auth_resolve`` by the identities that held at the time of each request (see :func:`token_history`)."""
    live = history.filter(F.col("revoked") == 0)
    point = lambda at, alive: live.select(F.col("token").alias("key"), F.col(at).alias("t"), F.struct(
        F.col(at).alias("t"), F.lit(alive).alias("alive"), "label", "since").alias("value"))
    # A token ends with its version, unless the next one begins then with the same token.
    points = (point("since", 1).unionByName(point("until", 0).filter("t IS NOT NULL"))
              .groupBy("key", "t").agg(F.max("value").alias("value")))
    best = running_max(requests.filter(F.col(bearer).isNotNull()), points, bearer, ts).filter("best.alive = 1")
    found = best.select("_key", "_t", F.col("best.label").alias("_l"), F.col("best.since").alias("_s")).join(
        live.select(F.col("label").alias("_label"), "since", F.col("rpm_limit").alias("_rpm"),
                    F.col("allowed_models_csv").alias("_models"), F.col("policy_name").alias("_policy")),
        (F.col("_l") == F.col("_label")) & (F.col("_s") == F.col("since"))).drop("_l", "_s", "since")
    joined = requests.join(found, (F.col(bearer) == F.col("_key")) & (F.col(ts) == F.col("_t")), "left").drop("_key", "_t")
    return identified(joined, required)


def policy_history(upserts: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """``name, since, deleted`` and the columns of every version of every stored policy.

    ``upserts`` holds parsed policies (see ``parse_policies``) with ``changed_at``, deletions ``name, deleted_at``. Of
    versions that begin at one time the one written last wins, which an upsert is, compared with a deletion.
    """
    rows = upserts.withColumn("since", F.coalesce("changed_at", F.lit(_ALWAYS))).withColumn("deleted", F.lit(False)).drop("changed_at")
    if deletions is not None:
        gone = deletions.select("name", F.col("deleted_at").alias("since"), F.lit(True).alias("deleted"))
        rows = rows.unionByName(gone, allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy("name", "since").orderBy("deleted"))
    return rows.withColumn("_n", newest).filter("_n = 1").drop("_n")


def policy_asof(named: DataFrame, history: DataFrame, config: DataFrame, name: str = "policy_name",
                ts: str = "created_at") -> DataFrame:
    """``policy_resolve`` by the stored policies that held at the time of each row; the configured ones hold where none did."""
    versions = (policy_union(history.filter(~F.col("deleted")).drop("deleted"), config.limit(0)).unionByName(
        config.withColumn("source", F.lit("config")).withColumn("since", F.lit(_ALWAYS).cast("bigint")), allowMissingColumns=True))
    kept = [c for c in versions.columns if c not in ("name", "since")]
    point = lambda rows, rank, source, since: rows.select(F.col("name").alias("key"), F.col("since").alias("t"), F.struct(
        F.col("since").alias("t"), F.lit(rank).alias("rank"), F.lit(source).alias("source"), since.alias("since")).alias("value"))
    always = F.lit(_ALWAYS).cast("bigint")
    points = (point(history.filter(~F.col("deleted")), 2, "db", F.col("since"))
              .unionByName(point(history.filter("deleted"), 1, "config", always))
              .unionByName(point(config.select("name", always.alias("since")), 0, "config", always))
              .groupBy("key", "t").agg(F.max("value").alias("value")))
    best = running_max(named.filter(F.col(name).isNotNull()), points, name, ts)
    found = best.filter("best IS NOT NULL").select(
        "_key", "_t", F.col("best.source").alias("_source"), F.col("best.since").alias("_since")).join(
        versions, (F.col("_key") == F.col("name")) & (F.col("_source") == F.col("source")) & (F.col("_since") == F.col("since")))
    return named.join(found.select("_key", "_t", *kept), (F.col(name) == F.col("_key")) & (F.col(ts) == F.col("_t")),
                      "left").drop("_key", "_t")
