"""Identities and policies as of each request, against replayed changes."""

import random

from pyspark.sql import functions as F

from trafficlens.operators import history, identity

TOKENS = ("label string, token string, upstream_key string, allowed_models_csv string, rpm_limit bigint, revoked bigint, "
          "created_at bigint, policy_name string")
UPSERTS = ("label string, token string, upstream_key string, allowed_models_csv string, rpm_limit bigint, "
           "policy_name string, changed_at bigint")
PATCHES = ("label string, upstream_key string, has_upstream_key int, allowed_models_csv string, has_allowed_models int, "
           "rpm_limit bigint, policy_name string, has_policy_name int, changed_at bigint")


def plain(tokens, upserts, patches, revoked, requests):
    """Apply all changes up to each request's time, one by one, to a dict of identities."""
    steps = [(t[6] if t[6] is not None else -1, 0, t[0], dict(token=t[1], models=t[3], rpm=t[4], policy=t[7], gone=t[5])) for t in tokens]
    steps += [(u[6], 1, u[0], dict(token=u[1], models=u[3], rpm=u[4] or 0, policy=u[5], gone=0)) for u in upserts]
    for p in patches:
        change = {}
        if p[4]:
            change["models"] = p[3]
        if p[5] is not None:
            change["rpm"] = p[5]
        if p[7]:
            change["policy"] = p[6]
        steps.append((p[8], 2, p[0], change))
    steps += [(at, 3, label, {"gone": 1}) for label, at in revoked]
    steps.sort(key=lambda s: s[:3])
    out = {}
    for rid, bearer, at in requests:
        now = {}
        for when, rank, label, change in steps:
            if when <= at and (rank < 2 or label in now):
                now[label] = {**now.get(label, {}), **change}
        found = [(label, v) for label, v in now.items() if v["token"] == bearer and not v["gone"]]
        out[rid] = (found[0][0], found[0][1]["rpm"] or 0, found[0][1]["policy"], "ok") if found else ("anonymous", 0, None, "401")
    return out


def test_identities_as_of_each_request(spark):
    rng = random.Random(8)
    day = 86_400
    tokens = [(f"u{i}", f"t{i}", None, rng.choice([None, "m"]), rng.randrange(4), i % 5 == 0, None if i % 4 == 0 else rng.randrange(3 * day), "p")
              for i in range(12)]
    tokens = [(*t[:5], int(t[5]), *t[6:]) for t in tokens]
    upserts, patches, revoked = [], [], []
    for k in range(60):
        label, at = f"u{rng.randrange(15)}", rng.randrange(6) * day // 2
        if any(u[0] == label and u[6] == at for u in upserts):
            continue
        upserts.append((label, f"t{label}-{k}" if rng.random() < 0.6 else f"t{label[1:]}", None, None, rng.choice([None, 7]), f"q{k}", at))
    for label in {f"u{rng.randrange(18)}" for _ in range(9)}:
        patches.append((label, "k", 1, None, rng.randrange(2), rng.choice([None, 9]), None, rng.randrange(2), rng.randrange(3 * day)))
    revoked = [(f"u{i}", rng.randrange(3 * day)) for i in range(0, 18, 3)]
    names = [t[1] for t in tokens] + [u[1] for u in upserts] + ["none", None]
    requests = [(i, rng.choice(names), rng.choice([rng.randrange(4 * day), rng.randrange(7) * day // 2])) for i in range(1500)]
    made = history.token_history(spark.createDataFrame(tokens, TOKENS), spark.createDataFrame(upserts, UPSERTS),
                                 spark.createDataFrame(patches, PATCHES), spark.createDataFrame(revoked, "label string, revoked_at bigint"))
    df = spark.createDataFrame(requests, "request_id bigint, bearer string, created_at bigint")
    got = {r.request_id: (r.label, r.rpm_limit, r.policy_name, r.outcome)
           for r in history.auth_asof(df, made, required=True).collect()}
    assert got == plain(tokens, upserts, patches, revoked, requests)
    assert len({v[0] for v in got.values()}) > 8


def test_without_changes_it_is_the_plain_lookup(spark):
    tokens = spark.createDataFrame([("a", "ta", None, "m1,m2", 3, 0, None, "p"), ("b", "tb", None, None, 1, 1, None, None)], TOKENS)
    df = spark.createDataFrame([(1, "ta", 5), (2, "tb", 5), (3, None, 5), (4, "ta", -5)], "request_id bigint, bearer string, created_at bigint")
    asof = history.auth_asof(df, history.token_history(tokens)).orderBy("request_id")
    want = identity.auth_resolve(df, tokens).orderBy("request_id")
    assert asof.select(*want.columns).collect() == want.collect()


def test_policies_as_of_each_row(spark):
    upserts = spark.createDataFrame([("p", 100, "block"), ("p", 300, "log"), ("q", None, "redact"), ("r", 50, "block")],
                                    "name string, changed_at bigint, dlp_action string")
    gone = spark.createDataFrame([("p", 200), ("q", 400), ("r", 50), ("s", 10)], "name string, deleted_at bigint")
    config = spark.createDataFrame([("p", "mask"), ("s", "mask")], "name string, dlp_action string")
    cases = [("p", 99, "config", "mask"), ("p", 100, "db", "block"), ("p", 199, "db", "block"), ("p", 200, "config", "mask"),
             ("p", 300, "db", "log"), ("p", 10**9, "db", "log"), ("q", 0, "db", "redact"), ("q", 399, "db", "redact"),
             ("q", 400, None, None), ("r", 49, None, None), ("r", 50, "db", "block"), ("s", 9, "config", "mask"),
             ("s", 10, "config", "mask"), ("none", 5, None, None), (None, 5, None, None)]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, policy_name string, created_at bigint")
    got = {r.i: (r.source, r.dlp_action) for r in history.policy_asof(df, history.policy_history(upserts, gone), config).collect()}
    assert got == {i: c[2:] for i, c in enumerate(cases)}
