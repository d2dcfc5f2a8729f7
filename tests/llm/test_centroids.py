import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from trafficlens.llm import centroids as C

SCHEMA = "vec_id bigint, embedding array<float>, x string, id string, cluster string"


def vectors(n, dims=64, seed=5, spread=0.3):
    """Points around a few centres, which a rotation can tell apart."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [[m + rng.gauss(0, spread) for m in middles[rng.randrange(6)]] for _ in range(n)]


def odd_rows():
    """Nulls, non-finite and missing components, ties, repeated rows and ids."""
    made = vectors(150)
    rows = [(i, v, "a", "b", "c") for i, v in enumerate(made)]
    rows += [(7, made[7], None, None, None), (7, made[8], None, None, None), (None, made[9], None, None, None)]
    rows += [(200 + i, made[3], "same", "", "") for i in range(20)]
    rows += [(300, None, "a", "b", "c"), (301, [], "a", "b", "c"), (302, made[0][:63], "a", "b", "c"),
             (303, made[0][:63] + [None], "a", "b", "c"), (304, made[0][:63] + [math.nan], "a", "b", "c"),
             (305, made[0][:63] + [math.inf], "a", "b", "c"), (306, made[0] + [0.5], "a", "b", "c"), (307, [0.0] * 64, "a", "b", "c")]
    return rows


def plain(rows, k=16, rounds=3):
    """The clustering with plain loops over Python integers."""
    kept = []
    for i, v, *_ in rows:
        if v is None or len(v) != 64 or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, [math.floor(64 * float(np.float32(c))) for c in v]))
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        where = [n for _, n in assign()]
        for n in range(len(centres)):
            own = [v for (_, v), w in zip(kept, where) if w == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, assign())], centres


def test_equals_plain_loops_on_odd_rows(spark):
    rows = odd_rows()
    found = C.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5))
    want, centres = plain(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [(r["id"], r["cluster"], r["distance"]) for r in found.rows.collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert found.centres == centres
    assert sum(found.inertia) == sum(d for _, _, d in want)


def test_bounds_spare_most_verifications_where_vectors_cluster(spark):
    rows = [(i, v, "", "", "") for i, v in enumerate(vectors(3000, spread=0.1))]
    checked = C.cluster(spark.createDataFrame(rows, SCHEMA)).rows.agg(F.avg("checked")).first()[0]
    assert checked < 8


def test_lower_bound_never_exceeds_the_distance():
    x = np.floor(64 * np.array(vectors(400))).astype(np.int64)
    sums = [float(len(x)), *x.sum(axis=0).astype(float), *(x.T.astype(float) @ x)[np.triu_indices(64)]]
    for share in (0.05, 0.5, 1.0):
        turn = C._axes(sums, share)
        lead, rest = turn.split(x.astype(float))
        centres = x[:16]
        exact = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        best, least, checked = C.nearest(x, lead, rest, centres, turn)
        assert (least == exact.min(axis=1)).all() and (best == exact.argmin(axis=1)).all()
        assert (checked <= 16).all()
        c_lead, c_rest = turn.split(centres.astype(float))
        bound = ((lead[:, None] - c_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None]) ** 2
        assert (bound <= exact + 1e-6 * (1 + exact)).all()


def test_equal_vectors_tie_to_the_smaller_centroid(spark):
    rows = [(i, [0.25] * 64, "", "", "") for i in range(40)]
    found = C.cluster(spark.createDataFrame(rows, SCHEMA))
    assert {(r["cluster"], r["distance"]) for r in found.rows.collect()} == {(0, 0)}
    assert found.centres == [[16] * 64] * 16


def test_few_vectors_and_none(spark):
    few = C.cluster(spark.createDataFrame([(1, [0.5] * 64, "", "", ""), (2, [-0.51] * 64, "", "", "")], SCHEMA))
    assert len(few.centres) == 2 and sorted(r["distance"] for r in few.rows.collect()) == [0, 0]
    none = C.cluster(spark.createDataFrame([(1, None, "", "", "")], SCHEMA))
    assert none.rows.collect() == [] and none.centres == []


def test_component_beyond_the_limit_is_an_error(spark):
    import pytest
    with pytest.raises(Exception, match="too large"):
        C.cluster(spark.createDataFrame([(1, [3e6] * 64, "", "", "")], SCHEMA))
