"""The similarity cache against plain pairs."""

import math
import random

import numpy as np
import pytest

from trafficlens.operators import similarity as S

SCHEMA = "vec_id bigint, embedding array<float>, provider string, model string, cls string, first string, cell string"


def near(rng, middle, spread):
    return [m + rng.gauss(0, spread) for m in middle]


def plain(rows, threshold):
    """Best earlier match of each row, over all pairs."""
    usable = [(i, v, k) for i, v, *k in (r[:4] for r in rows) if i is not None and v is not None and len(v) == 64
              and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    x = np.array([np.float32(v).astype(np.float64) for _, v, _ in usable]).reshape(-1, 64)
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    out = []
    for a, (i, _, k) in enumerate(usable):
        found = []
        for b, (j, _, other) in enumerate(usable):
            if j < i and k == other:
                cosine = round(float((x[a] * x[b]).sum()), 9)
                if cosine >= threshold:
                    found.append((-cosine, j))
        if found:
            out.append((i, min(found)[1], -min(found)[0]))
    return sorted(out)


def check(spark, rows, threshold, **options):
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).repartition(5)
    got = sorted((r.vec_id, r.match_id, r.similarity) for r in S.semantic_match(df, threshold, **options).collect())
    assert got == plain(rows, threshold)
    return got


def crowd(n, seed=2, spread=0.2, ids=None):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(4)]
    rows = [(i, near(rng, middles[0 if i % 3 else rng.randrange(4)], spread), "p", rng.choice(["m", None])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("threshold", [0.94, 0.97, 0.4, 1.0, 0.0])
def test_equals_all_pairs_with_crowded_rings_cut_into_chunks(spark, threshold):
    rows = crowd(400)
    rows += [(1000 + i, rows[5][1], "p", "m") for i in range(60)]  # copies of one vector
    rows += [(2000 + i, [c * 2 for c in rows[5][1]], "p", "m") for i in range(3)]  # of the same direction
    rows += [(3, rows[7][1], "p", "m"), (3, rows[7][1], "p", "m")]  # a repeated row, an id with two vectors
    got = check(spark, rows, threshold, cell=16, per_pivot=40)
    assert got or threshold == 1.0


def test_odd_vectors_take_no_part(spark):
    v = crowd(1)[0][1]
    rows = [(1, v, "p", "m"), (2, None, "p", "m"), (3, [], "p", "m"), (4, [0.0] * 64, "p", "m"), (5, v[:63], "p", "m"),
            (6, v[:63] + [None], "p", "m"), (7, v[:63] + [math.nan], "p", "m"), (8, v[:63] + [math.inf], "p", "m"),
            (None, v, "p", "m"), (9, v, None, "m"), (10, v, None, "m"), (11, v, "p", None), (12, v, "", "m"), (13, v, "p", "m")]
    assert check(spark, rows, 0.9) == [(10, 9, 1.0), (13, 1, 1.0)]
    assert check(spark, rows[1:4], 0.9) == [] == check(spark, [], 0.9)


def test_plan_pairs_no_rows_outside_their_rings(spark):
    df = spark.createDataFrame([(*r, "", "", "") for r in crowd(200)], SCHEMA)
    found = S.semantic_match(df, dry_run=True, cell=16, per_pivot=40)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert {r.served for r in found.collect()} == {0}
    assert {r.action for r in S.semantic_events(found).collect()} == {"semantic_dry_run"}


def test_a_ring_is_visited_only_by_vectors_that_may_match_there(spark):
    """Four far groups: nearly every vector looks into its own cell alone."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(*r, "", "", "") for r in crowd(400, spread=0.05)], SCHEMA)
    v = F.transform("embedding", lambda c: c.cast("double"))
    classes = S._classes(df.select(F.col("vec_id").alias("id"), F.lit("").alias("key"), v.alias("v")))
    pivots = S._pivots(classes, 20)
    radius = math.acos(0.99)
    homes = S._homes(classes, pivots, radius)
    reach = [tuple(r) for r in homes.groupBy("cell").agg(F.min("angle"), F.max("angle")).collect()]
    visits = S._visits(homes, pivots, radius, radius, reach)
    held = homes.select("cell", "ring").distinct().count()
    assert visits.count() < 0.75 * 400 * held


def test_a_vector_travels_a_bounded_number_of_times(spark):
    """A loose threshold rules out nothing; more vectors, and so more pivots, do not send each to more places."""
    from pyspark.sql import functions as F
    rng = random.Random(4)
    for n in (100, 400):
        rows = [(i, near(rng, [0] * 64, 1), "p", "m") for i in range(n)]
        df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
        v = F.transform("embedding", lambda c: c.cast("double"))
        classes = S._classes(df.select(F.col("vec_id").alias("id"), F.lit("").alias("key"), v.alias("v")))
        pivots = S._pivots(classes, 10)
        radius = math.acos(0.4)
        homes = S._homes(classes, pivots, radius)
        reach = [tuple(r) for r in homes.groupBy("cell").agg(F.min("angle"), F.max("angle")).collect()]
        assert S._visits(homes, pivots, radius, radius, reach).count() <= 8 * n
