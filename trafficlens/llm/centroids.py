"""Centroid clustering in integers, with distances bounded from below in a PCA-rotated space.

Components are scaled and floored to integers, so that every distance, sum and centroid is exact and the result does
not depend on how rows are dealt out. The principal axes come from sums over all vectors. For each vector the leading
coordinates in those axes are stored, as many as hold ``SHARE`` of the variance, with the norm of what they leave out. For a vector x and a centroid
c, both split that way, the squared distance of their leading coordinates plus the squared difference of their residual
norms is at most their squared distance. In a round, a vector is first compared with the centroid of least bound; only
centroids whose bound does not exceed that distance are verified, in 64-bit integers. The bound is lowered by more than
its rounding error, so none that could be nearest is left out, and ties go to the smaller number.

A pass over the stored vectors emits one row of sums per task and centroid; those are summed again by Spark and end
as one row for each centroid and component. Vectors pass through tasks in slices of ``SLICE``.

Defined results: vectors that are null, hold null or non-finite components, or have another number of components are
left out; repeated rows are separate vectors; a null id is kept, and chosen last as a centroid; rows whose id is the same
are ordered by their components; fewer vectors than centroids make fewer centroids; an empty table gives an empty result;
a component whose scaled value is 2^27 or more is an error, as its distances might not fit 64 bits.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
SHARE = 0.8
SLICE = 2048
LARGEST = 1 << 27
STORED = "id bigint, x array<int>, lead array<double>, rest double"


@dataclass(frozen=True)
class Rotation:
    """The mean of all vectors and their leading principal axes (dims x lead)."""

    mean: object
    axes: object

    def split(self, x):
        """Leading coordinates of integer vectors, and the norm of the rest."""
        import numpy as np
        centred = x - self.mean
        lead = centred @ self.axes
        return lead, np.sqrt(np.maximum((centred * centred).sum(axis=1) - (lead * lead).sum(axis=1), 0))


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS,
           scale: int = SCALE) -> DataFrame:
    """``id, x`` of the vectors that take part, their components as integers."""
    v = F.transform(vectors[f"`{vec_col}`"], lambda c: c.cast("double"))
    usable = (F.size(v) == dims) & ~F.exists(v, lambda c: F.coalesce(~(F.abs(c) < F.lit(float("inf"))), F.lit(True)))
    whole = F.transform(v, lambda c: F.when(F.abs(c) < LARGEST / scale, F.floor(c * scale).cast("int")).otherwise(
        F.raise_error(F.lit("a component is too large for distances in 64 bits")).cast("int")))
    return vectors.select(vectors[f"`{id_col}`"].cast("bigint").alias("id"), F.when(usable, whole).alias("x")).where("x IS NOT NULL")


def first_centroids(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors whose ids have the least SHA-256."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return [list(r["x"]) for r in points.orderBy(key.asc_nulls_last(), "x").select("x").limit(k).collect()]


def _matrix(column):
    """A list column of equal lengths as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def rotation(points: DataFrame, share: float = SHARE) -> Rotation:
    """Principal axes from the sums of components and of their products, one row of sums a task."""
    def sums(batches):
        import numpy as np
        import pyarrow as pa
        n, first, second = 0, 0.0, 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = _matrix(batch.column("x").slice(at, SLICE)).astype(np.float64)
                n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        if n:
            upper = second[np.triu_indices(len(second))]
            yield pa.RecordBatch.from_pydict({"s": pa.array([np.concatenate(([float(n)], first, upper))], pa.list_(pa.float64()))})

    found = (points.select("x").mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("at", "s"))
             .groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect())  # 1 + dims + dims * (dims + 1) / 2 rows
    return _axes([r["s"] for r in found], share)


def _axes(sums: list[float], share: float) -> Rotation | None:
    import numpy as np
    if not sums:
        return None
    n, dims = sums[0], 0
    while 1 + dims + dims * (dims + 1) // 2 < len(sums):
        dims += 1
    mean = np.array(sums[1:dims + 1]) / n
    second = np.zeros((dims, dims))
    second[np.triu_indices(dims)] = sums[dims + 1:]
    second = second + np.triu(second, 1).T
    variance, axes = np.linalg.eigh(second / n - np.outer(mean, mean))
    held = np.cumsum(np.maximum(variance[::-1], 0))  # the largest come last
    lead = min(dims, 1 + int(np.searchsorted(held, share * held[-1])))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1][:, :lead]))


def stored_points(points: DataFrame, turn: Rotation) -> DataFrame:
    """The vectors with their leading coordinates and residual norms, written once for all rounds."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lead, rest = turn.split(_matrix(part.column("x")).astype(np.float64))
                flat = pa.array(lead.ravel())
                rows = pa.ListArray.from_arrays(pa.array(range(0, lead.size + 1, lead.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("x"), rows, pa.array(rest)],
                                                 names=["id", "x", "lead", "rest"])

    return materialise(points.mapInArrow(run, STORED))


def nearest(x, lead, rest, centres, turn: Rotation):
    """Number and squared distance of the nearest of the integer ``centres``, and how many were verified."""
    import numpy as np
    c_lead, c_rest = turn.split(centres.astype(np.float64))
    gap = lead[:, None, :] - c_lead[None, :, :]
    bound = np.einsum("nkd,nkd->nk", gap, gap) + (rest[:, None] - c_rest[None, :]) ** 2
    # Far more than the rounding of the sums above, which is relative to the squared norms.
    size = (lead * lead).sum(axis=1) + rest * rest + float((c_lead * c_lead).sum(axis=1).max() + (c_rest * c_rest).max())
    bound -= (1e-9 * (1 + size + float(turn.mean @ turn.mean)))[:, None]
    best = bound.argmin(axis=1)
    gap = x - centres[best]
    least = (gap * gap).sum(axis=1)
    survives = bound <= least[:, None]
    survives[np.arange(len(x)), best] = False
    checked = 1 + survives.sum(axis=1)
    for k in np.flatnonzero(survives.any(axis=0)):
        # A bound may have been undercut by a centroid verified meanwhile.
        rows = np.flatnonzero(survives[:, k] & (bound[:, k] <= least))
        gap = x[rows] - centres[k]
        d = (gap * gap).sum(axis=1)
        closer = (d < least[rows]) | ((d == least[rows]) & (k < best[rows]))
        best[rows[closer]], least[rows[closer]] = k, d[closer]
    return best, least, checked


def _slices(batches, centres, turn: Rotation):
    import numpy as np
    centres = np.array(centres, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            x = _matrix(part.column("x")).astype(np.int64)
            yield part, x, nearest(x, _matrix(part.column("lead")), part.column("rest").to_numpy(), centres, turn)


def moved(points: DataFrame, centres: list[list[int]], turn: Rotation) -> list[list[int]]:
    """The centroids after one round: floors of the means of their vectors; those without vectors stay."""
    def sums(batches):
        import numpy as np
        import pyarrow as pa
        held = np.zeros((len(centres), 1 + len(centres[0])), np.int64)  # counts, sums
        for _, x, (best, _, _) in _slices(batches, centres, turn):
            order = np.argsort(best, kind="stable")
            found, starts = np.unique(best[order], return_index=True)
            held[found, 1:] += np.add.reduceat(x[order], starts, axis=0)
            held[found, 0] += np.diff(np.append(starts, len(x)))
        used = np.flatnonzero(held[:, 0])
        if len(used):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()),
                                              "s": pa.array(list(held[used]), pa.list_(pa.int64()))})

    found = (points.select("x", "lead", "rest").mapInArrow(sums, "cluster int, s array<bigint>")
             .select("cluster", F.posexplode("s").alias("at", "s"))
             .groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())  # centroids x (1 + dims)
    total = {(r["cluster"], r["at"]): int(r["s"]) for r in found}
    return [[total[k, i + 1] // total[k, 0] for i in range(len(c))] if (k, 0) in total else c for k, c in enumerate(centres)]


def assigned(points: DataFrame, centres: list[list[int]], turn: Rotation) -> DataFrame:
    """``id, cluster, distance, checked`` of every stored vector."""
    def run(batches):
        import pyarrow as pa
        for part, _, (best, least, checked) in _slices(batches, centres, turn):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best, pa.int32()), pa.array(least, pa.int64()),
                                              pa.array(checked, pa.int32())], names=["id", "cluster", "distance", "checked"])

    return points.mapInArrow(run, "id bigint, cluster int, distance bigint, checked int")


@dataclass(frozen=True)
class Clustering:
    """``rows(id, cluster, distance, checked)``, the centroids in force and the inertia of each cluster."""

    rows: DataFrame
    centres: list[list[int]]
    inertia: list[int]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding",
            dims: int = DIMS, scale: int = SCALE, seed: int = SEED, share: float = SHARE) -> Clustering:
    points = scaled(vectors, id_col, vec_col, dims, scale)
    centres, turn = first_centroids(points, k, seed), rotation(points, share)
    if turn is None:
        none = points.sparkSession.createDataFrame([], "id bigint, cluster int, distance bigint, checked int")
        return Clustering(none, [], [])
    points = stored_points(points, turn)
    for _ in range(rounds):
        centres = moved(points, centres, turn)
    rows = materialise(assigned(points, centres, turn))
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    return Clustering(rows, centres, [inertia.get(c, 0) for c in range(len(centres))])


def _of_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("cluster") + 1)


def op11_pca_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centres]
    return found.rows.select(
        F.col("id").alias("vec_id"), "cluster", "distance", _of_cluster(found.inertia, "bigint").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("bigint").alias("inertia"), _of_cluster(names, "string").alias("centroid_sha256"))


def _sql() -> str:
    near = """{name} AS (SELECT row, vec_id, x, k, d FROM (
    SELECT p.row, p.vec_id, p.x, c.k, list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
      row_number() OVER (PARTITION BY p.row ORDER BY list_sum(list_transform(list_zip(p.x, c.y),
        lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.k) AS r
    FROM points p, {centres} c) q WHERE r = 1)"""
    move = """means{n} AS (SELECT k, list(m ORDER BY i) AS y FROM (
    SELECT k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM near{n}, (SELECT unnest(range(1, {dims} + 1)) AS i) places GROUP BY k, i) q GROUP BY k),
  centres{next} AS (SELECT c.k, coalesce(m.y, c.y) AS y FROM centres{n} c LEFT JOIN means{n} m ON m.k = c.k)"""
    ctes = [f"""points AS (SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda v: coalesce(isfinite(v), false))) = {DIMS})""",
            f"""centres0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS y FROM (
    SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM points ORDER BY h, x LIMIT {CENTROIDS}) q)"""]
    for n in range(ROUNDS):
        ctes += [near.format(name=f"near{n}", centres=f"centres{n}"), move.format(n=n, next=n + 1, dims=DIMS)]
    ctes.append(near.format(name="near", centres=f"centres{ROUNDS}"))
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(near.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.y, ',')) AS centroid_sha256
FROM near JOIN centres{ROUNDS} c ON c.k = near.k"""


OP11_SQL = _sql()
