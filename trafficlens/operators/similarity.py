"""Similarity cache: for each prompt vector the most similar earlier one, if similar enough.

An exact metric range join. The angle between vectors is a metric, so with the angles to a set of pivots the triangle
inequality says which vectors can be within ``arccos(threshold)`` of each other:

* a vector lives in the cell of its nearest pivot, and in the ring of that cell that its angle to the pivot falls in;
* a vector whose angle to a pivot exceeds that to its own by more than twice the radius has no neighbour in that cell;
* in the other cells its neighbours lie in rings within the radius of its own angle.

Rings of neighbouring pivots make up at most ``BLOCKS`` blocks. Each vector is sent once to every block with a ring that
may hold an earlier neighbour, so even where nothing can be ruled out (a loose threshold, or unlike vectors in many
dimensions) it travels ``BLOCKS`` times at most, however many vectors there are. The vectors that look into a block are
dealt to at most ``ASKERS`` tasks, each of which gets the block; more only where a part would exceed ``CELL`` vectors, as
would a block: then every pair of parts is a task of its own; nothing is left out. Inside a task a matrix product finds
candidates, whose cosine is then summed in a fixed order and rounded to nine decimals, so that the result does not depend
on how the rows were dealt out.

Copies of one vector are reduced to the earliest before anything is compared: the best match of a later copy is that
one, or an even earlier vector that is just as similar.

Vectors that are null, zero, hold null or non-finite components or have another number of components take no part, nor
do rows without an id. Rows are compared within equal ``keys`` only, where null equals null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.archive import materialise

THRESHOLD = 0.94
CELL = 65536         # vectors of one chunk
SMALL = 2048         # fewer vectors are not dealt to several tasks
ASKERS = 16          # tasks of those that look into one block
BLOCKS = 8           # groups of pivots
PER_PIVOT = 2048     # vectors for each pivot
MOST_PIVOTS = 1024   # pivots travel with the tasks
DIGITS = 9
_SLACK = 1e-6        # radians; far above the rounding error of an angle
_SLICE = 512
_WIDE = 8192         # stored vectors of one product
_ROUGH = 2e-5        # far above the rounding error of a product of unit vectors in single precision
_PLACE = ["key", "block"]


def _units(column):
    """Rows of a list column as unit vectors."""
    import numpy as np
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _usable(vector: Column, dims: int) -> Column:
    finite = ~F.exists(vector, lambda c: F.coalesce(~(F.abs(c) < F.lit(float("inf"))), F.lit(True)))
    return (F.size(vector) == dims) & finite & F.exists(vector, lambda c: c != 0)


def _classes(rows: DataFrame) -> DataFrame:
    """``cls, key, v, first`` of the distinct vectors: a number, and the earliest id."""
    return materialise(rows.groupBy("key", "v").agg(F.min("id").alias("first"))
                       .withColumn("cls", F.monotonically_increasing_id()))


def _pivots(classes: DataFrame, per_pivot: int):
    import numpy as np
    wanted = min(MOST_PIVOTS, math.ceil(classes.count() / per_pivot))
    drawn = classes.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h", "v").limit(wanted).collect()
    x = np.array([r["v"] for r in drawn], np.float64)
    if not len(x):
        return x
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return x[np.argsort(-(x @ x[0]), kind="stable")]  # numbered so that blocks hold neighbours


def _homes(classes: DataFrame, pivots, width: float) -> DataFrame:
    """Add ``cell``, ``angle`` (to the cell's pivot), ``ring`` and ``block`` (of cells)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                angles = np.arccos(np.clip(_units(part.column("v")) @ pivots.T, -1, 1))
                cell = angles.argmin(axis=1)
                angle = angles[np.arange(len(cell)), cell]
                ring = np.floor(angle / width)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell, pa.int32()), pa.array(angle), pa.array(ring, pa.int32()),
                     pa.array(_block_of(cell, len(pivots)), pa.int32())],
                    names=[*part.schema.names, "cell", "angle", "ring", "block"])

    fields = "key string, v array<double>, first bigint, cls bigint, cell int, angle double, ring int, block int"
    return materialise(classes.select("key", "v", "first", "cls").mapInArrow(run, fields))


def _block_of(cell, pivots: int):
    return cell * min(BLOCKS, pivots) // max(pivots, 1)


def _visits(homes: DataFrame, pivots, radius: float, width: float, rings: list[tuple[int, float, float]]) -> DataFrame:
    """``key, cls, first, block``: the blocks in which a vector may find a neighbour.

    ``rings`` lists the cell and the least and greatest angle of all rings (of ``width``) that hold a vector.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        cells, at = np.unique(np.array([r[0] for r in rings], np.int64), return_inverse=True)
        inner, outer = (np.array([r[k] for r in rings]) for k in (1, 2))
        block = _block_of(cells[at], len(pivots))
        order = np.argsort(block, kind="stable")
        inner, outer, at = inner[order], outer[order], at[order]
        blocks, starts = np.unique(block[order], return_index=True)
        near = radius + _SLACK
        for batch in batches:
            for lo in range(0, batch.num_rows, _SLICE):
                part = batch.slice(lo, _SLICE)
                angles = np.arccos(np.clip(_units(part.column("v")) @ pivots[cells].T, -1, 1))
                own = np.asarray(part.column("angle"))[:, None]
                met = np.where(angles - own <= 2 * near, angles, np.inf)[:, at]
                meets = (met - near <= outer) & (met + near >= inner)  # a ring is [inner, outer] away from its pivot
                row, col = np.nonzero(np.logical_or.reduceat(meets, starts, axis=1))
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n).take(taken) for n in ("key", "cls", "first")] + [pa.array(blocks[col], pa.int32())],
                    names=["key", "cls", "first", "block"])

    return homes.select("key", "cls", "first", "v", "angle").mapInArrow(
        run, "key string, cls bigint, first bigint, block int")


def _compare(threshold: float):
    schema = "cls bigint, match_id bigint, similarity double"

    def run(asking, held):
        import numpy as np
        import pyarrow as pa
        found = [[], [], []]
        held, asking = held.sort_by("first"), asking.sort_by("first")
        stored, ids = _units(held.column("v")), np.asarray(held.column("first"))
        rough = stored.astype(np.float32)
        for at in range(0, asking.num_rows, _SLICE):
            part = asking.slice(at, _SLICE)
            x, own = _units(part.column("v")), np.asarray(part.column("first"))
            best, kept = np.full(len(x), threshold), []
            earlier = np.searchsorted(ids, own)
            for lo in range(0, earlier.max(), _WIDE):  # only what is earlier than some row of the slice
                hi = min(lo + _WIDE, earlier.max())
                scores = x.astype(np.float32) @ rough[lo:hi].T
                if earlier[0] < hi:
                    scores[np.arange(lo, hi)[None, :] >= earlier[:, None]] = -2
                best = np.maximum(best, scores.max(axis=1))
                # more than the rounding of the products; the exact sums decide
                i, j = np.nonzero(scores >= (best - 2 * _ROUGH).astype(np.float32)[:, None])
                kept.append((i, j + lo, scores[i, j]))
            if not kept:
                continue
            i, j, score = (np.concatenate(k) for k in zip(*kept))
            near = score >= best[i] - 2 * _ROUGH
            i, j = i[near], j[near]
            exact = np.round((x[i] * stored[j]).sum(axis=1), DIGITS)
            order = np.lexsort((ids[j], -exact, i))
            order = order[exact[order] >= threshold]
            i, first = np.unique(i[order], return_index=True)
            found[0].append(np.asarray(part.column("cls"))[i])
            found[1].append(ids[j[order][first]])
            found[2].append(exact[order][first])
        columns = [np.concatenate(f) if f else np.empty(0) for f in found]
        return pa.table({"cls": pa.array(columns[0], pa.int64()), "match_id": pa.array(columns[1], pa.int64()),
                         "similarity": pa.array(columns[2], pa.float64())})

    return run, schema


def _chunks(count: str, size: int) -> Column:
    return F.ceil(F.col(count) / F.lit(size)).cast("int")


def _best(homes: DataFrame, visits: DataFrame, threshold: float, cell: int) -> DataFrame:
    """``cls, match_id, similarity``: the best earlier match of each distinct vector."""
    held = homes.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n_held"), F.min("first").alias("earliest"))
    visits = materialise(visits.join(held, _PLACE).where(F.col("earliest") < F.col("first")).select("cls", *_PLACE))
    sizes = visits.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n_asking")).join(held, _PLACE).select(
        *_PLACE, F.greatest(F.least(_chunks("n_asking", min(SMALL, cell)), F.lit(ASKERS)), _chunks("n_asking", cell)).alias("askers"),
        _chunks("n_held", cell).alias("holders"))
    spread = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = (visits.join(homes.select("cls", "first", "v"), "cls").join(sizes, _PLACE)
              .select(*_PLACE, spread("askers").alias("a"), every("holders").alias("b"), "cls", "first", "v"))
    holding = (homes.join(sizes, _PLACE)
               .select(*_PLACE, every("askers").alias("a"), spread("holders").alias("b"), "first", "v"))
    holding = holding.select(*[F.col(c).alias(c) for c in holding.columns])  # both sides come from one table
    by = [*_PLACE, "a", "b"]
    met = asking.groupBy(*by).cogroup(holding.groupBy(*by)).applyInArrow(*_compare(threshold))
    return met.groupBy("cls").agg(F.max(F.struct("similarity", (-F.col("match_id")).alias("later"))).alias("best")).select(
        "cls", (-F.col("best.later")).alias("match_id"), "best.similarity")


def semantic_match(vectors: DataFrame, threshold: float = THRESHOLD, keys: Sequence[str] = ("provider", "model"),
                   id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, dry_run: bool = False,
                   cell: int = CELL, per_pivot: int = PER_PIVOT) -> DataFrame:
    """``<id>, match_id, similarity, served``: the match of every row that has one.

    A match has a smaller id, the same ``keys`` and a cosine of at least ``threshold``; the greatest cosine wins, then the
    smallest id. ``served`` is 1, or 0 in a dry run, which reports matches but answers nothing with them.
    """
    v = F.transform(vectors[f"`{vec_col}`"], lambda c: c.cast("double"))
    key = F.to_json(F.struct(*[vectors[f"`{k}`"].alias(f"k{n}") for n, k in enumerate(keys)])) if keys else F.lit("")
    rows = vectors.select(vectors[f"`{id_col}`"].cast("bigint").alias("id"), key.alias("key"),
                          F.when(_usable(v, dims), v).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    radius = math.acos(min(1.0, max(-1.0, threshold)))
    width = max(radius, 0.05)
    classes = _classes(rows)
    pivots = _pivots(classes, per_pivot)
    homes = _homes(classes, pivots, width)
    # a few rows a pivot
    rings = homes.groupBy("cell", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    visits = _visits(homes, pivots, radius, width, [(r["cell"], r["low"], r["high"]) for r in rings])
    best = _best(homes, visits, threshold, cell)
    placed = rows.join(classes, ["key", "v"]).select("id", "cls", "first").join(best, "cls", "left")
    copy = F.col("id") > F.col("first")
    own = copy & ~F.coalesce(F.col("similarity") >= 1, F.lit(False))
    return placed.select(F.col("id").alias(id_col), F.when(own, F.col("first")).otherwise(F.col("match_id")).alias("match_id"),
                         F.when(own, F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"),
                         F.lit(0 if dry_run else 1).cast("bigint").alias("served")).where("match_id IS NOT NULL")


def semantic_events(matches: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Audit events of matches: ``<id>, action, detail``; a match of a dry run is told apart."""
    action = F.when(F.col("served") == 1, "semantic_hit").otherwise("semantic_dry_run")
    return matches.select(id_col, action.alias("action"), F.to_json(F.struct("match_id", "similarity")).alias("detail"))
