"""Approximate nearest neighbours by inner product, with a permutation index.

A vector is represented by the order of its ``ORDER`` nearest pivots of ``PIVOTS``. It is posted in the inverted files
of its ``POSTED`` nearest pivots, and a query reads the files of its ``READ`` nearest. What a file holds is ranked by
Spearman's footrule between the permutations (pivots beyond the prefix count as one place past it); the best ``SHARE``
of each file is reranked by the exact inner product, and the best of all files together are the result.

Equal vectors are one entry: only the least ids of a group can be among the k nearest, so an entry carries those. Files
are cut into blocks of bounded size by a hash, and so are the queries of a file; a task takes one block of each.

Defined results: vectors that are null, zero, hold null or non-finite components, or differ in length from most take no
part, nor do rows with a null id; repeated rows (same id, same vector) count once; ties go to the smaller id; fewer
candidates than k give fewer results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

PIVOTS = 128  # vectors that the index is fitted on: a bounded sample
ORDER = 64
POSTED = 8
READ = 32
SHARE = 0.25
BLOCK = 2048
QUERY_EVERY = 20
K = 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = vectors[f"`{vector_col}`"].cast("array<double>")
    rows = vectors.select(vectors[f"`{id_col}`"].alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL")
    rows = rows.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                                 & F.exists("v", lambda x: x != 0), F.lit(False))).distinct()
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    most = sizes.first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(entry, v, ids): one row per distinct vector with its k + 1 least ids."""
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = F.sort_array(F.collect_list("vec_id"))  # at most k + 1 of them
    return least.groupBy("v").agg(F.min("vec_id").alias("entry"), ids.alias("ids"))


def pivots_of(found: DataFrame, pivots: int):
    """The pivots: the entries that come first by a hash of their id."""
    import numpy as np
    rows = found.select("entry", "v").orderBy(F.xxhash64("entry"), "entry").limit(pivots).collect()
    return np.array([r["v"] for r in rows], np.float64)


def permutations(vectors, pivots, order: int):
    """(places, nearest): the place of every pivot in each vector's order, ``order`` if beyond; and the order itself."""
    import numpy as np
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    centre = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    nearest = np.argsort(-(unit @ centre.T), axis=1, kind="stable")[:, :order]
    places = np.full((len(vectors), len(pivots)), order, np.uint8)
    np.put_along_axis(places, nearest, np.arange(nearest.shape[1], dtype=np.uint8)[None], axis=1)
    return places, nearest


def _post(found: DataFrame, pivots, order: int, files: int) -> DataFrame:
    """(pivot, entry, places, v) of every entry in its ``files`` nearest pivots' files."""
    kind = found.schema["entry"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("v").to_pylist(), np.float64)
            places, nearest = permutations(v, pivots, order)
            n = min(files, len(pivots))
            row = pa.array(np.repeat(np.arange(len(v)), n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nearest[:, :n].ravel().astype(np.int32)), batch.column("entry").take(row),
                 pa.array([p.tobytes() for p in places], pa.binary()).take(row),
                 pa.array([x.tobytes() for x in v], pa.binary()).take(row)], ["pivot", "entry", "places", "v"])

    return found.select("entry", "v").mapInArrow(run, f"pivot int, entry {kind}, places binary, v binary")


def _blocks(rows: DataFrame, sizes: dict[int, int], block: int, name: str) -> DataFrame:
    """Deal the rows of each file into blocks of about ``block`` rows; ``sizes`` has one entry per pivot."""
    number = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, -(-n // block))]) if sizes else F.lit(None)
    parts = F.coalesce(number[F.col("pivot")] if sizes else number, F.lit(1))
    return rows.withColumn(name, F.pmod(F.xxhash64("entry"), parts).cast("int")).withColumn(f"{name}s", parts.cast("int"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
           pivots: int = PIVOTS, order: int = ORDER, posted: int = POSTED, read: int = READ, share: float = SHARE,
           block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query id in ``queries(query_id)``.

    Queries are rows of ``vectors``; a query never finds itself.
    """
    if order > 255:
        raise ValueError("order must fit a byte")
    rows = materialise(usable(vectors, id_col, vector_col))
    found = materialise(entries(rows, k))
    asked = rows.join(queries.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id")
    asked = materialise(asked.join(found.select("v", "entry"), "v").select("vec_id", "entry", "v"))
    centre = pivots_of(found, pivots)
    files = materialise(_post(found, centre, order, posted))
    probes = materialise(_post(asked.groupBy("entry").agg(F.first("v").alias("v")), centre, order, read))
    count = {r["pivot"]: r["count"] for r in files.groupBy("pivot").count().collect()}  # a row per pivot
    asks = {r["pivot"]: r["count"] for r in probes.groupBy("pivot").count().collect()}
    files, probes = _blocks(files, count, block, "part"), _blocks(probes, asks, block, "ask")
    # every block of a file meets every block of the queries that read it
    files = files.withColumn("ask", F.explode(F.sequence(F.lit(0), F.coalesce(_lookup(asks, block), F.lit(1)) - 1)))
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(_lookup(count, block), F.lit(1)) - 1)))
    kind = found.schema["entry"].dataType.simpleString()
    take = k + 1

    def meet(key, left, right):
        import numpy as np
        import pyarrow as pa
        out_q, out_e, out_s = [], [], []
        if left.num_rows and right.num_rows:
            def matrix(t, name, dtype):
                return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype).reshape(t.num_rows, -1)
            places, v = matrix(left, "places", np.uint8), matrix(left, "v", np.float64)
            entry = left.column("entry").to_numpy()
            q_places, q_v = matrix(right, "places", np.uint8), matrix(right, "v", np.float64)
            q_entry = right.column("entry").to_numpy()
            best = min(len(v), max(4 * take, int(np.ceil(share * len(v)))))
            for i in range(len(q_v)):
                rule = (np.maximum(places, q_places[i]) - np.minimum(places, q_places[i])).sum(axis=1, dtype=np.int32)
                near = np.argpartition(rule, best - 1)[:best] if best < len(v) else np.arange(len(v))
                score = v[near] @ q_v[i]
                top = np.lexsort((entry[near], -score))[:take]
                out_q.append(np.full(len(top), q_entry[i]))
                out_e.append(entry[near][top])
                out_s.append(score[top])
        return pa.table({"q": np.concatenate([*out_q, np.empty(0, np.int64)]).astype(np.int64),
                         "entry": np.concatenate([*out_e, np.empty(0, np.int64)]).astype(np.int64),
                         "near": np.concatenate([*out_s, np.empty(0)])})

    met = (files.groupBy("pivot", "part", "ask").cogroup(probes.groupBy("pivot", "part", "ask"))
           .applyInArrow(meet, f"q {kind}, entry {kind}, near double")
           .groupBy("q", "entry").agg(F.max("near").alias("near")))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "entry")))
    best = best.where(F.col("r") <= take).select("q", "entry")
    hits = best.join(found.select("entry", F.col("v").alias("w"), "ids"), "entry")
    per_query = asked.select("vec_id", F.col("entry").alias("q"), "v").join(hits, "q")
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = (per_query.withColumn("score", dot).select(F.col("vec_id").alias("query_id"), "score",
                                                        F.explode("ids").alias("vec_id"))
              .where("vec_id != query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lookup(sizes: dict[int, int], block: int):
    if not sizes:
        return F.lit(None).cast("int")
    return F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, -(-n // block))])[F.col("pivot")]


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"))
    return search(vectors, queries)
