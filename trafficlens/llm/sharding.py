"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's virtual slot is a hash of its id over a fixed number of slots, so it never changes. Bytes are summed per
slot, and a small map (one row per slot and version) says which shard holds a slot. Rebalancing writes a new version of
the map that differs from the last in the moved slots only. All work on records is done by DataFrame functions; the map
has a fixed number of entries whatever the input, and is edited on the driver.

Defined results: a null text counts as empty; a null id is a value like any other; repeated rows are separate rows;
an empty table gives an empty result and a map whose slots weigh nothing.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table

SLOTS = 4096
SHARDS = 24
OVERHEAD = 8  # bytes of a record besides its text


@dataclass(frozen=True)
class ShardMap:
    """Shard of each slot, by version; the last version is the one in force."""

    versions: tuple[tuple[int, ...], ...]
    shards: int

    @property
    def current(self) -> tuple[int, ...]:
        return self.versions[-1]

    def moved(self) -> int:
        """Slots that the last edit moved."""
        return sum(a != b for a, b in zip(*self.versions[-2:])) if len(self.versions) > 1 else 0


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key, key.isNull()), F.lit(slots)).cast("int")


def initial_map(shards: int = SHARDS, slots: int = SLOTS) -> ShardMap:
    """Slots dealt in turn: knows nothing of the data."""
    return ShardMap((tuple(s % shards for s in range(slots)),), shards)


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot of ``records(vslot, size)``."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def rebalance(old: ShardMap, sizes: dict[int, int], shards: int | None = None) -> ShardMap:
    """A further version whose shards are near equal in bytes, for the same or another number of shards.

    Slots of shards that no longer exist are dealt out first, largest to the emptiest shard. Then the fullest shard
    gives a slot to the emptiest, or swaps one with it, as long as that narrows the gap between the two.
    """
    n = shards or old.shards
    place = list(old.current)
    load = [0] * n
    held: list[set[int]] = [set() for _ in range(n)]
    homeless = []
    for slot, shard in enumerate(place):
        if shard < n:
            load[shard] += sizes.get(slot, 0)
            held[shard].add(slot)
        else:
            homeless.append(slot)
    heap = [(load[s], s) for s in range(n)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda s: (-sizes.get(s, 0), s)):
        _, s = heapq.heappop(heap)
        place[slot] = s
        held[s].add(slot)
        load[s] += sizes.get(slot, 0)
        heapq.heappush(heap, (load[s], s))

    def move(slot: int, a: int, b: int) -> None:
        held[a].remove(slot)
        held[b].add(slot)
        load[a] -= sizes.get(slot, 0)
        load[b] += sizes.get(slot, 0)
        place[slot] = b

    for _ in range(4 * len(place)):
        order = sorted(range(n), key=lambda s: (load[s], s))
        low, high = order[0], order[-1]
        gap = load[high] - load[low]
        wanted = gap / 2
        best, give, take = abs(wanted), None, None
        for slot in sorted(held[high]):
            size = sizes.get(slot, 0)
            if size and abs(wanted - size) < best:
                best, give = abs(wanted - size), slot
        if give is None and gap > 1:  # no single slot fits: look for a swap
            theirs = sorted((sizes.get(s, 0), s) for s in held[low])
            for slot in sorted(held[high]):
                size = sizes.get(slot, 0)
                at = _nearest(theirs, size - wanted)
                if at is not None and size > theirs[at][0] and abs(wanted - (size - theirs[at][0])) < best:
                    best, give, take = abs(wanted - (size - theirs[at][0])), slot, theirs[at][1]
        if give is None:
            break
        move(give, high, low)
        if take is not None:
            move(take, low, high)
    return ShardMap((*old.versions, tuple(place)), n)


def _nearest(pairs: list[tuple[int, int]], value: float) -> int | None:
    from bisect import bisect_left
    at = bisect_left(pairs, (value, -1))
    near = [i for i in (at - 1, at) if 0 <= i < len(pairs)]
    return min(near, key=lambda i: abs(pairs[i][0] - value), default=None)


def map_table(spark: SparkSession, shard_map: ShardMap, sizes: dict[int, int] | None = None) -> DataFrame:
    """The map as rows (version, slot, shard); with the weights of the last version when they are given."""
    versions = F.from_json(F.lit(json.dumps(shard_map.versions)), "array<array<int>>")
    weights = F.from_json(F.lit(json.dumps({str(k): v for k, v in (sizes or {}).items()})), "map<string,bigint>")
    one = spark.range(1).select(F.posexplode(versions).alias("at", "places"))
    rows = one.select((F.col("at") + 1).alias("version"), F.posexplode("places").alias("slot", "shard"))
    return rows.withColumn("slot_bytes", F.coalesce(F.element_at(weights, F.col("slot").cast("string")), F.lit(0)))


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of each record."""
    doc, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    return docs.select(doc.alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"),
                       F.crc32(raw).alias("text_crc32"), virtual_slot(doc, slots).alias("vslot"))


def shard_records(records: DataFrame, shard_map: ShardMap, rows: dict[int, int]) -> DataFrame:
    """Add the shard in force and ``slot``, the gapless place within the shard.

    The place is the rows of the shard's earlier virtual slots plus the rank within the own virtual slot, so no task
    orders a whole shard.
    """
    offset, place = [0] * len(shard_map.current), [0] * shard_map.shards
    for v, shard in enumerate(shard_map.current):
        offset[v] = place[shard]
        place[shard] += rows.get(v, 0)
    at = F.col("vslot") + 1
    shard = F.element_at(F.from_json(F.lit(json.dumps(shard_map.current)), "array<int>"), at)
    before = F.element_at(F.from_json(F.lit(json.dumps(offset)), "array<bigint>"), at)
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("shard", shard).withColumn("slot", (before + rank - 1).cast("bigint"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id",
                    text_col: str = "text", old: ShardMap | None = None) -> tuple[DataFrame, ShardMap, str]:
    """Records with their shards, the map in force, and the folder that holds the map as a table.

    ``old`` is the map of an earlier run: only the slots that balance needs are moved. Runs one job that sizes the
    slots and one that writes the map.
    """
    spark = docs.sparkSession
    records = materialise(records_of(docs, id_col, text_col, slots))
    weights = slot_sizes(records).collect()  # at most one row per virtual slot, whatever the input
    sizes, rows = {r["vslot"]: r["bytes"] for r in weights}, {r["vslot"]: r["rows"] for r in weights}
    shard_map = rebalance(old or initial_map(shards, slots), sizes, shards)
    path = f"{shared_dir(spark)}/shard-map"
    map_table(spark, shard_map, sizes).write.parquet(path)
    return shard_records(records, shard_map, rows), shard_map, path


def write_shards(docs: DataFrame, shard_map: ShardMap, path: str, id_col: str = "doc_id") -> None:
    """Write whole documents under ``shard=N`` folders; a shard is written by as many tasks as its size asks for."""
    name = "shard"
    if name in {c.lower() for c in docs.columns}:
        raise ValueError("the documents have a column named shard already")
    at = virtual_slot(docs[f"`{id_col}`"], len(shard_map.current)) + 1
    places = F.from_json(F.lit(json.dumps(shard_map.current)), "array<int>")
    docs.withColumn(name, F.element_at(places, at)).hint("rebalance", F.col(name)).write.partitionBy(name).parquet(path)


def op8_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "vslot")
