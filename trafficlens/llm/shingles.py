"""Near duplicates by the exact Jaccard similarity of word shingles.

A text is the set of its runs of ``WORDS`` words (lower-cased, parted by white space; a shorter text is one run). Two
texts are linked when their sets share at least ``ALIKE`` of their union. Texts of equal sets travel as one.

The search is by SimHash first: each set has the 64-bit fingerprint of its hashes, and ``simhash.similar_links`` finds
the fingerprints within ``BITS`` bits (segment popcounts, grid range join, exact distance). The sets behind them are
compared, and those that are alike form the first components.

At similarity 0.8 fingerprints differ in ten bits on average and in 17 at times, a radius at which unrelated texts meet
as well. Pairs beyond ``BITS`` are reached by MinHash: ``BANDS`` bands of ``ROWS`` minima each, and sets that agree in a
band meet in its cell. A pair of similarity 0.8 misses all cells with probability (1 - 0.8**5)**40, about one in eight
million, and a more similar pair more rarely.

Every member of a cell is compared with the cell's least member, unless SimHash has joined the two already. What is
linked then needs no more comparing; a cell whose members still lie in several components gets the sets of its members,
and all pairs across components are compared until they are joined or found unlike. A cell of more than ``CHUNK`` members is cut into chunks, whose pairs
are tasks of their own. No pair that meets is left out, and no pair is linked without comparing its sets.

Defined results: null and empty texts and texts without words have the same, empty set; a null id takes part and is
kept only if all ids of its group are null; repeated rows stay in one group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_key, word_hashes
from .components import components
from .simhash import keep_first, similar_links

WORDS = 5
BITS = 4  # radius of the SimHash search
ALIKE = (4, 5)  # 0.8, in whole numbers
BANDS = 40
ROWS = 5
CHUNK = 1024
_BASE = 0x9E3779B97F4A7C15
_STEP = 2048  # shingles whose minima are taken at once


def shingles(text: str | None, words: int = WORDS):
    """Sorted distinct hashes of the runs of ``words`` words, as int64."""
    import numpy as np
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.int64)
    known = word_hashes()
    found = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(found) - words + 1)
    rolled = np.full(n, min(len(tokens), words), np.uint64)
    for k in range(min(words, len(found))):
        rolled = (rolled ^ found[k:k + n]) * np.uint64(_BASE)
        rolled ^= rolled >> np.uint64(32)
    return np.unique(rolled.view(np.int64))


def fingerprint(found) -> int:
    """Unsigned SimHash of a set of hashes: bits set in more than half of them; zero for an empty set."""
    import numpy as np
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), _STEP):
        bits = np.unpackbits(found[at:at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(found), bitorder="little").view("<u8")[0])


def _multipliers():
    import numpy as np
    return np.random.default_rng(20).integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def cells(found, multipliers):
    """Cell of each band of a set that is not empty, as int64."""
    import numpy as np
    low = np.full(len(multipliers), np.uint64(2**64 - 1))
    for at in range(0, len(found), _STEP):
        low = np.minimum(low, (found[None, at:at + _STEP] * multipliers).min(axis=1))
    cell = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        cell = (cell ^ low[k::ROWS]) * np.uint64(_BASE)
        cell ^= cell >> np.uint64(32)
    return cell.view(np.int64)


def shingle_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k_text, fp, sim, cells) per row.

    ``fp`` names the set, ``sim`` is its SimHash fingerprint, ``cells`` is empty for an empty set.
    """
    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), row_key(text).alias("k_text"), text.alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest
        multipliers = _multipliers()
        for batch in batches:
            fp, sim, found = np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.uint64), []
            for k, t in enumerate(batch.column("text").to_pylist()):
                one = shingles(t)
                fp[k], sim[k] = xxh64_intdigest(one.tobytes()), fingerprint(one)
                found.append(cells(one.view(np.uint64), multipliers) if len(one) else one)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k_text"), pa.array(fp.view(np.int64)),
                                              pa.array(sim.view(np.int64)), pa.array(found, pa.list_(pa.int64()))],
                                             ["doc_id", "k_text", "fp", "sim", "cells"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, k_text bigint, fp bigint, sim bigint, cells array<bigint>")


def _sets(docs: DataFrame, prints: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, shingles) of the sets ``needed(fp)``, made again from one text of each."""
    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), row_key(text).alias("k_text"), text.alias("text"))
    one = prints.join(needed, "fp").groupBy("fp").agg(F.min(F.struct("doc_id", "k_text")).alias("of")).select(
        "fp", F.col("of.doc_id").alias("d"), F.col("of.k_text").alias("k"))
    texts = rows.join(one, rows["doc_id"].eqNullSafe(one["d"]) & (rows["k_text"] == one["k"])).select("fp", "text")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column("fp"), pa.array([shingles(t) for t in part.column("text").to_pylist()],
                                                 pa.list_(pa.int64()))], ["fp", "shingles"])

    return texts.mapInArrow(run, "fp bigint, shingles array<bigint>").dropDuplicates(["fp"])


def alike(one, other) -> bool:
    """Whether two sorted arrays of distinct values share at least ``ALIKE`` of their union."""
    import numpy as np
    small, large = sorted((one, other), key=len)
    if ALIKE[1] * len(small) < ALIKE[0] * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return ALIKE[1] * both >= ALIKE[0] * (len(small) + len(large) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike."""
    one = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("one"))
    other = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("other"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            one, other = batch.column("one"), batch.column("other")
            keep = [k for k in range(batch.num_rows) if alike(
                one[k].values.to_numpy(zero_copy_only=False), other[k].values.to_numpy(zero_copy_only=False))]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(run, "a bigint, b bigint")


def forest(sets, label, side=None):
    """Links that join all members of a cell that alike pairs connect, given what ``label`` already joins.

    Members of one label are never compared, and a pair across labels is compared once. With ``side`` (0 or 1 for each
    member) only pairs across the sides are compared.
    """
    import numpy as np
    label = np.asarray(label).copy()
    side = np.arange(len(sets)) if side is None else np.asarray(side)
    size = np.array([len(s) for s in sets])
    links = []
    for u in range(len(sets) - 1):
        for v in u + 1 + np.flatnonzero((label[u + 1:] != label[u]) & (side[u + 1:] != side[u])
                                        & (ALIKE[1] * np.minimum(size[u + 1:], size[u])
                                           >= ALIKE[0] * np.maximum(size[u + 1:], size[u]))):
            if label[v] != label[u] and alike(sets[u], sets[v]):
                label[label == label[v]] = label[u]
                links.append((u, int(v)))
    return links


def _cell_links(members: DataFrame, two_sides: bool) -> DataFrame:
    """Links (a, b) inside each cell of ``members(cell, fp, label, side, shingles)``; one cell at a time is in memory."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        held: list = []

        def settle():
            links = forest([h[3] for h in held], [h[1] for h in held], [h[2] for h in held] if two_sides else None)
            a, b = [held[u][0] for u, _ in links], [held[v][0] for _, v in links]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        now = None
        for batch in batches:
            cell, fp, label, side = (batch.column(c).to_pylist() for c in ("cell", "fp", "label", "side"))
            column = batch.column("shingles")
            for k in range(batch.num_rows):
                if cell[k] != now and held:
                    yield settle()
                    held = []
                now = cell[k]
                held.append((fp[k], label[k], side[k], np.array(column[k].values.to_numpy(zero_copy_only=False))))
        if held:
            yield settle()

    rows = members.select("cell", "fp", "label", "side", "shingles")
    return rows.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "a bigint, b bigint")


def close_pairs(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints connect within ``bits`` bits; they are not compared yet.

    Of the sets with one fingerprint, the least stands for it in links to other fingerprints.
    """
    named = prints.select("fp", "sim").distinct()
    least = materialise(named.groupBy("sim").agg(F.min("fp").alias("a")))
    links = similar_links(least.select(F.col("sim").alias("fp")), bits)
    one = least.select(F.col("sim").alias("x"), "a")
    other = least.select(F.col("sim").alias("y"), F.col("a").alias("b"))
    across = links.toDF("x", "y").join(one, "x").join(other, "y").select("a", "b")
    return across.unionByName(named.join(least, "sim").where("fp != a").select("a", F.col("fp").alias("b")))


def alike_links(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all sets of ``prints`` that are alike; every listed pair is alike."""
    # Cells are read from the prints each time: as a table of their own they would be 40 times as many rows and files.
    cell = prints.groupBy("fp").agg(F.first("cells").alias("cells")).select("fp", F.explode("cells").alias("cell"))
    known = cell.groupBy("cell").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n"),
                                     F.bit_xor(F.xxhash64("fp")).alias("who")).where("n > 1")
    # Bands in which the same sets meet give the same pairs.
    known = known.groupBy("a", "n", "who").agg(F.min("cell").alias("cell"))
    met = materialise(cell.join(known.select("cell", "a", "n"), "cell"))
    close = materialise(close_pairs(prints))
    needed = met.select("fp").unionByName(close.select(F.col("a").alias("fp"))).unionByName(
        close.select(F.col("b").alias("fp"))).distinct()
    sets = materialise(_sets(docs, prints, needed, id_col, text_col))
    near = materialise(_verified(close, sets))
    joined = components(near)
    one, other = joined.toDF("a", "one"), joined.toDF("b", "other")
    far = (met.where("fp != a").select("a", F.col("fp").alias("b")).distinct().join(one, "a", "left")
           .join(other, "b", "left").where(F.coalesce("one", "a") != F.coalesce("other", "b")).select("a", "b"))
    links = near.unionByName(materialise(_verified(far, sets)))
    roots = components(links)
    placed = met.where("n > 2").join(roots, met["fp"] == roots["node"], "left").select(
        "cell", "fp", "n", F.coalesce("root", "fp").alias("label"))
    apart = placed.groupBy("cell").agg((F.min("label") != F.max("label")).alias("apart")).where("apart").select("cell")
    rest = materialise(placed.join(apart, "cell"))
    if rest.isEmpty():
        return links
    whole = rest.where(F.col("n") <= chunk).withColumn("side", F.lit(0))
    links = links.unionByName(_cell_links(whole.join(sets, "fp"), False))
    crowded = rest.where(F.col("n") > chunk)
    if crowded.isEmpty():
        return links
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.ceil(F.col("n") / F.lit(chunk)))
    pairs = (crowded.withColumn("chunk", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.lit(chunk)) - 1)))
             .select(F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), "fp",
                     "label", F.when(F.col("chunk") == F.col("other"), 0).otherwise(1).alias("two"),
                     (F.col("chunk") > F.col("other")).cast("int").alias("side")))
    links = links.unionByName(_cell_links(pairs.where("two = 0").join(sets, "fp"), False))
    return links.unionByName(_cell_links(pairs.where("two = 1").join(sets, "fp"), True))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, k_text, fp, component_id) per row. Writes prints, sets that meet and links to the shared folder when called."""
    prints = materialise(shingle_prints(docs, id_col, text_col))
    roots = components(alike_links(docs, prints, id_col, text_col, chunk)).withColumnRenamed("node", "fp")
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    placed = low.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(placed.join(ids, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "k_text", "fp", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each group: that of the smallest id, among equal ids that of the smallest text key."""
    return keep_first(docs, similar_groups(docs, id_col, text_col), id_col, text_col)
