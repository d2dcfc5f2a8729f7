"""Near duplicates by SimHash fingerprints, found in a segment-popcount embedding.

A 64-bit fingerprint is embedded as 32 counts of set bits, one per segment of two bits. The Manhattan distance of two
embeddings never exceeds the number of differing bits, so it is a lower bound to search by. The bound is shared by two
halves of 16 counts: fingerprints within ``bits`` have a half within ``bits // 2`` of each other. A half is a cell of an
integer grid; every fingerprint posts the cells around its own to half that radius, so any two halves in reach meet in
a cell. What meets is verified on the fingerprints themselves.

Only connectivity matters for groups, so a cell yields a spanning forest of its links, never all pairs. Cells are
streamed in sorted order; a cell with more than ``chunk`` fingerprints is cut into chunks, whose pairs are further
tasks of bounded size. Documents with equal fingerprints travel as one.

Defined results: a null or empty text, or one without words, has fingerprint zero; a null id takes part and never
names a component unless all ids of the component are null; repeated rows stay, in one component; an empty table
gives an empty result. Other columns of the input are ignored by ``near_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, table
from .components import components

WORDS = 4
BITS = 4
CHUNK = 4096
_PAIRS = 0x5555555555555555
_STEP = 1 << 15  # shingles whose bits are counted at once


def fingerprint(raw: bytes | None, words: int = WORDS) -> int:
    """Unsigned SimHash of a UTF-8 text: bits set in more than half of the shingle hashes (XXH64, seed 42)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    tokens = raw.lower().split() if raw else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1:].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), _STEP):
        hashes = np.array([xxh64_intdigest(joined[s:e], 42)
                           for s, e in zip(starts[at:at + _STEP], ends[at:at + _STEP])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, k_text, fp) per row; ``fp`` is the fingerprint as a signed long, ``k_text`` tells texts apart."""
    from .common import row_key
    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), row_key(text).alias("k_text"), text.alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(r, words) for r in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k_text"), pa.array(fp)],
                                             ["doc_id", "k_text", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, k_text bigint, fp bigint")


def popcounts(fp):
    """Embedding of unsigned fingerprints: 32 two-bit fields, each the number of set bits of its segment (0 to 2)."""
    import numpy as np
    return fp - ((fp >> np.uint64(1)) & np.uint64(_PAIRS))


def _posted(half, radius: int):
    """Cells within ``radius`` of each half-embedding: (index of the fingerprint, cell)."""
    import numpy as np
    index, cell = np.arange(len(half)), half
    for _ in range(radius):
        more_index, more_cell = [index], [cell]
        for j in range(16):
            unit = np.uint64(1 << (2 * j))
            count = (cell >> np.uint64(2 * j)) & np.uint64(3)
            for keep, near in ((count < 2, cell + unit), (count > 0, cell - unit)):
                more_index.append(index[keep])
                more_cell.append(near[keep])
        index, cell = np.concatenate(more_index), np.concatenate(more_cell)
        if radius > 1:
            _, first = np.unique(np.stack([index.astype(np.uint64), cell]), axis=1, return_index=True)
            index, cell = index[first], cell[first]
    return index, cell


def _postings(distinct: DataFrame, bits: int) -> DataFrame:
    radius = (bits // 2 + 1) // 2

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            counts = popcounts(signed.view(np.uint64))
            for at in range(0, len(signed), 2048):
                part = counts[at:at + 2048]
                for side in (0, 1):
                    half = (part >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
                    index, cell = _posted(half, radius)
                    cell = (cell | np.uint64(side << 32)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(signed[at:at + 2048][index])],
                                                     ["cell", "fp"])

    return distinct.select("fp").mapInArrow(run, "cell bigint, fp bigint")


def forest(fp, bits: int):
    """Spanning links of fingerprints of one cell: grows each tree from its first member until nothing is left.

    Every step compares one member with those that no tree has yet, so a tight group costs about one comparison a
    member.
    """
    import numpy as np
    left = np.arange(len(fp))
    links = []
    limit = np.uint8(bits)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            u = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[u]) <= limit
            if near.any():
                new = left[near]
                links.append(np.stack([fp[new], np.full(len(new), fp[u])]))
                front.extend(new.tolist())
                left = left[~near]
    return np.concatenate(links, axis=1) if links else np.empty((2, 0), np.uint64)


def _short_links(cell, fp, bits: int, most: int):
    """All verified links inside runs of equal cells, each run of at most ``most`` rows."""
    import numpy as np
    links = []
    for k in range(1, most):
        same = np.flatnonzero(cell[k:] == cell[:-k])
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + k]) <= bits]
        if len(near):
            links.append(np.stack([fp[near], fp[near + k]]))
    return np.concatenate(links, axis=1) if links else np.empty((2, 0), np.uint64)


def _reduced(links):
    """The same connectivity with one link per fingerprint: everything hangs on the least label it reaches."""
    import numpy as np
    names, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(links.shape)
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(names))
    return np.stack([names[keep], names[label[keep]]])


_SHORT = 24
_LINKS = "kind int, a bigint, b bigint, chunk int"  # kind 0: link a-b; kind 1: fingerprint a in a chunk of cell b


def _linked(postings: DataFrame, bits: int, chunk: int | None) -> DataFrame:
    """Links within each cell; rows of cells above ``chunk`` rows come out as well, numbered by chunk."""

    def rows(links):
        import numpy as np
        import pyarrow as pa
        n = links.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), pa.array(links[0].view(np.int64)), pa.array(links[1].view(np.int64)),
             pa.array(np.zeros(n, np.int32))], ["kind", "a", "b", "chunk"])

    def spill(cell, fp, number):
        import numpy as np
        import pyarrow as pa
        n = len(fp)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), pa.array(fp.view(np.int64)), pa.array(np.full(n, cell)),
             pa.array(np.full(n, number, np.int32))], ["kind", "a", "b", "chunk"])

    def run(batches):
        import numpy as np
        cell, fp, number = np.empty(0, np.int64), np.empty(0, np.uint64), 0

        def settle(cell, fp):
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            small = np.repeat(sizes <= _SHORT, sizes)
            found = [_short_links(cell[small], fp[small], bits, _SHORT)]
            found += [forest(fp[s:s + n], bits) for s, n in zip(starts, sizes) if n > _SHORT]
            return _reduced(np.concatenate(found, axis=1))

        for batch in batches:
            cell = np.r_[cell, batch.column("cell").to_numpy(zero_copy_only=False)]
            fp = np.r_[fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(cell):
                continue
            while chunk and len(cell) > chunk and cell[0] == cell[chunk]:  # a cell that fills more than a chunk
                yield rows(forest(fp[:chunk], bits))
                yield spill(cell[0], fp[:chunk], number)
                cell, fp, number = cell[chunk:], fp[chunk:], number + 1
            if number and len(cell) and cell[0] != cell[-1]:  # the rest of such a cell
                end = int(np.searchsorted(cell, cell[0], side="right"))
                yield rows(forest(fp[:end], bits))
                yield spill(cell[0], fp[:end], number)
                cell, fp, number = cell[end:], fp[end:], 0
            last = int(np.searchsorted(cell, cell[-1], side="left"))  # the last cell may go on in the next batch
            if last and not number:
                links = settle(cell[:last], fp[:last])
                if links.shape[1]:
                    yield rows(links)
                cell, fp = cell[last:], fp[last:]
        while chunk and len(cell) > chunk and cell[0] == cell[chunk]:
            yield rows(forest(fp[:chunk], bits))
            yield spill(cell[0], fp[:chunk], number)
            cell, fp, number = cell[chunk:], fp[chunk:], number + 1
        if len(cell):
            if number:
                yield spill(cell[0], fp, number)
            yield rows(settle(cell, fp))

    return postings.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, _LINKS)


def similar_links(distinct: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``bits`` differing bits of each other.

    ``distinct(fp)`` holds distinct fingerprints. Not every close pair is listed, but both ends of each are connected
    by listed pairs, and every listed pair is close.
    """
    found = materialise(_linked(_postings(distinct, bits), bits, chunk))
    links = found.where("kind = 0").select("a", "b")
    crowded = found.where("kind = 1").select(F.col("b").alias("at"), F.col("a").alias("fp"), "chunk")
    if crowded.isEmpty():
        return links
    chunks = crowded.groupBy("at").agg((F.max("chunk") + 1).alias("n"))
    pairs = (crowded.join(chunks, "at").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .where("other != chunk")
             .select(F.xxhash64("at", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), "fp"))
    return links.unionByName(_linked(pairs, bits, None).select("a", "b"))


def groups(prints: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """(fp, component_id): the smallest id of the component, for every distinct fingerprint of ``prints(doc_id, fp)``."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(similar_links(distinct, bits, chunk)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return placed.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, k_text, fp, component_id) per row. Writes fingerprints and links to the shared folder when called."""
    if not 0 <= bits <= 7:
        raise ValueError("bits must be between 0 and 7")
    prints = materialise(fingerprints(docs, id_col, text_col, words))
    return prints.join(groups(prints, bits, chunk), "fp").select("doc_id", "k_text", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                         bits: int = BITS) -> DataFrame:
    """Keep one row of each group: that of the smallest id, among equal ids that of the smallest text key."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col, words, bits), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each group of ``found(doc_id, k_text, component_id)``: smallest id, then smallest text key."""
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(
        F.min("k_text").alias("k_text"), F.count(F.lit(1)).alias("rows"))
    names = docs.columns
    k_id, k_text, rows = (fresh(names, n) for n in ("_keep_id", "_keep_text", "_keep_rows"))
    keys = first.select(F.col("component_id").alias(k_id), F.col("k_text").alias(k_text), F.col("rows").alias(rows))
    from .common import row_key
    joined = docs.join(keys, docs[f"`{id_col}`"].eqNullSafe(keys[k_id])
                       & (row_key(docs[f"`{text_col}`"]) == keys[k_text]))
    single = joined.where(F.col(rows) == 1).drop(k_id, k_text, rows)
    several = joined.where(F.col(rows) > 1).dropDuplicates([k_id, k_text]).drop(k_id, k_text, rows)
    return single.unionByName(several)


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
