"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words (lower-cased, without punctuation around them; single characters of scripts without
spaces), hashed to 64 bits. Every run of ``MATCH`` words of a benchmark item is a seed; of a shorter item, all its words. A fixed-size bitmap of the seeds travels to the tasks that read the
documents; a document whose runs hit it keeps just the words of those runs. The hits are then joined with the seed
table, which sorts out false hits and pairs documents with items. For each pair, greedy string tiling marks the longest
common matches first, never overlapping, finding matches of a length by Karp-Rabin hashes, down to ``MATCH`` words.
An item is leaked into a document when its tiles cover ``COVERAGE`` of its words, in whatever order they stand.

Defined results: null and empty texts leak nothing; an item of fewer than ``MATCH`` words is found where it stands
whole, and one without words is not; items with a null id are left out; repeated rows of documents or items give one row per distinct pair and text;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Lookup, fresh, kept_by, materialise, row_key, table, words_in

MATCH = 5
COVERAGE = 0.6
MAP_BITS = 1 << 24  # size of the seed bitmap; a larger benchmark only means more false hits to join away
_BASE = 0x9E3779B97F4A7C15


def _word_hash(chunk: str) -> int:
    from xxhash import xxh64_intdigest
    word = chunk.lower().strip("\"'`.,;:!?()[]{}<>|*#$%&_-–—…“”‘’«»¿¡/\\=+~^@")
    return xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1 if word else 0


def words_of(text: str | None):
    """Hash of each word, as uint64; chunks of punctuation alone are no words."""
    import numpy as np
    chunks = words_in(text) if text else []
    known = kept_by("tiling", "hashes", lambda: Lookup(_word_hash))
    found = np.fromiter(map(known.__getitem__, chunks), np.uint64, len(chunks))
    return found[found != 0]


def seeds_of(words, match: int = MATCH):
    """Hash of each run of ``match`` words, by the place of its first word."""
    import numpy as np
    n = len(words) - match + 1
    if n <= 0 or not match:
        return np.empty(0, np.uint64)
    rolled = np.full(n, match, np.uint64)
    for k in range(match):
        rolled = rolled * np.uint64(_BASE) + words[k:k + n]
    return rolled ^ (rolled >> np.uint64(31))


def tiles(pattern, text, match: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (place in pattern, place in text, length), longest first.

    The search length starts at the whole pattern and halves down to ``match``; matches found at a length are extended
    as far as they go, and marked from the longest on, unless a mark got in the way. A zero in the text matches nothing.
    """
    p, t = [int(w) for w in pattern], [int(w) for w in text]
    free_p, free_t = [True] * len(p), [w != 0 for w in t]
    out: list[tuple[int, int, int]] = []
    length = max(match, min(len(p), len(t)))
    while True:
        found = _matches(p, t, free_p, free_t, length)
        longest = max((m[2] for m in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        marked = False
        for a, b, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if all(free_p[a:a + n]) and all(free_t[b:b + n]):
                free_p[a:a + n] = free_t[b:b + n] = [False] * n
                out.append((a, b, n))
                marked = True
        if marked and length > match:
            continue  # what a mark has cut short may still match at this length
        if length == match:
            if not marked:
                return sorted(out, key=lambda m: (-m[2], m[0], m[1]))
        else:
            length = max(match, length // 2)


def _matches(p, t, free_p, free_t, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``length`` free words, found by rolling hashes of that length."""
    places: dict[int, list[int]] = {}
    for a, h in _rolled(p, free_p, length):
        places.setdefault(h, []).append(a)
    found, seen = [], set()
    for b, h in _rolled(t, free_t, length):
        for a in places.get(h, ()):
            if (a, b) in seen or p[a:a + length] != t[b:b + length]:
                continue
            n = length
            while a + n < len(p) and b + n < len(t) and p[a + n] == t[b + n] and free_p[a + n] and free_t[b + n]:
                n += 1
            seen.update((a + k, b + k) for k in range(n - length + 1))
            found.append((a, b, n))
    return found


def _rolled(words, free, length: int):
    """Karp-Rabin hash of each window of free words."""
    mod, base = (1 << 61) - 1, 1_000_003
    lead, h, since = pow(base, length - 1, mod), 0, 0
    for k, (w, ok) in enumerate(zip(words, free)):
        if not ok:
            h, since = 0, 0
            continue
        if since >= length:
            h = (h - words[k - length] * lead) % mod
        h = (h * base + w) % mod
        since += 1
        if since >= length:
            yield k - length + 1, h


def benchmark_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item_words) of the items."""
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(items[f"`{id_col}`"].alias("item_id"), items[f"`{text_col}`"].alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL").distinct()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            words = [words_of(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.int64()))],
                                             ["item_id", "item_words"])

    return rows.mapInArrow(run, f"item_id {kind}, item_words array<bigint>")


def _seed_rows(items: DataFrame, match: int) -> DataFrame:
    """(seed, item_id) of every run of an item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            seeds = [seeds_of(np.array(w, np.int64).view(np.uint64), min(match, len(w))).view(np.int64)
                     for w in batch.column("item_words").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*seeds, np.empty(0, np.int64)])),
                                              batch.column("item_id").take(row)], ["seed", "item_id"])

    return items.mapInArrow(run, f"seed bigint, item_id {kind}").distinct()


def _bitmap(seeds: DataFrame, bits: int) -> bytes:
    """One bit per value of the seeds' low bits. Tasks set bytes of it; no more than ``bits`` / 8 bytes arrive."""
    import numpy as np
    places = seeds.select((F.pmod("seed", F.lit(bits)) / 8).cast("int").alias("byte"),
                          F.pmod("seed", F.lit(8)).cast("int").alias("bit")).groupBy("byte").agg(
        F.bit_or(F.expr("shiftleft(1, bit)")).alias("value"))
    table = np.zeros(bits // 8, np.uint8)
    for row in places.toLocalIterator():
        table[row["byte"]] = row["value"]
    return table.tobytes()


def seed_hits(docs: DataFrame, bitmap: bytes, id_col: str, text_col: str, lengths: list[int]) -> DataFrame:
    """(doc_id, k_text, words, seeds) of documents with hits: hit stretches, parted by zeros, and the distinct seeds.

    ``lengths`` are the numbers of words that seeds have.
    """
    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), row_key(text).alias("k_text"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = 8 * len(bitmap)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        table = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            keep, stretches, seeds = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                covered, own = np.zeros(len(words), bool), []
                for length in lengths:
                    rolled = seeds_of(words, length)
                    low = rolled & np.uint64(size - 1)
                    hit = np.flatnonzero((table[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1)
                    for n in range(length if len(hit) else 0):
                        covered[hit + n] = True
                    own.append(rolled[hit])
                own = np.concatenate([*own, np.empty(0, np.uint64)])
                if not len(own):
                    continue
                kept = np.where(covered, words, np.uint64(0))
                kept = kept[np.r_[True, (kept[1:] != 0) | (kept[:-1] != 0)]]
                keep.append(k)
                stretches.append(kept.view(np.int64))
                seeds.append(np.unique(own).view(np.int64))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("k_text").take(at),
                 pa.array(stretches, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))],
                ["doc_id", "k_text", "words", "seeds"])

    return rows.mapInArrow(run, f"doc_id {kind}, k_text bigint, words array<bigint>, seeds array<bigint>")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", match: int = MATCH, coverage: float = COVERAGE,
          map_bits: int = MAP_BITS) -> DataFrame:
    """(doc_id, k_text, item_id, coverage, tiles) of each leaked item. ``map_bits`` is a power of two, 8 or more."""
    if map_bits < 8 or map_bits & (map_bits - 1):
        raise ValueError("map_bits must be a power of two, 8 or more")
    bench = materialise(benchmark_words(items, item_col, item_text))
    seeds = materialise(_seed_rows(bench, match))
    size = F.least(F.size("item_words"), F.lit(match))
    lengths = sorted(r[0] for r in bench.select(size).distinct().collect() if r[0])  # no more than ``match`` of them
    hits = materialise(seed_hits(docs, _bitmap(seeds, map_bits), id_col, text_col, lengths).dropDuplicates(
        ["doc_id", "k_text"]))
    pairs = (hits.select("doc_id", "k_text", F.explode("seeds").alias("seed")).join(seeds, "seed")
             .select("doc_id", "k_text", "item_id").distinct())
    whole = (pairs.join(hits.select(F.col("doc_id").alias("d"), F.col("k_text").alias("k"), "words"),
                        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k_text") == F.col("k")))
             .join(bench, "item_id").select("doc_id", "k_text", "item_id", "words", "item_words"))
    kinds = [whole.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            found = []
            for words, item in zip(batch.column("words").to_pylist(), batch.column("item_words").to_pylist()):
                got = tiles(item, words, min(match, len(item)))
                found.append((sum(n for _, _, n in got) / len(item), len(got)))
            keep = pa.array([k for k, f in enumerate(found) if f[0] >= coverage], pa.int64())
            part = batch.take(keep)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("k_text"), part.column("item_id"),
                 pa.array([found[k][0] for k in keep.to_pylist()], pa.float64()),
                 pa.array([found[k][1] for k in keep.to_pylist()], pa.int64())],
                ["doc_id", "k_text", "item_id", "coverage", "tiles"])

    return whole.mapInArrow(run, f"doc_id {kinds[0]}, k_text bigint, item_id {kinds[1]}, coverage double, tiles bigint")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents into which no benchmark item has leaked, with their columns."""
    found = leaks(docs, items, id_col, text_col).select("doc_id", "k_text").distinct()
    a, b = (fresh(docs.columns, n) for n in ("_leak_id", "_leak_text"))
    found = found.toDF(a, b)
    return docs.join(found, docs[f"`{id_col}`"].eqNullSafe(found[a]) & (row_key(docs[f"`{text_col}`"]) == found[b]),
                     "left_anti")


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "tiles")
