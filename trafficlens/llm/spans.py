"""Repeated passages by sliding runs of sentences.

A text is cut into sentences (after . ! ? … and their ideographic kin, and at line ends; words of scripts without spaces are single characters; a longer sentence is cut further between the two words
whose hash is least in a window of word pairs, so that equal passages are cut alike from the window on, wherever they
stand: of a passage without sentence ends, 47 words suffice for a run that is found in any surroundings). Every run of ``SENTENCES`` or more consecutive
sentences that reaches ``RUN_WORDS`` words, starting at each sentence, is hashed by its lower-cased words. Runs whose
hash occurs more than once anywhere are repeats; the first in order of (id, text, place) stays, and every sentence
covered by a later one is removed.

Runs travel once, dealt and sorted by hash, and what stands alone is left out as they pass; a hash is one run of rows
in one task, of which a single row is held. Finding the first place is a join whose crowded side Spark splits.

Defined results: null and empty texts have no runs and stay as they are; a text may become empty; rows with equal id
and text count as one place and are treated alike; null ids come last; other columns are kept by
``remove_repeats``, where a column named n_chars is set to the new length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise, row_key, splitter, table, word_hashes

SENTENCES = 3
RUN_WORDS = 15
LONG = 12  # words of a sentence above which it is cut further
WINDOW = 8  # pairs of words among which the least hash makes a cut; a power of two
_END = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|\s*[\n\r  ]\s*")
_ANY_END = re.compile(r"[。！？｡]+[\"'”’)\]」』]*|[.!?…]+[\"'”’)\]]*\s+|\s*[\n\r  ]\s*")
_SPACED, _ANY = re.compile(r"\S+"), re.compile(WORD)


def sentences(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, words, hash) of each sentence; the parts cover the text without gaps."""
    from xxhash import xxh64_intdigest
    found, start, words_of = [], 0, splitter(text)
    end, word = (_END, _SPACED) if words_of is str.split else (_ANY_END, _ANY)
    for cut in [*[m.end() for m in end.finditer(text)], len(text)]:
        if cut <= start:
            continue
        words = words_of(text[start:cut].lower())
        if words:
            found.append([start, cut, words])
        elif found:  # white space alone belongs to the sentence before it
            found[-1][1] = cut
        else:
            continue
        start = cut
    cuts = iter(_cuts([words for *_, words in found if len(words) > LONG]))
    out = []
    for start, end, words in found:
        if len(words) <= LONG:
            out.append((start, end, len(words), xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))))
            continue
        ends, first, at = [m.end() for m in word.finditer(text, start, end)], 0, start
        for last in [*next(cuts), len(words)]:
            stop = ends[last - 1] if last < len(words) else end
            part = " ".join(words[first:last]).encode("utf-8", "surrogatepass")
            out.append((at, stop, last - first, xxh64_intdigest(part)))
            first, at = last, stop
    return out


def _cuts(long: list[list[str]]) -> list[list[int]]:
    """For each sentence of over ``WINDOW`` words, the numbers of words before its cuts.

    A cut lies inside the pair of words that has the least hash of some window of ``WINDOW`` pairs, of equal ones the
    last. So it depends on nothing further than ``WINDOW`` words away, and two cuts are at most so far apart.
    """
    import numpy as np
    if not long:
        return []
    sizes = np.array([len(words) for words in long])
    known = word_hashes()
    word = np.fromiter((known[w] for words in long for w in words), np.uint64, int(sizes.sum()))
    pair = (word[:-1] ^ (word[1:] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    pair ^= pair >> np.uint64(29)
    least, step = np.arange(len(pair)), 1
    while step < WINDOW:
        a, b = least[:-step], least[step:]
        least, step = np.where(pair[b] <= pair[a], b, a), 2 * step
    of = np.repeat(np.arange(len(long)), sizes)
    chosen = np.zeros(len(word), bool)
    chosen[least[of[:-WINDOW] == of[WINDOW:]]] = True  # windows within a sentence
    at, starts = np.flatnonzero(chosen), np.cumsum(sizes) - sizes
    return [(c + 1 - s).tolist() for c, s in zip(np.split(at, np.searchsorted(at, starts[1:])), starts)]


def runs(parts: list[tuple[int, int, int, int]]):
    """(first sentence, number of sentences, hash) of each run, as arrays."""
    import numpy as np
    n = len(parts)
    if not n:
        return (np.empty(0, np.int64),) * 3
    total = np.concatenate(([0], np.cumsum([p[2] for p in parts])))
    hashes = np.array([p[3] for p in parts], np.uint64)
    first = np.arange(n)
    end = np.maximum(first + SENTENCES, np.searchsorted(total, total[:-1] + RUN_WORDS))
    first = first[end <= n]
    count = (end - np.arange(n))[:len(first)]
    mixed = np.zeros(len(first), np.uint64)
    for k in range(int(count.max()) if len(count) else 0):
        on = count > k
        mixed[on] = (mixed[on] ^ hashes[first[on] + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed[on] ^= mixed[on] >> np.uint64(29)
    return first, count, mixed.view(np.int64)


def run_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k_text, first, count, h) of every run."""
    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), row_key(text).alias("k_text"), text.alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [runs(sentences(t)) if t else runs([]) for t in part.column("text").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(row), part.column("k_text").take(row),
                     pa.array(np.concatenate([f[0] for f in found]).astype(np.int32)),
                     pa.array(np.concatenate([f[1] for f in found]).astype(np.int32)),
                     pa.array(np.concatenate([f[2] for f in found]))], ["doc_id", "k_text", "first", "count", "h"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, k_text bigint, first int, count int, h bigint")


def _shared(every: DataFrame) -> DataFrame:
    """The runs whose hash occurs more than once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        held, again = None, False  # the last row so far, and whether the row before it has its hash
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            h = rows.column("h").to_numpy(zero_copy_only=False)
            same = h[1:] == h[:-1]
            keep = np.r_[again, same] | np.r_[same, False]
            held, again = rows.slice(len(h) - 1), bool(keep[-1])
            yield rows.filter(pa.array(np.r_[keep[:-1], False]))
        if again:
            yield held

    return every.repartition("h").sortWithinPartitions("h").mapInArrow(run, every.schema)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k_text, first, count) of every run that is not the first of its kind."""
    shared = materialise(_shared(run_table(docs, id_col, text_col)))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("k_text").alias("c"),
                     F.col("first").alias("d"))
    head = shared.groupBy("h").agg(F.min(order).alias("head"))
    later = shared.join(head, "h").where(order > F.col("head"))
    return later.select("doc_id", "k_text", "first", "count").distinct()


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k_id, k_text, firsts, counts): the repeated runs of each text that has any."""
    pair = F.sort_array(F.collect_list(F.struct("first", "count")))  # no more than the text's own sentences
    return (repeated_runs(docs, id_col, text_col).groupBy("doc_id", "k_text").agg(pair.alias("runs"))
            .select(F.col("doc_id").alias("k_id"), "k_text", F.col("runs.first").alias("firsts"),
                    F.col("runs.count").alias("counts")))


def cut_runs(text: str, firsts: list[int], counts: list[int]) -> tuple[str, list[tuple[int, int]], int, int]:
    """The text without the covered sentences, the removed spans, and how many sentences and words went."""
    parts = sentences(text)
    covered = bytearray(len(parts))
    for a, n in zip(firsts, counts):
        covered[a:a + n] = b"\1" * n
    kept, spans, words, at = [], [], 0, 0
    for (a, b, n, _), gone in zip(parts, covered):
        if not gone:
            continue
        words += n
        if spans and spans[-1][1] == a:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return "".join(kept), spans, sum(covered), words


def _joined(docs: DataFrame, id_col: str, text_col: str, how: str) -> tuple[DataFrame, str, str]:
    gone = removals(docs, id_col, text_col)
    names = [fresh(docs.columns, n) for n in ("_gone_id", "_gone_text", "_gone_firsts", "_gone_counts")]
    gone = gone.toDF(*names)
    on = (docs[f"`{id_col}`"].eqNullSafe(gone[names[0]])
          & (row_key(docs[f"`{text_col}`"]) == gone[names[1]]))
    return docs.join(gone, on, how).drop(names[0], names[1]), names[2], names[3]


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that lose sentences: doc_id, sentences and words removed, removed spans, remaining text."""
    joined, firsts, counts = _joined(docs, id_col, text_col, "inner")
    rows = joined.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                         F.col(firsts).alias("firsts"), F.col(counts).alias("counts"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = [cut_runs(*row) for row in zip(*[part.column(c).to_pylist() for c in ("text", "firsts", "counts")])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([c[2] for c in cut], pa.int64()),
                     pa.array([c[3] for c in cut], pa.int64()),
                     pa.array([[{"start": a, "end": b} for a, b in c[1]] for c in cut],
                              pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array([c[0] for c in cut], pa.string())],
                    ["doc_id", "sentences_removed", "words_removed", "spans", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, sentences_removed bigint, words_removed bigint, "
                                "spans array<struct<start: bigint, end: bigint>>, text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with their columns, the texts without repeated sentences."""
    joined, firsts, counts = _joined(docs, id_col, text_col, "left")
    whole = joined.where(F.col(firsts).isNull()).drop(firsts, counts)
    rows = joined.where(F.col(firsts).isNotNull()).select(*[F.col(f"`{c}`") for c in docs.columns], firsts, counts)
    at_text = docs.columns.index(text_col)
    at_size = next((k for k, c in enumerate(docs.columns) if c == "n_chars"), None)
    schema = docs.schema

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            *columns, a, b = batch.columns
            text = [cut_runs(*row)[0] for row in zip(columns[at_text].to_pylist(), a.to_pylist(), b.to_pylist())]
            columns[at_text] = pa.array(text, columns[at_text].type)
            if at_size is not None:
                columns[at_size] = pa.array([len(t) for t in text]).cast(columns[at_size].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return whole.unionByName(rows.mapInArrow(run, schema))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))
