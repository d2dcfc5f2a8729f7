"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents as one stream, cut into blocks of a fixed number of ids. A block stores
its minimum, a bit width that fits the chosen percentile of the differences to the minimum, the low bits of every
difference packed at that width, and an exception list (places, high parts) for the few that need more. After the
blocks come the start of every block and the documents' ids and lengths, then a fixed trailer. Any range of ids can be
read from the blocks that cover it.

    file    = b"PFR1" block* index trailer
    block   = u32 minimum | u8 width | u8 0 | u16 exceptions | u32 ids | packed | u16 place * e | u32 high part * e
    index   = u64 block start * n | u8 id present * d | i64 document id * d | u32 tokens * d
    trailer = u64 index start | u32 n | u32 d | u32 ids per block | b"PFR1"         (all little-endian)

Tasks write under names of their own and report what they wrote; the manifest of those reports is the dataset. A
repeated or lost attempt leaves at most an unlisted file behind.

Defined results: a null or empty text is the end id alone; documents come in ascending order of id, null ids first,
repeated ids in order of their text; an empty table gives an empty manifest and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TABLE_BYTES, file_system, kept_by, materialise, shared_dir, table, unique_name

MAGIC = b"PFR1"
BLOCK = 4096
PERCENTILE = 90
END_ID = 0
READ_TOKENS = 1 << 20  # ids that one reading task row covers
_HEAD, _HEAD_SIZE = "<IBBHI", 12
_TAIL, _TAIL_SIZE = "<QIII4s", 24
READ_TASKS = 10_000
MANIFEST = "path string, part int, documents bigint, tokens bigint, bytes bigint"


def pack_block(values, percentile: float = PERCENTILE) -> bytes:
    """One block of unsigned 32-bit values."""
    import numpy as np
    values = np.asarray(values, np.uint32)
    low = int(values.min())
    rest = values - np.uint32(low)
    ordered = np.partition(rest, k := min(len(rest) - 1, int(len(rest) * percentile / 100)))
    width = int(ordered[k]).bit_length()
    high = (rest >> np.uint32(width)) if width < 32 else np.zeros_like(rest)
    places = np.flatnonzero(high)
    if width <= 8:
        bits = np.unpackbits(rest.astype(np.uint8).reshape(-1, 1), axis=1)[:, 8 - width:]
    elif width <= 16:
        bits = np.unpackbits(rest.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - width:]
    else:
        bits = np.unpackbits(rest.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width:]
    return b"".join((struct.pack(_HEAD, low, width, 0, len(places), len(values)), np.packbits(bits).tobytes(),
                     places.astype("<u2").tobytes(), high[places].astype("<u4").tobytes()))


def unpack_blocks(raw, starts):
    """The values of the blocks that start at these places, end to end; blocks of one width are unpacked together."""
    import numpy as np
    heads = [struct.unpack_from(_HEAD, raw, at) for at in starts]
    out: list = [None] * len(heads)
    alike: dict = {}
    for k, (_, width, _, _, n) in enumerate(heads):
        alike.setdefault((width, n % 8 and k), []).append(k)  # bytes of a block fall apart into groups of eight values
    for (width, _), blocks in alike.items():
        packed = [np.frombuffer(raw, np.uint8, (heads[k][4] * width + 7) // 8, starts[k] + _HEAD_SIZE) for k in blocks]
        ends = np.cumsum([heads[k][4] for k in blocks])
        for k, values in zip(blocks, np.split(_unpacked(np.concatenate(packed), int(ends[-1]), width), ends[:-1])):
            out[k] = values
    for values, at, (low, width, _, exceptions, n) in zip(out, starts, heads):
        at += _HEAD_SIZE + (n * width + 7) // 8
        places = np.frombuffer(raw, "<u2", exceptions, at)
        values[places] += np.frombuffer(raw, "<u4", exceptions, at + 2 * exceptions) << np.uint32(width)
        values += np.uint32(low)
    return np.concatenate(out)


def unpack_block(raw, at: int = 0):
    """The values of the block that starts at ``at``."""
    return unpack_blocks(raw, [at])


def _unpacked(packed, n: int, width: int):
    """``n`` values of ``width`` bits. Eight of them fill ``width`` bytes, so each of the eight always lies at the same
    bits of those and is put together for all groups at once."""
    import numpy as np
    groups = -(-n // 8)
    whole = np.zeros(groups * width, np.uint8)
    whole[:len(packed)] = packed
    kind = np.uint32 if width <= 25 else np.uint64  # a value may lie in as many bytes
    held = np.zeros((width + 1, groups), kind)
    held[:width] = whole.reshape(groups, width).T
    out = np.empty((groups, 8), np.uint32)
    mask = kind((1 << width) - 1)
    for k in range(8):
        first, skip = divmod(k * width, 8)
        used = -(-(skip + width) // 8)
        value = held[first]
        for j in range(1, used):
            value = value << kind(8) | held[first + j]
        out[:, k] = value >> kind(max(0, 8 * used - skip - width)) & mask
    return out.ravel()[:n]


class Writer:
    """Appends documents to a file; holds less than one batch of ids at a time, and the index."""

    def __init__(self, stream, block: int = BLOCK, percentile: float = PERCENTILE):
        if not 1 <= block <= 65_536:
            raise ValueError("a block holds 1 to 65,536 ids")
        self.stream, self.block, self.percentile = stream, block, percentile
        self.pending, self.held, self.tokens = [], 0, 0
        self.starts, self.ids, self.lengths = [], [], []
        stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, tokens) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(tokens))
        self.pending.append(tokens)
        self.held += len(tokens)
        self.tokens += len(tokens)
        if self.held >= 64 * self.block:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        import numpy as np
        values = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        end = len(values) if all_of_it else len(values) - len(values) % self.block
        for k in range(0, end, self.block):
            raw = pack_block(values[k:min(k + self.block, end)], self.percentile)
            self.starts.append(self.at)
            self.stream.write(raw)
            self.at += len(raw)
        self.pending, self.held = [values[end:]], len(values) - end

    def close(self) -> int:
        """Write the index; returns the size of the file."""
        import numpy as np
        self._flush(True)
        raw = b"".join((np.array(self.starts, "<u8").tobytes(),
                        np.array([i is not None for i in self.ids], np.uint8).tobytes(),
                        np.array([i or 0 for i in self.ids], "<i8").tobytes(),
                        np.array(self.lengths, "<u4").tobytes()))
        self.stream.write(raw)
        self.stream.write(struct.pack(_TAIL, self.at, len(self.starts), len(self.ids), self.block, MAGIC))
        self.stream.close()
        return self.at + len(raw) + _TAIL_SIZE


@dataclass
class Index:
    starts: object
    ids: list
    lengths: object
    block: int
    end: int


def read_index(stream) -> Index:
    """The index of an open, seekable file."""
    import numpy as np
    size = stream.seek(0, 2)
    stream.seek(size - _TAIL_SIZE)
    at, blocks, docs, block, magic = struct.unpack(_TAIL, stream.read(_TAIL_SIZE))
    if magic != MAGIC:
        raise ValueError("not a token file")
    stream.seek(at)
    raw = stream.read(size - _TAIL_SIZE - at)
    starts = np.frombuffer(raw, "<u8", blocks)
    known = np.frombuffer(raw, np.uint8, docs, 8 * blocks)
    ids = np.frombuffer(raw, "<i8", docs, 8 * blocks + docs).tolist()
    lengths = np.frombuffer(raw, "<u4", docs, 8 * blocks + 9 * docs).astype(np.int64)
    return Index(starts, [i if k else None for i, k in zip(ids, known)], lengths, block, at)


def read_range(stream, index: Index, first: int, count: int):
    """``count`` ids from place ``first``, read from the blocks that cover them."""
    import numpy as np
    if not count:
        return np.empty(0, np.uint32)
    a, b = first // index.block, (first + count - 1) // index.block
    end = int(index.starts[b + 1]) if b + 1 < len(index.starts) else index.end
    begin = int(index.starts[a])
    stream.seek(begin)
    raw = stream.read(end - begin)
    values = unpack_blocks(raw, [int(s) - begin for s in index.starts[a:b + 1]])
    return values[first - a * index.block:][:count]


class Units:
    """Ids of words after a space, numbered as they come, up to about ``limit`` bytes; number 0 is every odd word.

    A full table starts anew with the words at hand, so frequent words are soon back.
    """

    def __init__(self, encode, leads, limit: int = 6 * TABLE_BYTES):
        self.encode, self.leads, self.limit = encode, leads, limit
        self._clear()

    def _clear(self) -> None:
        import numpy as np
        self.number, self.size = {}, 0
        self.flat, self.ends, self.n = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int32), 1

    def add(self, flat, ends) -> int:
        """Append lists of ids, given end to end; returns the number of the first."""
        import numpy as np
        first, held = self.n, int(self.ends[self.n])
        while held + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while first + len(ends) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[held:held + len(flat)] = flat
        self.ends[first + 1:first + 1 + len(ends)] = np.asarray(ends) + held
        self.n += len(ends)
        return first

    def drop(self, first: int) -> None:
        """Forget the lists from that number on."""
        self.n = first

    def numbers(self, words: list[str]):
        """Number of each of the distinct words."""
        import numpy as np
        if self.size > self.limit:
            self._clear()
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        new = [words[k] for k in missing.tolist()]
        good = np.array([bool(w) and not (w[0].isspace() or w[-1].isspace()) for w in new], bool)
        found[missing] = 0
        if good.any():
            simple = [w for w, ok in zip(new, good.tolist()) if ok]
            [ids] = self.encode([" " + " ".join(simple)])
            starts = np.flatnonzero(self.leads[ids])  # one for each word
            if len(starts) != len(simple):
                raise ValueError("the tokenizer is not a byte-level one that cuts before a space")
            first = self.add(ids, np.append(starts[1:], len(ids)))
            found[missing[good]] = np.arange(first, first + len(simple))
            self.size += 4 * len(ids) + 200 * len(simple) + sum(map(len, simple))
        self.number.update(zip(new, found[missing].tolist()))
        return found


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer.

    Byte-level BPE works on pieces that its splitting pattern cuts off, and the pattern always cuts before a single
    space that follows another character and is followed by a word. So a text is its first word and then units of a space
    and a word. Units are numbered a slice of texts at a time; those that the worker does not know yet go to the
    tokenizer in one text, whose ids fall apart again at those that begin with a space. The ids of the slice are gathered from
    those of its units. Texts with longer runs of white space, where the pattern looks further, and those that hold an
    added token are handed to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        import numpy as np
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        space = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]  # what stands for a space in the vocabulary
        vocabulary = self.tokenizer.get_vocab()
        leads = np.zeros(max(vocabulary.values()) + 1, bool)
        leads[[i for piece, i in vocabulary.items() if piece[0] == space]] = True
        self.units = Units(self.encode, leads)

    def encode(self, texts: list[str]) -> list:
        import numpy as np
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts) -> list:
        """Ids of each text of a string column, as uint32 arrays."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        if not len(texts):
            return []
        texts, units = pc.fill_null(texts, ""), self.units
        whole = np.asarray(pc.equal(texts, ""))
        for token in self.added:
            whole = whole | np.asarray(pc.match_substring(texts, token))
        words = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        offsets = np.asarray(words.offsets)
        starts = offsets[:-1]
        coded = pc.dictionary_encode(words.values)
        code = np.asarray(coded.indices)
        # The first word of a text has no space before it: it is a unit of its own.
        after = np.ones(len(code), bool)
        after[starts] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[code[after]] = True
        number = np.zeros(len(used), np.int64)
        number[used] = units.numbers(coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist())
        unit = number[code]
        heads = words.values.take(pa.array(starts)).to_pylist()
        unit[starts] = [-1 if h and not h[-1].isspace() else 0 for h in heads]
        whole |= np.logical_or.reduceat(unit == 0, starts)
        plain = np.flatnonzero(~whole)
        first = self.encode([heads[k] for k in plain])
        mark = units.add(np.concatenate([*first, np.empty(0, np.uint32)]), np.cumsum([len(f) for f in first], dtype=np.int64))
        unit[starts] = 0
        unit[starts[plain]] = mark + np.arange(len(plain))
        lists = pa.ListArray.from_arrays(pa.array(units.ends[:units.n + 1]), pa.array(units.flat))
        found = lists.take(pa.array(unit))
        out = np.split(np.asarray(found.values), np.asarray(found.offsets)[offsets[1:-1]])
        units.drop(mark)
        odd = np.flatnonzero(whole)
        for k, ids in zip(odd, self.encode(texts.take(pa.array(odd)).to_pylist())):
            out[k] = ids
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return kept_by("tokens", path, lambda: Encoder(path))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """Write token files of all documents, in ascending order of id, below ``folder``; returns the manifest.

    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    """
    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encode, end = encoder(tokenizer), np.array([end_id], "<u4")
        writer = path = None
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 512):
                for i, found in zip(ids[at:at + 512], encode(column.slice(at, 512))):
                    if writer is None:
                        fs, at_path = file_system(folder)
                        fs.create_dir(at_path, recursive=True)
                        path = unique_name(part, ".pfr")
                        writer = Writer(fs.open_output_stream(f"{at_path}/{path}"), block, percentile)
                    writer.add(i, np.concatenate((found, end)))
        if writer is not None:
            size = writer.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{path}", "part": part,
                                               "documents": len(writer.ids), "tokens": writer.tokens, "bytes": size}],
                                             schema=pa.schema([("path", pa.string()), ("part", pa.int32()),
                                                               ("documents", pa.int64()), ("tokens", pa.int64()),
                                                               ("bytes", pa.int64())]))

    ordered = rows.repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, MANIFEST))


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 and, on request, the ids.

    Files are read in ranges of about ``READ_TOKENS`` ids by as many task rows.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    spans = (manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
             .withColumn("span", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / READ_TOKENS))))
             .select("path", "first", "span"))
    # small rows that stand for much reading: a number of tasks of its own, not one that follows their size
    tasks = manifest.agg(F.sum(F.floor((F.col("tokens") - 1) / READ_TOKENS) + 1)).first()[0] or 1
    spans = spans.repartition(min(int(tasks), READ_TASKS))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" * with_ids)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = file_system(row["path"])
                with fs.open_input_file(at) as stream:
                    index = read_index(stream)
                    places = np.cumsum(index.lengths) - index.lengths
                    # a document belongs to the range in which it starts
                    a, b = np.searchsorted(places, [row["span"] * READ_TOKENS, (row["span"] + 1) * READ_TOKENS])
                    for k in range(a, b, 256):
                        e = min(k + 256, b)
                        values = read_range(stream, index, int(places[k]), int(index.lengths[k:e].sum()))
                        cuts = (places[k:e] - places[k]).tolist()
                        docs = [values[c:c + n] for c, n in zip(cuts, index.lengths[k:e].tolist())]
                        out = {"doc_id": pa.array(index.ids[k:e], pa.int64()),
                               "start": pa.array(row["first"] + places[k:e]),
                               "n_tokens": pa.array(index.lengths[k:e]),
                               "ids_crc32": pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64())}
                        if with_ids:
                            out["ids"] = pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(out)

    return spans.mapInArrow(run, schema)


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/tokens")
    return read_tokens(manifest)
