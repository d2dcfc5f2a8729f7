"""Encoding into the pieces of a SentencePiece model by a unigram Viterbi search, and decoding.

The text gets a leading space (as the model asks) and every space becomes the marker U+2581. The best segmentation is
the one with the largest sum of piece scores; among equal sums the one whose last piece begins earliest. Pieces are
looked up in a double-array trie over UTF-8 bytes, which yields all pieces that begin at a place in one walk. A
character that no piece covers costs the lowest score less 10 and becomes its byte pieces.

No piece has a marker after another character, so a segmentation always breaks before a marker that follows one, and
the search runs word by word; equal words are searched once per worker. A model with such pieces is searched whole.

Scores are taken as the model file has them; in a model made by pair merging they fall with the rank of the merge.

Defined results: null and empty texts have no pieces and decode to the empty text; the marker itself, should a text
hold it, decodes to a space, which is the one case where decoding does not give the text back.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, fresh, kept_by, table

MARK = "▁"
UNKNOWN_COST = 10.0
_WIDE = 64  # bytes of a word up to which words are searched side by side


class DoubleArray:
    """Trie of byte strings in two integer arrays: the child of state s by byte b is base[s] + b + 1 where check says s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        tree: dict = {}
        for key, value in zip(keys, values):
            node = tree
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        self.base, self.check, self.value = array("i"), array("i"), array("i")
        used, end = bytearray(b"\x01"), 1
        queue = [(0, tree)]
        for state, node in queue:  # grows while it is read: breadth first
            self._grow(state + 1)
            self.value[state] = node.get(-1, -1)
            children = sorted(b for b in node if b >= 0)
            if not children:
                continue
            base, hole = end, 0
            for _ in range(256):  # holes for the first child, then past everything used
                hole = used.find(0, hole + 1, end)
                if hole < 0:
                    break
                at = hole - children[0] - 1
                if at > 0 and not any(used[at + b + 1] for b in children if at + b + 1 < end):
                    base = at
                    break
            self.base[state] = base
            last = base + children[-1] + 2
            if last > end:
                used.extend(bytes(last - end))
                end = last
            self._grow(end)
            for b in children:
                self.check[base + b + 1], used[base + b + 1] = state, 1
                queue.append((base + b + 1, node[b]))

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
            self.value.extend([-1] * more)

    def prefixes(self, raw: bytes, at: int) -> list[tuple[int, int]]:
        """(end, value) of every key that begins at ``at``, shortest first."""
        found, state = [], 0
        base, check, value = self.base, self.check, self.value
        for end in range(at, len(raw)):
            child = base[state] + raw[end] + 1
            if child >= len(check) or check[child] != state or not base[state]:
                break
            state = child
            if value[state] >= 0:
                found.append((end + 1, value[state]))
        return found


@dataclass(frozen=True)
class Pieces:
    """What a model file says: pieces by id, their scores, kinds, and whether a space is put in front."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    ordinary: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    lead: bool


def load_pieces(path: str) -> Pieces:
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    plain = tuple(not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
                  for i in range(n))
    data = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    byte_ids = tuple(data) if all(model.is_byte(i) for i in data) else ()
    texts = tuple(model.id_to_piece(i) for i in range(n))
    lead = model.encode("a", out_type=str)[:1] != ["a"]
    return Pieces(texts, tuple(model.get_score(i) for i in range(n)), plain, byte_ids, model.unk_id(), lead)


class Codec:
    """Encoder and decoder of a worker."""

    def __init__(self, pieces: Pieces, trie: DoubleArray | None = None):
        self.pieces = pieces
        ids = [i for i, ordinary in enumerate(pieces.ordinary) if ordinary and pieces.texts[i]]
        self.trie = trie or DoubleArray([pieces.texts[i].encode() for i in ids], ids)
        self.scores = pieces.scores
        self.unknown = min((pieces.scores[i] for i in ids), default=0.0) - UNKNOWN_COST
        self.by_word = all(MARK not in pieces.texts[i].lstrip(MARK) for i in ids)
        self.memo = Memo(self.many)
        self.bytes_of = [b"" if not o else t.replace(MARK, " ").encode() for t, o in zip(pieces.texts, pieces.ordinary)]
        for b, i in enumerate(pieces.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.bytes_of[pieces.unknown] = " ⁇ ".encode()

    @property
    def arrays(self):
        import numpy as np
        if not hasattr(self, "_arrays"):
            self._arrays = (*(np.array(a, np.int64) for a in (self.trie.base, self.trie.check, self.trie.value)),
                            np.array(self.scores, np.float64))
        return self._arrays

    def viterbi(self, text: str) -> list[int]:
        """Best pieces of a text whose spaces are markers already."""
        raw = text.encode("utf-8", "surrogatepass")
        n, scores, prefixes, unknown = len(raw), self.scores, self.trie.prefixes, self.unknown
        best: list = [None] * (n + 1)
        back: list = [None] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            so_far = best[at]
            if so_far is None:
                continue
            lead = raw[at]
            step = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            covered = False
            for end, i in prefixes(raw, at):
                covered |= end == step
                value = so_far + scores[i]
                if best[end] is None or value > best[end]:
                    best[end], back[end] = value, (at, i)
            if not covered:
                value = so_far + unknown
                if best[step] is None or value > best[step]:
                    best[step], back[step] = value, (at, -1)
        out, end = [], n
        while end:
            at, i = back[end]
            if i >= 0:
                out.append(i)
            elif self.pieces.byte_ids:
                out.extend(self.pieces.byte_ids[b] for b in reversed(raw[at:end]))
            else:
                out.append(self.pieces.unknown)
            end = at
        return out[::-1]

    def many(self, words: list[str]) -> list[bytes]:
        """``viterbi`` of many words at once, as int32 bytes: places in step, all words side by side."""
        import numpy as np
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(raws)
        short = sorted((k for k, r in enumerate(raws) if len(r) <= _WIDE), key=lambda k: len(raws[k]))
        for k, r in enumerate(raws):
            if len(r) > _WIDE:
                out[k] = np.array(self.viterbi(words[k]), "<i4").tobytes()
        for at in range(0, len(short), 8192):
            part = short[at:at + 8192]
            for k, raw in zip(part, self._side_by_side([raws[k] for k in part])):
                out[k] = raw
        return out

    def _side_by_side(self, raws: list[bytes]) -> list[bytes]:
        import numpy as np
        base, check, value, scores = self.arrays
        n, size = len(raws), np.fromiter(map(len, raws), np.int64, len(raws))
        width = int(size.max())
        text = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in raws]), np.uint8).reshape(n, width)
        best = np.full((n, width + 1), -np.inf)
        back = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0
        byte_ids = np.array(self.pieces.byte_ids, np.int32)
        for at in range(width):
            here = np.flatnonzero((size > at) & (best[:, at] > -np.inf))
            if not len(here):
                continue
            lead, so_far = text[here, at], best[here, at]
            step = at + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            covered = np.zeros(len(here), bool)
            walk, state = np.arange(len(here)), np.zeros(len(here), np.int64)
            for end in range(at + 1, width + 1):
                inside = size[here[walk]] >= end
                walk, state = walk[inside], state[inside]
                child = base[state] + text[here[walk], end - 1] + 1
                known = (base[state] > 0) & (child < len(check))
                known[known] = check[child[known]] == state[known]
                walk, state = walk[known], child[known]
                if not len(walk):
                    break
                ends = value[state] >= 0
                w, v = walk[ends], value[state[ends]]
                covered[w] |= step[w] == end
                total = so_far[w] + scores[v]
                better = total > best[here[w], end]
                w, v, total = w[better], v[better], total[better]
                best[here[w], end], back[here[w], end], piece[here[w], end] = total, at, v
            alone = np.flatnonzero(~covered)
            alone = alone[so_far[alone] + self.unknown > best[here[alone], step[alone]]]
            rows, ends = here[alone], step[alone]
            best[rows, ends] = so_far[alone] + self.unknown
            if len(byte_ids):  # the places inside a character are no ends of pieces, so its bytes can be chained there
                for k in range(1, min(4, width - at) + 1):
                    some = rows[at + k <= ends]
                    back[some, at + k] = at + k - 1
                    piece[some, at + k] = byte_ids[text[some, at + k - 1]]
            else:
                back[rows, ends], piece[rows, ends] = at, self.pieces.unknown
        found, count = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        place, live = size.copy(), np.arange(n)
        while len(live := live[place[live] > 0]):
            count[live] += 1
            found[live, width - count[live]] = piece[live, place[live]]
            place[live] = back[live, place[live]]
        flat = found[np.arange(width) >= (width - count)[:, None]].astype("<i4").tobytes()
        ends = np.cumsum(4 * count).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def words(self, text: str) -> list[str]:
        """Parts between which no piece reaches: each is a run of markers and what follows up to the next marker."""
        marked = (" " + text if self.pieces.lead else text).replace(" ", MARK)
        if not self.by_word:
            return [marked]
        first, *rest = marked.split(MARK)
        out, run = ([first] if first else []), ""
        for part in rest:
            run += MARK
            if part:
                out.append(run + part)
                run = ""
        return out + [run] if run else out

    def encode(self, texts: list[str | None]) -> list:
        """Piece ids of each text, as int32 arrays."""
        import numpy as np
        out = []
        for at in range(0, len(texts), 256):
            split = [self.words(t) if t else [] for t in texts[at:at + 256]]
            distinct = list(set().union(*split))
            known = dict(zip(distinct, self.memo.values(distinct)))
            out += [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in split]
        return out

    def decode(self, ids) -> str:
        """The text of piece ids; broken byte pieces become replacement characters."""
        if not len(ids):
            return ""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.pieces.lead and text[:1] == " " else text


def codec(path: str, pieces: Pieces | None = None, trie: DoubleArray | None = None) -> Codec:
    """The codec of a model file, kept by the process; workers get the parts that the driver has made."""
    return kept_by("pieces", path, lambda: Codec(pieces or load_pieces(path), trie))


_ADDED = "n_pieces bigint, n_byte_pieces bigint, pieces_crc32 bigint, decoded_crc32 bigint, decoded_ok boolean"


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None,
                  with_pieces: bool = False, with_text: bool = False) -> DataFrame:
    """Encode whole texts and decode the pieces again; adds counts and checks to the kept columns (all by default).

    ``pieces`` (array of ids) and ``decoded`` (text) come on request. ``model`` is a path that the driver can read.
    Rows are independent: no shuffle.
    """
    from pyspark.sql import types as T
    kept = docs.columns if keep is None else keep
    source = fresh(kept, "_encoded_text")
    base = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text_col}`"].alias(source))
    added = T.StructType.fromDDL(_ADDED + ", pieces array<int>" * with_pieces + ", decoded string" * with_text)
    clash = {c.lower() for c in kept} & {f.name.lower() for f in added}
    if clash:
        raise ValueError(f"columns exist already, leave them out by keep: {sorted(clash)}")
    schema = T.StructType([*base.schema.fields[:-1], *added.fields])
    made = codec(model)
    pieces, trie = made.pieces, made.trie

    def run(batches):
        import numpy as np
        import pyarrow as pa
        own = codec(model, pieces, trie)
        is_byte = np.zeros(len(own.pieces.texts) + 1, bool)
        is_byte[list(own.pieces.byte_ids)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.columns[-1].to_pylist()]
                ids = own.encode(texts)
                decoded = [own.decode(i) for i in ids]
                out = [pa.array([len(i) for i in ids], pa.int64()),
                       pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
                       pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                       pa.array([zlib.crc32(d.encode()) for d in decoded], pa.int64()),
                       pa.array([d == t for d, t in zip(decoded, texts)], pa.bool_())]
                if with_pieces:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                if with_text:
                    out.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], names=schema.names)

    return base.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op9_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), default_model(), keep=["doc_id"])
