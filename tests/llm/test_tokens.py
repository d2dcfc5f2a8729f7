import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trafficlens.llm import pieces, tokenfiles
from trafficlens.llm.common import shared_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "a   b", "x \n y", "x\n y", "\n\n", "  lead", "trail  ", "don't we'll", "a\x1cb \x85c", "  q",
       "é漢字 😀", "<|endoftext|> x", "a <|endoftext|> b", "x<|endoftext|>", "y <|endoftext|><|endoftext|>z w", "1,234.5 _a_", "tab\tx", " w   w"]


def plain_ids(texts):
    t = Tokenizer.from_file(BPE)  # as it is: the content of an added token is that token
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é'sS1._\n\t \x1c 漢")), min_size=1, max_size=4))
def test_units_encode_as_whole_texts(texts):
    made = tokenfiles.encoder(BPE)(pa.array(texts))
    assert [m.tolist() for m in made] == plain_ids(texts)


def test_odd_texts_encode_as_whole_texts():
    long = ["word " * 30_000 + "<|endoftext|>", "x" * 5000, " ".join("ab" * k for k in range(300))]
    encode = tokenfiles.encoder(BPE)
    for texts in (ODD, ODD[::-1], [t + " " + u for t in ODD for u in ODD], long):
        assert [m.tolist() for m in encode(pa.array(texts))] == plain_ids(texts)
    assert [m.tolist() for m in encode(pa.array([None, "a b"], pa.string()))] == [[], *plain_ids(["a b"])]
    assert encode(pa.array([], pa.string())) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from([0, 50, 90, 100]))
def test_blocks_round_trip(values, percentile):
    raw = tokenfiles.pack_block(values, percentile)
    assert tokenfiles.unpack_block(b"xx" + raw, 2).tolist() == values


def test_file_ranges():
    rng = np.random.default_rng(2)
    docs = [(i if i % 7 else None, rng.integers(0, 50_000 if i % 3 else 9, n).astype(np.uint32))
            for i, n in enumerate([0, 1, 5, 4096, 4097, 9000, 3])]
    out = io.BytesIO()
    out.close = lambda: None
    writer = tokenfiles.Writer(out, block=64)
    for i, d in docs:
        writer.add(i, d)
    size = writer.close()
    assert size == len(out.getvalue())
    index = tokenfiles.read_index(out)
    every = np.concatenate([d for _, d in docs])
    assert index.ids == [i for i, _ in docs] and index.lengths.tolist() == [len(d) for _, d in docs]
    for a, n in ((0, len(every)), (63, 2), (64, 64), (1000, 1), (17, 0)):
        assert (tokenfiles.read_range(out, index, a, n) == every[a:a + n]).all()


def test_documents_through_files(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "READ_TOKENS", 1000)
    manifest = tokenfiles.write_tokens(odd_docs, BPE, f"{shared_dir(spark)}/t")
    got = tokenfiles.read_tokens(manifest, with_ids=True).orderBy("start").collect()
    rows = sorted(odd_docs.select("doc_id", "text").collect(),
                  key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    start = 0
    for r, want, ids in zip(got, rows, plain_ids([r.text or "" for r in rows]), strict=True):
        raw = np.array([*ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens) == (want.doc_id, start, len(raw))
        assert r.ids == raw.tolist() and r.ids_crc32 == zlib.crc32(raw.tobytes())
        start += len(raw)
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(no_docs, BPE, f"{shared_dir(spark)}/t")).count() == 0


def best_sum(own, word):
    """Largest sum of scores by trying every cut, without a trie."""
    score = {own.pieces.texts[i]: own.scores[i] for i, o in enumerate(own.pieces.ordinary) if o}
    best = [0.0] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for b in range(e):
            s = score.get(word[b:e], own.unknown if e - b == 1 and word[b] not in score else None)
            if s is not None and (best[e] is None or best[b] + s > best[e]):
                best[e] = best[b] + s
    return best[-1]


def test_viterbi_is_best_and_decodes():
    own = pieces.codec(pieces.default_model())
    words = ["▁hello", "▁unbelievably", "▁▁▁x", "▁漢字ab", "▁é️😀z\n\n", "a", "▁" + "internationalization" * 5, "▁Straße,"]
    assert own.many(words) == [np.array(own.viterbi(w), "<i4").tobytes() for w in words]
    for w in words:
        ids, bytes_ = own.viterbi(w), set(own.pieces.byte_ids)
        chars = len(b"".join(own.bytes_of[i] for i in ids if i in bytes_).decode())
        assert np.isclose(sum(own.scores[i] for i in ids if i not in bytes_) + chars * own.unknown, best_sum(own, w))
    texts = [t for t in ODD + ["▁"] if t]
    for t, ids in zip(texts, own.encode(texts)):
        assert own.decode(ids) == t.replace("▁", " ")
    whole = [own.viterbi((" " + t).replace(" ", "▁")) for t in texts]
    assert [i.tolist() for i in own.encode(texts)] == whole


def test_library_unigram_agrees():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor
    model = pb.ModelProto()
    model.ParseFromString(open(pieces.default_model(), "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:  # scores that single precision can add without loss
        p.score = max(p.score, -40_000)
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    own = pieces.codec(pieces.default_model())
    same = pieces.Codec(pieces.Pieces(own.pieces.texts, tuple(max(s, -40_000) for s in own.scores), own.pieces.ordinary,
                                      own.pieces.byte_ids, own.pieces.unknown, own.pieces.lead))
    for t in ["Hello world", "The unbelievable internationalization of it", "de la paçai évi", "x 漢字 y"]:
        assert same.encode([t])[0].tolist() == library.encode(t)


def test_pieces_of_documents(odd_docs, no_docs):
    model = pieces.default_model()
    got = pieces.encode_pieces(odd_docs, model, keep=["doc_id", "text"], with_pieces=True, with_text=True).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r.decoded == (r.text or "").replace("▁", " ") and r.n_pieces == len(r.pieces)
        assert r.decoded_ok == ("▁" not in (r.text or ""))
    assert pieces.encode_pieces(no_docs, model, keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        pieces.encode_pieces(odd_docs.withColumnRenamed("fp", "pieces"), model, with_pieces=True)
