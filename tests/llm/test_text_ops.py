import random

import numpy as np

from tests.llm.conftest import prose
from trafficlens.llm import cotraining, langid, spans, tiling

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    model = langid.fit(docs)
    _, scores, rejected = langid.score_texts(model, ["漢字漢字漢字", "Привет мир", None, "", "12 34"])
    assert all(rejected) and scores[2:] == [0.0, 0.0, 0.0]
    got = langid.predict(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert langid.predict(no_docs, model).count() == 0
    nothing = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    kept = langid.drop_rejected(docs)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()


def test_long_texts_are_scored_in_steps(monkeypatch):
    text = prose(random.Random(1), 3000)
    model = langid.train([text, "où été même français"], ["a", "b"])
    whole = langid.score_texts(model, [text])
    monkeypatch.setattr(langid, "_STEP", 777)
    assert np.isclose(langid.score_texts(model, [text])[1], whole[1])


def test_language_learned_from_long_texts_alone(spark):
    """All labelled texts of one language are above 64 kB, and tell it only far from their beginning."""
    rng = random.Random(3)
    strange = lambda n: " ".join("".join(rng.choice("kwzxq") + rng.choice("yu") for _ in range(3)) for _ in range(n))
    rows = [(i, "123 " * 20_000 + strange(400), "qq") for i in range(40)] + [(100 + i, prose(rng, 60), "en") for i in range(40)]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ("en", "qq")
    assert langid.score_texts(model, [strange(30), prose(rng, 30)])[0] == ["qq", "en"]
    drawn = langid.sample(docs, "doc_id", "text", "lang", 5).collect()
    assert len({r.t for r in drawn if r.l == "qq"}) <= 5 * langid.PASSAGES and max(len(r.t.split()) for r in drawn) <= langid.LONGEST


def test_passages_come_from_the_whole_text():
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000))
    places = [text.index(p) / len(text) for p in langid.passages(text)]
    assert max(places) > 0.5 and len(places) == langid.PASSAGES and langid.passages("12 !") == []


def plain_features(text):
    """Character 2- to 4-grams of each word with its end marks."""
    out = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        marked = f"<{word}>"
        for n in (2, 3, 4):
            for k in range(len(marked) - n + 1):
                out[marked[k:k + n]] = out.get(marked[k:k + n], 0) + 1
    return out


def test_features_equal_a_plain_count():
    rng = random.Random(12)
    for text in [prose(rng, 40), "a", "ab cd", "Où été, même!", "x" * 50, "", "1 2"]:
        want = sorted(plain_features(text).values())
        _, counts = np.unique(langid.features_of(langid.letters_of(text)), return_counts=True)
        assert sum(want) == counts.sum()
        if len(want) < 200:  # few enough for the buckets not to collide
            assert sorted(counts.tolist()) == want


def test_shapes_are_those_of_whole_chunks():
    long = "a" * 60
    assert cotraining._code(long + "1") != cotraining._code(long + "!")
    assert cotraining._code(long + "1a") // cotraining.WORDS == cotraining._code("b" * 90 + "2c") // cotraining.WORDS


def test_unspaced_scripts_repeat_by_characters(spark):
    passage = "昨夜の強い風で古い橋が壊れた。村の人々は朝から集まり、新しい橋を作る相談をした。若者たちは山へ木を切りに行った。"
    rows = [(1, "今日は晴れだ。" + passage + "犬が走る。"), (2, "雨の日だった。" + passage + "猫が眠る。"), (3, "何もない短い文だ。")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in spans.find_repeats(df).collect()}
    assert set(got) == {2} and passage not in got[2] and got[2].startswith("雨の日だった。") and got[2].endswith("猫が眠る。")


def plain_sentences(text):
    """End of every sentence that has no more words than are cut further, character by character."""
    ends, k, n = [], 0, len(text)
    while k < n:
        if text[k] in ".!?…":
            while k < n and text[k] in ".!?…":
                k += 1
            while k < n and text[k] in "\"'”’)]":
                k += 1
            if k < n and text[k].isspace():
                while k < n and text[k].isspace():
                    k += 1
                ends.append(k)
        elif text[k] in "\n\r":
            while k < n and text[k].isspace():
                k += 1
            ends.append(k)
        else:
            k += 1
    return [e for e in ends if text[:e].strip() and e < n]


def test_sentence_ends_equal_a_plain_scan():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", ". ", "!", "?) ", "… ", '." ', "\n", "d"]) for _ in range(rng.randrange(1, 30)))
        parts = spans.sentences(text)
        if parts:
            assert [p[1] for p in parts[:-1]] == [e for e in plain_sentences(text) if e <= parts[-1][0]], repr(text)


def plain_repeats(rows):
    """Covered sentences of each (id, text), by going through all runs in order."""
    seen, gone = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for key in dict.fromkeys(order):
        parts = spans.sentences(key[2])
        for a, n, _ in zip(*spans.runs(parts)):
            words = " ".join(key[2][parts[a][0]:parts[a + n - 1][1]].lower().split())
            cuts = tuple(p[3] for p in parts[a:a + n])
            if (words, cuts) in seen:
                gone.setdefault(key, set()).update(range(a, a + n))
            seen[(words, cuts)] = key
    return gone


def test_repeats_equal_plain_search(spark, odd_docs, no_docs):
    rng = random.Random(9)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, 40) + " " + passage + " " + prose(rng, 30)) for i in range(6)]
    rows += [(10, prose(rng, 200)), (11, "Go. " * 40), (12, None), (13, ""), (None, passage), (14, passage), (14, passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = df.withColumn("k", spans.row_key(df["text"])).collect()
    want = plain_repeats([(r.doc_id, r.k, r.text) for r in keyed if r.text])
    got = spans.find_repeats(df).collect()
    assert {(r.doc_id, r.sentences_removed) for r in got} == {(k[0], len(v)) for k, v in want.items()}
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 11, 14, None}
    for r in got:
        if r.doc_id in (1, 2, 3, 4, 5):
            assert passage[60:-60] not in r.text and len(r.text.split()) < 90
    rest = spans.remove_repeats(odd_docs)
    assert rest.columns == odd_docs.columns and rest.count() == odd_docs.count()
    assert spans.remove_repeats(no_docs).count() == 0 and spans.find_repeats(no_docs).count() == 0


def test_sentences_cover_the_text():
    for t in ["", " ", "\n\na.  b!\n", "x" * 50, "one two " * 40 + "\n", "Ende… Neu?! \"Ja.\" Gut", " lead. x"]:
        parts = spans.sentences(t)
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert not t.split() or parts[-1][1] == len(t)


def plain_tiles(p, t, match):
    """Greedy string tiling by definition: mark all longest free matches, again and again."""
    p, t, out = list(p), list(t), 0
    fp, ft = [True] * len(p), [True] * len(t)
    while True:
        best, found = match, []
        for a in range(len(p)):
            for b in range(len(t)):
                n = 0
                while a + n < len(p) and b + n < len(t) and p[a + n] == t[b + n] and fp[a + n] and ft[b + n]:
                    n += 1
                if n > best:
                    best, found = n, [(a, b)]
                elif n == best:
                    found.append((a, b))
        done = False
        for a, b in found:
            if all(fp[a:a + best]) and all(ft[b:b + best]):
                fp[a:a + best] = ft[b:b + best] = [False] * best
                out += best
                done = True
        if not done:
            return out


def test_tiling_equals_definition():
    rng = random.Random(4)
    for _ in range(200):
        p = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 20))]
        t = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 25))]
        assert sum(n for *_, n in tiling.tiles(p, t, 3)) == plain_tiles(p, t, 3)
    a, b = list(range(1, 20)), list(range(30, 50))
    assert tiling.tiles(a + b, b + a, 5) == [(19, 0, 20), (0, 20, 19)]


def test_leaks(spark, odd_docs, no_docs):
    rng = random.Random(8)
    items = [(1, prose(rng, 40)), (2, prose(rng, 20)), (3, "Cheap cotton lanterns"), (6, "四角い月が出た"), (7, "..."), (4, None), (None, prose(rng, 20)), (5, "")]
    halves = items[0][1].split()
    docs = [(1, prose(rng, 50) + " " + items[0][1] + " " + prose(rng, 9)),
            (2, " ".join(halves[20:]) + " " + prose(rng, 30) + " " + " ".join(halves[:20])),  # reordered
            (3, " ".join(halves[:12])), (4, prose(rng, 60)), (5, items[1][1].upper().replace(".", "!")), (6, None),
            (None, items[1][1]), (7, items[0][1]), (7, items[0][1]), (8, "so cheap cotton lanterns!"),
            (9, "cheap lanterns cotton"), (10, "昨夜、四角い月が出た。"), (11, "四角い皿")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for bits in (8, tiling.MAP_BITS):  # a bitmap that is full only costs time
        got = tiling.leaks(df, bench, map_bits=bits).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (5, 2), (None, 2), (7, 1), (8, 3), (10, 6)} and len(got) == 7
    assert {r.doc_id for r in tiling.drop_leaks(df, bench).collect()} == {3, 4, 6, 9, 11}
    assert tiling.drop_leaks(odd_docs, bench).columns == odd_docs.columns
    assert tiling.leaks(no_docs, bench).count() == 0 and tiling.leaks(df, bench.limit(0)).count() == 0


def test_quality(spark, odd_docs, no_docs):
    rows = cotraining.op1_cotraining_quality(spark, SF).alias("r").join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.quality is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score > 0.5) == bool(r.quality) for r in held]) > 0.93
    assert np.mean([r.keep for r in held if r.quality]) > 0.97
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(None, 1, 0), (3, None, 1), (4, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    assert cotraining.quality(odd_docs, labels).count() == odd_docs.count()
    assert cotraining.quality(no_docs, labels).count() == 0
    assert {r.score for r in cotraining.quality(odd_docs, labels.limit(0)).collect()} == {0.5}
