import random

import corpus_pipeline as P
from tests.llm.conftest import prose
from trafficlens.llm import shingles

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_groups(rows):
    """Smallest id of each component of all pairs that share 0.8 of their shingles."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if 5 * len(sets[a] & sets[b]) >= 4 * union:
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return [low.get(find(a)) for a in range(len(rows))]


def edited(rng, words, edits):
    """A copy in which single words are replaced, spread over the text."""
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"edit{rng.randrange(10**6)}"
    return words


def corpus():
    """Base texts with copies of similarity 0.6 to 1, and one crowded group."""
    rng, rows = random.Random(6), []
    for _ in range(60):
        words = prose(rng, rng.randrange(40, 300)).split()
        rows.append(" ".join(words))
        for share in (0, 0.004, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05):
            rows.append(" ".join(edited(rng, words, round(share * len(words)))))
    hot = prose(rng, 200).split()
    rows += [" ".join(edited(rng, hot, rng.randrange(1, 7))) for _ in range(60)]
    rng.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


def test_near_copies_from_08_on_are_one_group(spark):
    rows = corpus()
    want = dict(zip([i for i, _ in rows], plain_groups(rows)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for chunk in (shingles.CHUNK, 8):
        got = {r.doc_id: r.component_id for r in shingles.similar_groups(df, chunk=chunk).collect()}
        assert got == want
    stage = dict(P.STAGES)["simhash_near_dedup"]
    assert {r.doc_id for r in stage(spark, df, SF).collect()} == set(want.values())


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted(map(str, zip([i for i, _ in rows], plain_groups(rows))))
    got = shingles.similar_groups(odd_docs).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == want
    kept = shingles.drop_similar(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({r.component_id for r in got})
    assert shingles.similar_groups(no_docs).count() == 0


def test_fingerprints_are_simhash_of_the_shingles():
    rng = random.Random(15)
    for n in (0, 1, 4, 5, 6, 30, 5000):
        found = shingles.shingles(prose(rng, n)) if n else shingles.shingles(None)
        votes = [sum(int(h) >> k & 1 for h in found) for k in range(64)]
        assert shingles.fingerprint(found) == sum(1 << k for k, v in enumerate(votes) if 2 * v > len(found))


def test_the_stage_searches_by_simhash_first(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    prints = shingles.shingle_prints(df).cache()
    sim = {r.fp: r.sim % 2**64 for r in prints.collect()}
    root = {fp: fp for fp in sim}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in shingles.close_pairs(prints).collect():
        root[find(a)] = find(b)
    names = sorted(sim)
    near = [(a, b) for a in names for b in names if a < b and (sim[a] ^ sim[b]).bit_count() <= shingles.BITS]
    assert len(near) > 50 and all(find(a) == find(b) for a, b in near)
    # What SimHash joins is not compared again; MinHash alone no longer carries the stage.
    seen, verified = [], shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, sets: seen.append(pairs.count()) or verified(pairs, sets))
    assert shingles.drop_similar(df).count() == len(set(plain_groups(rows)))
    assert len(seen) == 2 and seen[0] > 0


def test_cells_are_not_written_as_a_table_of_their_own(spark, monkeypatch):
    """40 cells of every set are read from the prints; only those in which sets meet are written."""
    written, write = [], shingles.materialise

    def noted(df):
        out = write(df)
        written.append((set(df.columns), out.count()))
        return out
    monkeypatch.setattr(shingles, "materialise", noted)
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:1])), "doc_id bigint, text string")
    assert shingles.drop_similar(df).count() == 30
    assert [n for columns, n in written if "cell" in columns and n > 0] == []
