import random

import xxhash

from trafficlens.llm import simhash
from trafficlens.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, bits):
    """Smallest id reachable, by flooding."""
    ids = [i for i, _ in items]
    root = list(range(len(items)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(items)):
        for b in range(a):
            if (items[a][1] ^ items[b][1]).bit_count() <= bits:
                root[find(a)] = find(b)
    low = {}
    for a in range(len(items)):
        if ids[a] is not None:
            low[find(a)] = min(low.get(find(a), ids[a]), ids[a])
    return [low.get(find(a)) for a in range(len(items))]


def test_fingerprint_is_the_plain_one(odd_docs):
    texts = [r.text for r in odd_docs.select("text").collect() if r.text is None or len(r.text) < 5000]
    texts += ["A b  C\x0bd e", "Ä ö É a b c", "x " * 70_000]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_popcounts_bound_from_below():
    import numpy as np
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 500), np.uint64)
    b[::2] = a[::2] ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
    pa, pb = simhash.popcounts(a), simhash.popcounts(b)
    for x, y, c, d in zip(a, b, pa, pb):
        counts = [[int(v) >> 2 * k & 3 for k in range(32)] for v in (c, d)]
        assert counts[0] == [(int(x) >> 2 * k & 3).bit_count() for k in range(32)]
        assert sum(abs(p - q) for p, q in zip(*counts)) <= (int(x) ^ int(y)).bit_count()


def test_groups_equal_flooding(spark):
    rng = random.Random(5)
    items, n = [], 0
    for size in (1,) * 40 + (3, 10, 120):  # clusters that drift, so that chains reach far
        fp = rng.getrandbits(64)
        for _ in range(size):
            items.append((n, fp))
            n += 1
            for _ in range(rng.randrange(0, 6)):
                fp ^= 1 << rng.randrange(64)
    for bits in (0, 2, 3, 4, 5, 6):
        want = dict(zip([i for i, _ in items], plain_components(items, bits)))
        signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in items]
        prints = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
        for chunk in (simhash.CHUNK, 8) if bits == 4 else (simhash.CHUNK,):
            got = prints.join(simhash.groups(prints, bits, chunk), "fp").collect()
            assert {r.doc_id: r.component_id for r in got} == want


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in odd_docs.where("doc_id != 304 OR doc_id IS NULL").collect()]
    want = sorted(map(str, zip(rows, plain_components(rows, 4))))
    got = simhash.near_duplicates(odd_docs.where("doc_id != 304 OR doc_id IS NULL")).collect()
    assert sorted(str(((r.doc_id, r.fp & (2**64 - 1)), r.component_id)) for r in got) == want
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()}
    assert kept.count() == len({c for _, c in groups})
    assert {r.doc_id for r in kept.collect()} == {c for _, c in groups}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in (7, *range(1000, 1100))}}
