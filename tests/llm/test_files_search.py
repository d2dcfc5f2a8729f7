import hashlib
import zlib

import numpy as np
import pytest

from trafficlens.llm import archives, neighbours, sharding
from trafficlens.llm.common import shared_dir


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(spark, version):
    long = "x" * 150
    rows = [(5, "http://a/ b%20c", long), (2, None, long), (9, "http://a/", long), (7, "", "short"), (8, "-", "short"),
            (1, "http://é/", None), (3, "u", ""), (None, "u", long), (4, "u", "a\r\n\r\nHTTP/1.1\n" * 20), (6, "u", "y" * 300_000),
            (10, "u", "é" * 50), (11, "u", "é" * 50), (11, "u", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "url AS path", "html AS digest")
    folder = shared_dir(spark)
    arcs = archives.pages_to_arc(pages.repartition(3), f"{folder}/arc", version)
    got = archives.read_warc(archives.arc_to_warc(arcs, f"{folder}/warc"), with_payload=True).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    responses = {r.record_id: r for r in got if r.record_type == "response"}
    url_of = {}
    for i, url, html in rows:
        url_of.setdefault(i, set()).add(url)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        raw = html.encode()
        assert r.digest == hashlib.sha256(raw).hexdigest() and r.url in url_of[r.page_id] and r.date == "2024-01-01T00:00:00Z"
        if r.record_type == "response":
            assert bytes(r.payload) == raw and r.refers_to is None
            assert len(raw) < 100 or first[html] == r.page_id
        else:
            assert len(raw) >= 100 and r.refers_to == first[html] == responses[r.refers_to_id].page_id
    large = [r.digest for r in responses.values() if r.bytes >= 100]
    assert len(large) == len(set(large))
    empty = archives.pages_to_arc(pages.limit(0), f"{folder}/none", version)
    assert archives.read_warc(archives.arc_to_warc(empty, f"{folder}/none")).count() == 0


def test_arc_errors():
    fields = archives.FIELDS_1.split(" ")
    with pytest.raises(ValueError):
        archives.parse_arc(b"http://a 1.1.1.1 20240101000000 text/html 9\nshort\n", fields)
    with pytest.raises(ValueError):
        archives.parse_arc(b"http://a b 1.1.1.1 20240101000000 text/html 5\nshort\n", fields)
    with pytest.raises(ValueError):
        archives.parse_version(b"http://x 0 0 0 0\n")
    plain = archives.parse_arc(b"dns:a 1.1.1.1 2024 text/dns 5\nshort\n", fields)
    head, block = archives.parse_warc(archives.convert(plain, "p@1", "00"))
    assert head["warc-type"] == "resource" and block == b"short" and head["warc-date"] == "2024-00-00T00:00:00Z"


def plain_search(rows, queries, k):
    want = {}
    for q in queries:
        v = rows[q]
        near = sorted(((-float(np.dot(v, w)), i) for i, w in rows.items() if i != q))[:k]
        want[q] = [i for _, i in near]
    return want


def test_search_recall_and_ties(spark):
    sf = "/root/testdata/sf0.1"
    got = {}
    for r in neighbours.op4_permutation_index(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    data = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = plain_search(data, [i for i in data if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({r.vec_id for r in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9
    for q, rows in got.items():
        assert [r.rank for r in rows] == list(range(1, 21))
        assert all(np.isclose(r.score, data[q] @ data[r.vec_id], rtol=1e-12) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)


def test_search_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(40, [0.0, 2.0]), (41, [0.0, 0.0]), (42, None), (43, [nan, 1.0]), (44, [inf, 1.0]),
            (45, [1.0]), (46, [None, 1.0]), (None, [1.0, 1.0]), (60, [3.0, 1.0]), (60, [3.0, 1.0]), (80, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "vec_id AS v", "vec_id AS entry")
    ask = df.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id")
    got = {}
    for r in neighbours.search(df, ask).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    data = {i: np.array(v) for i, v in rows if i is not None and (i <= 40 or i == 60)}
    assert got == plain_search(data, [0, 20, 40, 60], 20)
    few = df.where("vec_id IN (0, 40, 60)")
    assert neighbours.search(few, ask).count() == 6
    assert neighbours.search(df.limit(0), ask).count() == 0


def test_shards(spark, odd_docs, no_docs):
    rows, current, path = sharding.shard_documents(odd_docs, shards=5)
    got = rows.collect()
    assert len(got) == odd_docs.count()
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    stored = spark.read.parquet(path)
    assert stored.groupBy("version").count().count() == 2 and stored.count() == 2 * sharding.SLOTS
    assert sharding.shard_documents(no_docs)[0].count() == 0


def test_rebalance_moves_little_and_evens_out():
    rng = np.random.default_rng(3)
    sizes = {s: int(rng.pareto(1.5) * 1000) + 1 for s in range(sharding.SLOTS)}

    def loads(m):
        out = [0] * m.shards
        for slot, shard in enumerate(m.current):
            out[shard] += sizes[slot]
        return out
    first = sharding.rebalance(sharding.initial_map(24), sizes)
    assert max(loads(first)) - min(loads(first)) < 0.01 * max(loads(first))
    same = sharding.rebalance(first, sizes)
    assert same.current == first.current and same.moved() == 0
    grown = sharding.rebalance(first, sizes, 25)
    assert grown.moved() < sharding.SLOTS / 10 and max(loads(grown)) < 1.02 * sum(sizes.values()) / 25
    shrunk = sharding.rebalance(grown, sizes, 20)
    assert set(shrunk.current) == set(range(20)) and max(loads(shrunk)) < 1.02 * sum(sizes.values()) / 20


def test_shards_are_near_equal_and_written_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, current, _ = sharding.shard_documents(docs)
    size = {r.shard: r.b for r in rows.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()}
    assert len(size) == 24 and max(size.values()) - min(size.values()) < 0.01 * max(size.values())
    path = f"{shared_dir(spark)}/shards"
    sharding.write_shards(docs, current, path)
    back = spark.read.parquet(path)
    want = {(r.doc_id, r.shard) for r in rows.collect()}
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()} == want
