import inspect

import corpus_pipeline as P
from trafficlens.llm import tiling

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        docs = P.materialise(stage(spark, docs, SF))
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before and (name != "substring_dedup" or after == before)
        before = after
    last = P.run(spark, SF).collect()
    assert len(last) == before and all(r.decoded_ok and r.n_pieces == len(r.pieces) for r in last)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert tiling.leaks(docs, items).count() == 0


def test_stages_take_odd_and_empty_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in P.STAGES:
            assert stage(spark, docs, SF).count() >= 0
