import random

from tests.llm.conftest import prose
from trafficlens.llm import spans


def test_unpunctuated_passages_are_found_in_any_surroundings():
    rng = random.Random(12)
    for _ in range(1500):
        passage = [rng.choice(("the", "of", f"w{rng.randrange(400)}")) for _ in range(51)]
        texts = [" ".join(prose(rng, rng.randrange(0, 40)).replace(".", "").split() + passage
                          + prose(rng, rng.randrange(0, 40)).replace(".", "").split()) for _ in range(2)]
        one, other = (set(spans.runs(spans.sentences(t))[2].tolist()) for t in texts)
        assert one & other


def test_cuts_are_the_least_pairs_of_windows():
    rng = random.Random(13)
    for _ in range(200):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(13, 60))]
        text = " ".join(words) + " "
        want, whole = set(), spans._cuts([words])[0]
        for k in range(len(words) - 8):  # a window alone cuts where the whole sentence does
            want.update(k + c for c in spans._cuts([words[k:k + 9]])[0])
        assert sorted(want) == whole
        assert [p[2] for p in spans.sentences(text)] == [b - a for a, b in zip([0, *whole], [*whole, len(words)])]


def test_runs_that_stand_alone_are_left_out_in_one_shuffle(spark):
    rng = random.Random(14)
    rows = [(k, k % 7, 0, 3, rng.choice((5, rng.randrange(-800, 800)))) for k in range(3000)]
    want = [h for *_, h in rows]
    want = sorted(r for r in rows if want.count(r[-1]) > 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        every = spark.createDataFrame(rows, "doc_id bigint, k_text bigint, first int, count int, h bigint")
        shared = spans._shared(every)
        assert sorted(map(tuple, shared.collect())) == want
        assert spans._shared(every.where("false")).count() == 0
        plan = shared._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Repartition") == 1 and "Join" not in plan and "Aggregate" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
