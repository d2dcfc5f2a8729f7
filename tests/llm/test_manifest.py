import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trafficlens.llm import manifest as M


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row, text):
    out = ""
    for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def level_up(nodes):
    return [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]


def climb(nodes, at, x):
    """Root of the tree, the siblings met on the way from place ``at``, and the root that follows from ``x``."""
    siblings = ""
    while len(nodes) > 1:
        run = nodes[at - at % 8:][:8]
        siblings += "".join(run[:at % 8] + run[at % 8 + 1:])
        x = sha("".join(run[:at % 8] + [x] + run[at % 8 + 1:]))
        nodes, at = level_up(nodes), at // 8
    return nodes[0], siblings, x


def plain(rows):
    groups = {}
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        text = r["text"]
        seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if hit and text is not None else text
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, text), leaf(r, seen)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted(groups[g]) for g in names}
    subroots = [climb([x[2] for x in leaves[g]], 0, "")[0] for g in names]
    out = []
    for k, g in enumerate(names):
        for at, (known, doc, true, seen) in enumerate(leaves[g]):
            sub, below, x = climb([x[2] for x in leaves[g]], at, seen)
            root, above, x = climb(subroots, k, x)
            out.append((doc if known else None, true, sub, root, sha(below + above), x, x == root))
    return out


def check(df):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = [tuple(r) for r in M.manifest(df, F.when(hit, lowered).otherwise(F.col("text"))).collect()]
    want = plain([r.asDict() for r in df.select(*M.FIELDS).collect()])
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_odd_documents(odd_docs):
    check(odd_docs)


def test_no_documents(no_docs):
    assert check(no_docs) == []


def test_a_lone_document_is_its_own_root(spark):
    [row] = check(spark.createDataFrame([(2, "s", "en", 3, "Abc")], "doc_id bigint, source string, lang string, n_chars bigint, text string"))
    assert row[1] == row[2] == row[3] and row[4] == sha("")


@pytest.mark.parametrize("n", [8, 9, 64, 65, 513, 4097])
def test_trees_of_every_height_and_last_runs_of_one(spark, n):
    rng = random.Random(n)
    rows = [(i, "s", "de", 1, f"T{rng.randrange(9)}") for i in range(n)] + [(i, None, None, None, None) for i in range(9)]
    check(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(7))


def test_more_languages_than_one_run_and_a_repeated_row(spark):
    rows = [(i, "s", f"l{i % 70}" if i % 71 else None, 1, "Some Text") for i in range(600)] + [(5, "s", "l5", 1, "Same")] * 300
    check(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(6))
