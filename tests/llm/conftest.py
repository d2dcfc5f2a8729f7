import random

import pytest

WORDS = ("river stone light winter paper garden silver market engine window letter summer forest bridge island "
         "mirror shadow harbor village candle").split()


def prose(rng, n):
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) + str(rng.randrange(60)))
        if k % 8 == 7:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, exact and near copies, repeated rows, clashing names."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 120)), rng.choice(["en", "de", None]), "s1", 5) for i in range(60)]
    base = prose(rng, 300)
    rows += [(100 + i, base, "en", "hot", 1) for i in range(5)]
    rows += [(200 + i, base.replace("river", "rivers", 1) + f" end{i}", "en", "hot", 1) for i in range(5)]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, " \n\t ", "en", "s", 4),
             (303, "123 456 !!!", "en", "s", 11), (None, None, None, None, None), (None, "null id text here.", "en", "s", 1),
             (304, prose(rng, 40_000), "en", "s", 9), (305, "é漢字 😀 ▁x y  z\r\n\r\nq \x1c w", "en", "s", 9),
             (306, "one", "en", "s", 3), (306, "one", "en", "s", 3), (306, "another text, same id", "en", "s", 3)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, schema)
    for name in ("k_id", "k_text", "fp", "component_id", "_row_key", "h", "first", "words", "keep", "u", "v"):
        df = df.selectExpr("*", f"doc_id AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
