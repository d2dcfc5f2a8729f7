import random
import re

from trafficlens.llm import urlfilter as U

SCHEMA = "page_id bigint, url string, html string, host string, rule string"


def plain(url, rules):
    """Host, path, rule and verdict, trying every rule in turn."""
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if None not in (h, p, v)
            and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i if i % 9 else None, u, None, "clash", "clash") for i, u in enumerate(urls)], SCHEMA)
    listed = spark.createDataFrame(rules, "host string, path string, verdict string, note string")
    got = [tuple(r) for r in U.filter_urls(pages.repartition(3), listed).collect()]
    want = [(i if i % 9 else None, *plain(u, [r[:3] for r in rules])) for i, u in enumerate(urls)]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


ODD = ["http://Example.NET/en/x?q=/de/#f", "https://a.b.example.com/de/", "https://example.com/de", "ftp://net", "http://net/",
       "http://net?x/", "http://net#/", "http://org/fr/y", "http://xorg/fr/", "no scheme", "", None, "http://", "://", "http:///fr/",
       "http://a..net//x//", "http://.net/", "http://example.net:80/en/", "http://ÄÖ.İ.org/fr/ü", "a://b://c.net/", "http://net/\n?x",
       "http://x.net/" + "d/" * 3000, "http://" + "s." * 2000 + "net/en/", "http://example.net/EN/"]


def test_the_given_rules_on_odd_urls(spark):
    check(spark, ODD + ODD[:5], [(*r, "") for r in U.RULES])


def test_many_rules_with_deep_and_partial_paths(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join(rng.choice(["/", "x", "y", "/"]) for _ in range(rng.randrange(0, 6)))
    rules = [(host(), path(), rng.choice(["block", "allow"]), "n") for _ in range(300)]
    rules += [("a", "/", "block", ""), ("a", "/", "allow", ""), (None, "/", "block", ""), ("b", None, "block", ""), ("", "", "block", "")]
    got = check(spark, [f"http://{host()}{path()}" for _ in range(2000)] + ODD, rules)
    assert len({r[3] for r in got}) > 50


def test_no_rows_and_no_rules(spark):
    assert check(spark, [], [(*U.RULES[0], "")]) == []
    assert {r[4] for r in check(spark, ODD, [(None, None, None, None)])} == {"allow"}


def test_different_expressions_with_the_same_short_key(spark, monkeypatch):
    monkeypatch.setattr(U, "PREFIX", 1)
    check(spark, ODD, [(*r, "") for r in U.RULES])


def test_plan_reads_the_url_only(spark):
    plan = U.op13_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "html" not in plan[plan.index("== Physical Plan =="):] and "CartesianProduct" not in plan
