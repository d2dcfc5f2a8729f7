"""Policies, identities, routing, request rewriting and prices on hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from trafficlens.functions import body as B
from trafficlens.functions import scalars as S
from trafficlens.functions.fixed_values import ROUTING_RULES
from trafficlens.operators import cache, identity, policy, routing
from trafficlens.plans import govern as G


def col(spark, value, data_type="string"):
    return spark.createDataFrame([(value,)], f"x {data_type}")


def test_missing_parts_of_a_policy(spark):
    rows = [("bare", "{}"), ("off", '{"dlp":{"enabled":false,"detect":["ssn"]},"promptGuard":{"enabled":false}}'),
            ("on", '{"dlp":{"detect":["ssn"]},"promptGuard":{"blockThreshold":0},"logging":{"retentionDays":7}}'),
            ("custom", '{"dlp":{"customPatterns":[{"name":"n","regex":"x"}]}}')]
    got = {r.name: r for r in policy.parse_policies(spark.createDataFrame(rows, "name string, config string")).collect()}
    assert (got["bare"].detect, got["bare"].guard_enabled, got["bare"].block_threshold) == ([], True, 0.75)
    assert (got["bare"].dlp_action, got["bare"].allowed_providers, got["bare"].retention_days) == ("block", [], 90)
    assert (got["off"].detect, got["off"].guard_enabled) == ([], False)
    assert (got["on"].detect, got["on"].block_threshold, got["on"].retention_days) == (["ssn"], 0.0, 7)
    assert got["custom"].detect == []


def test_stored_policy_wins_whole(spark):
    schema = "name string, detect array<string>, retention_days bigint"
    stored = spark.createDataFrame([("p", None, 1)], schema)
    config = spark.createDataFrame([("p", ["ssn"], 2), ("q", ["iban"], 3)], schema)
    named = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "none"), ("d", None)], "label string, policy_name string")
    got = {r.label: (r.source, r.detect, r.retention_days) for r in policy.policy_resolve(named, stored, config).collect()}
    assert got == {"a": ("db", None, 1), "b": ("config", ["iban"], 3), "c": (None, None, None), "d": (None, None, None)}


def test_apply_policy_order_of_events(spark):
    schema = ("request_id bigint, outcome string, source string, found_types array<string>, score double, labels array<string>, "
              "detect array<string>, dlp_action string, guard_enabled boolean, block_threshold double, "
              "allowed_providers array<string>, provider string")
    base = ("db", ["ssn"], 0.9, ["jailbreak"], ["ssn"])
    rows = [(1, "ok", *base, "block", True, 0.5, ["openai"], "groq"), (2, "ok", *base, "redact", True, 0.5, ["openai"], "groq"),
            (3, "ok", *base, "log", True, 0.95, ["openai"], "groq"), (4, "ok", *base, "log", False, 0.0, [], "groq"),
            (5, "429", *base, "block", True, 0.5, ["openai"], "groq"),
            (6, "ok", None, ["ssn"], 0.9, [], None, None, None, None, None, "groq")]
    got = {r.request_id: (r.outcome, [(e.seq, e.action) for e in r.events], r.redact_with)
           for r in G.apply_policy(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("dlp_blocked", [(1, "dlp_blocked")], None),
        2: ("injection_blocked", [(1, "dlp_redacted"), (2, "injection_blocked")], ["ssn"]),
        3: ("provider_blocked", [(1, "dlp_logged"), (2, "provider_blocked")], None),
        4: ("ok", [(1, "dlp_logged")], None), 5: ("429", [], None), 6: ("ok", [], None)}


def test_auth_and_allowlist(spark):
    tokens = spark.createDataFrame([("u", "t1", "gpt-4o", 3, 0, None), ("v", "t2", None, 1, 1, None), ("w", "t3", "", 0, 0, "p")],
                                   "label string, token string, allowed_models_csv string, rpm_limit bigint, revoked int, policy_name string")
    asked = spark.createDataFrame([(1, "t1", "gpt-4o-mini"), (2, "t1", "gpt-4"), (3, "t1", "claude"), (4, "t2", "x"), (5, "t3", "x"),
                                   (6, None, "x"), (7, "t1", "")], "request_id int, bearer string, model string")
    resolved = identity.model_allow(identity.auth_resolve(asked, tokens, required=True))
    got = {r.request_id: (r.label, r.rpm_limit, r.outcome, r.allowed) for r in resolved.collect()}
    assert got == {1: ("u", 3, "ok", True), 2: ("u", 3, "ok", True), 3: ("u", 3, "ok", False), 4: ("anonymous", 0, "401", True),
                   5: ("w", 0, "ok", True), 6: ("anonymous", 0, "401", True), 7: ("u", 3, "ok", True)}
    bulk = {r.request_id: r.allowed for r in identity.model_allow_join(asked, tokens).collect()}
    assert bulk == {k: v[3] for k, v in got.items()}


def test_provider_resolution(spark):
    rows = [("groq", ""), (None, "sk-ant-abc123"), (None, "gsk_test"), (None, ""), ("custom", "gsk_"), ("azure-openai", "Bearer sk-ant-x")]
    df = spark.createDataFrame(rows, "h string, a string")
    got = [r.p for r in df.select(policy.provider_resolve(F.col("h"), F.col("a")).alias("p")).collect()]
    assert got == ["groq", "anthropic", "groq", "anthropic", "custom", "anthropic"]


def test_forward_headers(spark):
    def scrub(headers, provider, key=None):
        df = spark.createDataFrame([(headers, provider, key)], "h map<string,string>, p string, k string")
        return df.select(B.scrub_headers(F.col("h"), F.col("p"), F.col("k")).alias("o")).first().o

    version = {"anthropic-version": "2023-06-01"}
    assert scrub({"authorization": "Bearer sk-ant-abc"}, "anthropic") == {"x-api-key": "sk-ant-abc", **version}
    assert scrub({"authorization": "Bearer sk-openai-abc"}, "openai") == {"authorization": "Bearer sk-openai-abc"}
    assert scrub({"X-Gateway-Provider": "a", "x-gateway-session-id": "s", "Content-Type": "j", "HOST": "h"}, "openai") == \
        {"content-type": "j"}
    assert scrub({"Authorization": "Bearer user", "x-api-key": "u"}, "anthropic", "up") == {"x-api-key": "up", **version}
    assert scrub({"Authorization": "Bearer user"}, "groq", "up") == {"authorization": "Bearer up"}
    assert scrub({"authorization": "Bearer a", "x-api-key": "b", "Anthropic-Version": "9"}, "anthropic") == \
        {"authorization": "Bearer a", "x-api-key": "b", "anthropic-version": "9"}


def test_cache_breakpoints(spark):
    def mark(system, tools=None):
        df = spark.createDataFrame([(system, tools)], "s string, t string").select(
            F.parse_json("s").alias("s"), F.from_json("t", "array<map<string,variant>>").alias("t"))
        row = df.select(F.to_json(B.mark_system(F.col("s"))).alias("s"), F.to_json(B.mark_blocks(F.col("t"))).alias("t")).first()
        return [v and json.loads(v) for v in row]

    mark_of = {"type": "ephemeral"}
    assert mark('"hi"')[0] == [{"type": "text", "text": "hi", "cache_control": mark_of}]
    assert mark('[{"type":"text","text":"a"},{"type":"text","text":"b"}]')[0][1]["cache_control"] == mark_of
    assert mark('[{"type":"text","text":"hi","cache_control":{"type":"ephemeral"}}]')[0] == \
        [{"type": "text", "text": "hi", "cache_control": mark_of}]
    assert mark(None, '[{"name":"search"},{"name":"b","n":{"z":[1]}}]') == \
        [None, [{"name": "search"}, {"name": "b", "n": {"z": [1]}, "cache_control": mark_of}]]
    assert mark("[]", "[]") == [[], []]


def test_prompt_lock(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "system", "again"), (2, 0, "user", "u"), (3, 0, "system", "")],
                                  "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): r.text for r in policy.prompt_lock(turns, "pre", "post").collect()}
    assert got == {(1, 0): "pre\n\ns\n\npost", (1, 1): "again", (2, -1): "pre\n\npost", (2, 0): "u", (3, 0): "pre\n\npost"}
    assert policy.prompt_lock(turns, "", None).count() == 4
    message = "array<struct<role: string, content: string>>"
    df = spark.createDataFrame([([("user", "u"), ("system", "s"), ("system", "t")],), ([("user", "u")],), (None,)], f"m {message}")
    out = [r.m for r in df.select(policy.lock_messages(F.col("m"), "pre", None).alias("m")).collect()]
    assert [tuple(x) for x in out[0]] == [("user", "u"), ("system", "pre\n\ns"), ("system", "t")]
    assert [tuple(x) for x in out[1]] == [("system", "pre"), ("user", "u")] and out[2] is None


def test_routing(spark):
    rows = [("simple", None, "m"), ("bogus", "What is research?", "m"), (None, "what is it", "m"), (None, "hello", None), (None, None, "m")]
    df = spark.createDataFrame(rows, "h string, t string, m string").withColumn("rule", routing.rule_tier(F.col("t"), ROUTING_RULES))

    def run(mode, classified=None):
        out = df.select(routing.route(F.col("h"), F.col("rule"), F.col("m"), mode, classified=classified).alias("r")).collect()
        return [tuple(r.r) for r in out]

    small, mid, large = "claude-haiku-4-5-20251001", "claude-sonnet-4-6", "claude-opus-4-8"
    assert run("rules") == [("simple", "header", small), ("complex", "rule", large), ("simple", "rule", small),
                            ("standard", "default", mid), ("standard", "default", "m")]
    # Off only for requests without a tier header; an invalid header still runs the rules.
    assert run("off")[1:4] == [("complex", "rule", large), ("standard", "default", "m"), ("standard", "default", mid)]
    assert run("auto", F.lit("nonsense"))[3] == ("standard", "classifier", mid)
    assert run("auto", F.lit("complex"))[4] == ("complex", "classifier", large)
    assert run("auto")[4] == ("standard", "default", "m")


def test_prices(spark):
    names = {"claude-3-5-haiku-20241022": (3.0, 15.0), "claude-haiku-3-5": (0.8, 4.0), "GPT-4o-mini-x": (0.15, 0.6), "gpt-4.1": (2.5, 10.0),
             "gpt-4x1": (3.0, 15.0), "gemini-2-flash": (0.075, 0.3), "meta-llama-3.3": (0.59, 0.79), "": (3.0, 15.0), None: (3.0, 15.0)}
    df = routing.price_join(spark.createDataFrame([(n,) for n in names], "model string"))
    assert {r.model: (r.price_in, r.price_out) for r in df.collect()} == names
    log = spark.createDataFrame([(1, "claude-opus-4", "gpt-4o-mini", 1000, 10, 0), (2, "gpt-4o-mini", "claude-opus-4", 1000, 10, 0),
                                 (3, "claude-opus-4", "claude-opus-4", 1000, 10, 1)],
                                "id int, original_model string, routed_model string, input_tokens bigint, output_tokens bigint, from_cache int")
    got = {r.id: (r.cost_usd, r.saved_usd) for r in routing.price_request(log).collect()}
    assert got == {1: (0.000156, 0.015594), 2: (0.01575, 0.0), 3: (0.0, 0.01575)}
    with pytest.raises(ValueError):
        routing.price_request(log, [(".*", 0.0375, 1.0)])


def test_body_texts(spark):
    body = {"model": "m", "system": "s", "messages": [{"role": "user", "content": ""}, {"role": "user", "content": [
        {"type": "text", "text": "a"}, {"type": "image", "text": "no"}, {"type": "text", "text": ""}, {"type": "text"}]},
        {"role": "assistant", "content": None}], "prompt": "p", "tools": [1]}
    df = col(spark, json.dumps(body)).select(B.parse_body(F.col("x")).alias("b"))
    row = df.select(B.request_text(F.col("b")).alias("t"), B.last_user_text(B.messages_of(F.col("b.messages"))).alias("u")).first()
    assert row.t == "s\n\na\np" and json.loads(row.u) == body["messages"][1]["content"]
    bare = col(spark, '{"model":"m","system":[{"type":"text","text":"hidden"}]}').select(B.parse_body(F.col("x")).alias("b"))
    assert bare.select(B.request_text(F.col("b")).alias("t")).first().t == ""


def test_request_hash(spark):
    def digest(provider, model, text, system=None):
        df = spark.createDataFrame([(provider, model, [("user", text)], system)],
                                   "p string, m string, c array<struct<role: string, content: string>>, s string")
        return df.select(cache.request_hash(F.col("p"), F.col("m"), F.col("c"), F.col("s")).alias("h")).first().h

    import hashlib
    want = hashlib.sha256('{"provider":"a","model":"m","messages":[{"role":"user","content":"hi \\"é\\"\\n"}]}'.encode()).hexdigest()
    assert digest("a", "m", 'hi "é"\n') == want
    assert digest("a", "m", "x", "sys") != digest("a", "m", "x") != digest("a", "m", "y")


def test_scalars(spark):
    df = col(spark, 1.005, "double")
    assert df.select(S.js_round(F.col("x"), 2).alias("y")).first().y == 1.0
    one = spark.range(1).select(
        S.short_model(F.lit("x/claude-opus-4-claude-4-20251001")).alias("a"), S.short_model(F.lit("gpt-4.1")).alias("b"),
        S.slugify(F.lit(" My Policy!_1 ")).alias("c"), S.label_slug(F.lit("A.b+c@X")).alias("d"),
        S.utf16_length(F.lit("a😀")).alias("e"), S.strip_bearer(F.lit("bearer\tx")).alias("f"),
        S.bearer_value(F.lit("bearer x")).alias("g")).first()
    assert tuple(one) == ("opus4-claude-4", "gpt4.1", "my-policy-_1", "a.b_c_x", 3, "x", "bearer x")


def test_token_upkeep(spark):
    schema = "label string, token string, upstream_key string, allowed_models_csv string, rpm_limit bigint, revoked bigint, created_at bigint, policy_name string"
    base = spark.createDataFrame([("a", "t", "k", "m", 5, 1, 10, "p"), ("b", "t", "k", "m", 5, 0, 10, "p")], schema)
    change = spark.createDataFrame([("a", "n", None, 1, None, 1, None, None, 0, 99), ("c", "n", "z", 1, "q", 0, 7, "r", 1, 99)],
                                   "label string, token string, upstream_key string, has_upstream_key int, allowed_models_csv string, "
                                   "has_allowed_models int, rpm_limit bigint, policy_name string, has_policy_name int, changed_at bigint")
    up = {r.label: tuple(r)[1:] for r in identity.dim_upsert(base, change).collect()}
    assert up == {"a": ("n", None, None, 0, 0, 10, None), "b": ("t", "k", "m", 5, 0, 10, "p"), "c": ("n", "z", "q", 7, 0, 99, "r")}
    patched = {r.label: (r.upstream_key, r.allowed_models_csv, r.rpm_limit, r.policy_name) for r in identity.token_patch(base, change).collect()}
    assert patched == {"a": (None, None, 5, "p"), "b": ("k", "m", 5, "p")}


@pytest.mark.parametrize("pattern,text,found", [
    (r"\bid-\d+\b", "an id-42.", True),
    (r"end$", "the end\n", False),          # $ is the very end, not before a line end
    (r"a.b", "a\rb", False),                # no line end of any kind
    (r"\bé", "xé", True),                   # é is no word character, so there is a boundary
    (r"[\s]x", " x", True),
    (r"(?<year>\d{4})", "in 1999", True),
    (r"(", "(", False),                      # broken: skipped
])
def test_patterns_of_policies_follow_ecmascript(spark, pattern, text, found):
    from trafficlens.functions.custom import custom_found
    rows = spark.createDataFrame([(text, [pattern])], "t string, p array<string>")
    assert rows.select(custom_found(F.col("t"), F.col("p")).alias("f")).first().f == ([pattern] if found else [])


def test_patterns_of_policies_mask_in_order_and_keep_nulls(spark):
    from trafficlens.functions.custom import custom_masked, custom_masked_each
    rows = spark.createDataFrame(
        [("a1 b2", [("one$", "[a-z]1"), ("bad", "("), ("two", r"b\d")]), (None, [("x", "x")]), ("a1", None), ("a1", [])],
        "t string, p array<struct<name: string, regex: string>>")
    got = [r.m for r in rows.select(custom_masked(F.col("t"), F.col("p")).alias("m")).collect()]
    assert got == ["[ONE$-REDACTED] [TWO-REDACTED]", None, "a1", "a1"]
    each = rows.select(custom_masked_each(F.array("t", F.lit(None)), F.col("p")).alias("m")).collect()
    assert [r.m for r in each] == [[g, None] for g in got]


def test_parsed_policy_keeps_its_own_patterns_only_where_it_scans(spark):
    rows = [("a", '{"dlp":{"detect":["ssn"],"customPatterns":[{"name":"n","regex":"r"},{"name":"no"}]}}'),
            ("b", '{"dlp":{"customPatterns":[{"name":"n","regex":"r"}]}}'),
            ("c", '{"dlp":{"enabled":false,"detect":["ssn"],"customPatterns":[{"name":"n","regex":"r"}]}}'), ("d", "{")]
    got = {r.name: r.custom for r in policy.parse_policies(spark.createDataFrame(rows, "name string, config string")).collect()}
    assert [(c.name, c.regex) for c in got["a"]] == [("n", "r")]
    assert got["b"] == got["c"] == got["d"] == []


ODD_BODIES = [  # body, why it is refused
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("{broken", "not_json"), ("[]", "not_object"), ("null", "not_object"),
    ('"text"', "not_object"), ("7", "not_object"), ('[{"messages":[{"content":"SSN 123-45-6789"}]}]', "not_object"),
    ('{"messages":[{"role":"user","content":"SSN 123-45-6789"}]', "not_json"), ("{'model':'m'}", "not_json"),
    ('{"messages":[]} SSN 123-45-6789', "not_json"), ('{"a":1}{"b":2}', "not_json"), ('{"a":1},{"b":2}', "not_json"),
    ('{"a":1}]', "not_json"), ('{"a":NaN}', "not_json"), ('[1,', "not_json"), ('{"a":1},0],{}', "not_json"),
    ('{"messages":[{"role":"user","role":"x","content":"a"}]}', "not_json"),
    ('{"messages":null}', None), ('{"messages":[{"role":"user"}]}', None), ('{"messages":"SSN 123-45-6789"}', None),
    ('{"messages":[{"role":"user","content":"SSN 123-45-6789"},{"role":"user","content":null}],"system":null}', None),
    ('{"messages":["x",{"role":"user","content":"SSN 123-45-6789"}]}', None),
    ('{"messages":[null,7,[],{"content":{"a":1}},"{\\"content\\":\\"y\\"}",{"role":5,"content":"SSN 123-45-6789"}],"stream":"yes"}', None),
    ('  {"model":{"a":1},"messages":[{"role":"user","content":[null,{"type":"text","text":"SSN 123-45-6789"}]}]}\n', None),
    ('{"prompt":["p"],"system":"SSN 123-45-6789","messages":{"role":"user"}}', None)]


@pytest.mark.parametrize("action", ["block", "redact"])
def test_odd_bodies_are_refused_or_scanned(spark, action):
    from trafficlens.plans.govern import govern_bodies
    rows = spark.createDataFrame([(i, 100 + i, "t", "openai", "gpt-4o", b) for i, (b, _) in enumerate(ODD_BODIES)],
                                 "request_id bigint, created_at bigint, bearer string, provider string, model string, body string")
    tokens = spark.createDataFrame([("t", "u", 0, None, "p", 0)],
                                   "token string, label string, rpm_limit bigint, allowed_models_csv string, policy_name string, revoked int")
    stored = policy.parse_policies(spark.createDataFrame(
        [("p", '{"dlp":{"action":"' + action + '","detect":["ssn"],"customPatterns":[{"name":"w","regex":"SSN"}]}}')],
        "name string, config string"))
    got = {r.request_id: r for r in govern_bodies(rows, tokens, stored, stored.limit(0)).collect()}
    assert len(got) == len(ODD_BODIES)
    for i, (body, error) in enumerate(ODD_BODIES):
        # Only an array of messages is scanned, so a string in its place says nothing.
        finds = error is None and "123-45" in body and not body.startswith('{"messages":"SSN')
        want = "400" if error else "dlp_blocked" if finds and action == "block" else "ok"
        assert (got[i].error, got[i].outcome) == (error, want), body
        assert (got[i].redact_with is not None) == (finds and action == "redact"), body
        assert (got[i].cache_key is None) == (error is not None)


def test_a_refused_body_counts_for_no_limit(spark):
    from trafficlens.plans.govern import govern_bodies
    rows = spark.createDataFrame([(i, 100, "t", "openai", "m", "{" if i < 3 else "{}") for i in range(5)],
                                 "request_id bigint, created_at bigint, bearer string, provider string, model string, body string")
    tokens = spark.createDataFrame([("t", "u", 1, None, None, 0)],
                                   "token string, label string, rpm_limit bigint, allowed_models_csv string, policy_name string, revoked int")
    stored = policy.parse_policies(spark.createDataFrame([("p", "{}")], "name string, config string"))
    got = {r.request_id: r.outcome for r in govern_bodies(rows, tokens, stored, stored.limit(0), required=True).collect()}
    assert got == {0: "400", 1: "400", 2: "400", 3: "ok", 4: "429"}


def test_archive_keeps_what_it_cannot_read(spark, tmp_path):
    from trafficlens.sources import archive
    lines = [json.dumps({"request_id": i, "body": b}) for i, (b, _) in enumerate(ODD_BODIES)] + ["{cut off", "[1, 2]"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    good, rejected = archive.quarantine(archive.read_requests(spark, str(tmp_path)))
    errors = {r.request_id: r.error for r in rejected.collect() if r.request_id is not None}
    assert errors == {i: e for i, (_, e) in enumerate(ODD_BODIES) if e}
    assert {r.raw for r in rejected.filter("request_id IS NULL").collect()} == {"{cut off", "[1, 2]"}
    assert {r.outcome for r in rejected.collect()} == {"400"}
    texts = {r.request_id: r.request_text for r in good.collect()}
    assert set(texts) == {i for i, (_, e) in enumerate(ODD_BODIES) if e is None}
    assert sum("123-45" in t for t in texts.values()) == 5


def test_text_and_variant_form_of_a_request_hash_agree(spark):
    from trafficlens.operators.cache import request_hash, request_hash_of
    raw = '[{"role":"user","content":"a \\"b\\" ü"},{"content":[{"text":"t","type":"text"}],"role":"user"}]'
    df = col(spark, raw).select(F.from_json("x", "array<map<string,variant>>").alias("m"), F.parse_json(F.lit('"s"')).alias("s"))
    one = request_hash(F.lit("p"), F.lit('m"'), F.col("m"), F.col("s"))
    other = request_hash_of(F.lit("p"), F.lit('m"'), F.transform("m", lambda e: F.to_json(e)), F.col("s"))
    bare = [request_hash(F.lit("p"), F.lit(None).cast("string"), F.col("m")),
            request_hash_of(F.lit("p"), F.lit(None).cast("string"), F.transform("m", lambda e: F.to_json(e)))]
    row = df.select(one, other, *bare).first()
    assert row[0] == row[1] and row[2] == row[3]


def test_many_keywords_give_what_the_single_searches_give(spark):
    import random
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(2, 9)))
    texts = ["".join(rng.choice("abC ") for _ in range(rng.randrange(0, 60))) for _ in range(400)] + [None, "", "İSTANBUL ß"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    lists = [[("x", [word() for _ in range(40)]), ("y", ["ABC", "aa"]), ("z", [word() for _ in range(90)])],
             [("x", ["zzz"]), ("y", []), ("z", ["", "a"])], [("x", []), ("y", [])], [("x", ["same", "a"]), ("y", ["a", "same"])],
             [("x", ["i̇stan"]), ("y", ["ss", "ß"])]]
    for rules in lists:
        got = df.select(routing.keyword_rule(F.col("low"), rules).alias("a"), routing.rule_tier_of_lowered(F.col("low"), rules).alias("b"))
        assert [r for r in got.collect() if r.a != r.b] == []
