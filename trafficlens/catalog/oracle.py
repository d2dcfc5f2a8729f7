"""The queries of :mod:`trafficlens.catalog.queries` as plain SQL for the checking engine."""

from __future__ import annotations

from ..functions.fixed_values import (ANTHROPIC_VERSION, DLP_LABELS, DLP_TYPES, GUARD_PATTERNS, INTERCEPTED_ORIGINS,
                                      PERIODS, PRICES, PROVIDERS, RAW_KEY_PATTERNS, ROUTING_RULES, SUMMARY_ACK,
                                      SUMMARY_HEADER, TIER_MODELS, URL_PROVIDERS)
from ..functions.dlp import pattern_of
from ..functions.scalars import period_bounds
from ..sources.views import with_views
from .queries import (APPEND, AS_OF, HOUR_MS, LOOSE, POLICY_PURGE_AT, PREPEND, PURGE_AT, RETAIN, SESSION_CUTOFF, SESSION_SECONDS, TOP_K,
                      TRIGGER, TTL)

ORACLE: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def add(name: str, sql: str, extra: dict[str, str] | None = None, recursive: bool = False) -> None:
    ORACLE[name] = with_views(sql, "duckdb", recursive=recursive, extra=extra)


# --- Fragments -------------------------------------------------------------------------------------------------

def dlp_found(text: str, name: str) -> str:
    return f"regexp_matches({text}, {lit(pattern_of(name))}, 'i')"


def dlp_list(text: str, names, within: str | None = None) -> str:
    cond = lambda n: dlp_found(text, n) if within is None else f"list_contains({within}, '{n}') AND {dlp_found(text, n)}"
    return "list_filter([" + ", ".join(f"CASE WHEN {cond(n)} THEN '{n}' END" for n in names) \
        + "], lambda x: x IS NOT NULL)"


def dlp_redacted(text: str, names, within: str | None = None) -> str:
    for n in names:
        done = f"regexp_replace({text}, {lit(pattern_of(n))}, {lit(DLP_LABELS[n])}, 'gi')"
        text = done if within is None else f"CASE WHEN list_contains({within}, '{n}') THEN {done} ELSE {text} END"
    return text


def guard_cases(text: str, value) -> list[str]:
    out = []
    for pattern, ignore, weight, label in GUARD_PATTERNS:
        options = ", 'i'" if ignore else ""
        out.append(f"CASE WHEN regexp_matches({text}, {lit(pattern)}{options}) THEN {value(weight, label)} END")
    return out


def guard_max(text: str) -> str:
    cases = guard_cases(text, lambda w, _: f"CAST({w} AS DOUBLE)")
    return "coalesce(list_max([" + ", ".join(cases) + "]), CAST(0 AS DOUBLE))"


def guard_labels(text: str) -> str:
    return "list_filter([" + ", ".join(guard_cases(text, lambda _, l: lit(l))) + "], lambda x: x IS NOT NULL)"


def in_order(labels: str) -> str:
    return f"list_filter({labels}, lambda x, i: list_position({labels}, x) = i)"


def price_case(model: str, side: int) -> str:
    whens = " ".join(f"WHEN regexp_matches({model}, {lit(p[0])}, 'i') THEN {round(p[side] * 1000)}" for p in PRICES)
    return f"CASE {whens} END"


def nano(model: str, tin: str = "input_tokens", tout: str = "output_tokens") -> str:
    return f"({tin} * {price_case(model, 1)} + {tout} * {price_case(model, 2)})"


def priced(source: str) -> str:
    full, paid = nano("original_model"), nano("routed_model")
    return f"""SELECT *, CAST(cost_nano AS DOUBLE) / 1e9 AS cost_usd, CAST(saved_nano AS DOUBLE) / 1e9 AS saved_usd FROM (
      SELECT *, CASE WHEN from_cache = 1 THEN 0 ELSE {paid} END AS cost_nano,
        CASE WHEN from_cache = 1 THEN {full} ELSE greatest({full} - {paid}, 0) END AS saved_nano FROM {source})"""


PRICED = {"priced": priced("request_log")}


def r2(x: str, digits: int = 2) -> str:
    p = f"{10 ** digits}e0"
    return f"(CAST(floor(CAST({x} AS DOUBLE) * {p} + 0.5) AS DOUBLE) / {p})"


def csv(col: str) -> str:
    return f"list_filter(string_split(coalesce({col}, ''), ','), lambda x: x <> '')"


IDENTITY = {"ident": f"""SELECT r.*, coalesce(t.label, 'anonymous') AS label, coalesce(t.rpm_limit, 0) AS rpm_limit,
    {csv('t.allowed_models_csv')} AS models, t.policy_name, t.label IS NOT NULL AS known
  FROM requests r LEFT JOIN (SELECT * FROM tokens WHERE revoked = 0) t ON r.bearer = t.token"""}
MODEL_OK = ("(len(models) = 0 OR len(list_filter(models, lambda m: contains(model, m) OR contains(m, model))) > 0)")

EFFECTIVE = {"effective": f"""SELECT name, source, {csv('detect_csv')} AS detect, dlp_action, block_threshold,
    {csv('allowed_providers_csv')} AS allowed, retention_days, system_prepend FROM policies
  WHERE source = 'db' OR name NOT IN (SELECT name FROM policies WHERE source = 'db')"""}


def anchored(points: str, width: int, prefix: str) -> dict[str, str]:
    """CTEs that list the windows of ``points(key, t, rid)`` as ``<prefix>_starts(key, t, rid)``."""
    p = prefix
    return {
        f"{p}_pts": f"SELECT key, t, min(rid) AS rid FROM ({points}) q GROUP BY key, t",
        f"{p}_edge": f"SELECT key, t, min(t) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN {width + 1} FOLLOWING "
                     f"AND UNBOUNDED FOLLOWING) AS nt FROM {p}_pts",
        f"{p}_next": f"SELECT e.key, e.t, n.t AS nt, n.rid AS nrid FROM {p}_edge e JOIN {p}_pts n "
                     f"ON e.key = n.key AND e.nt = n.t",
        f"{p}_starts": f"SELECT key, min(t) AS t, arg_min(rid, t) AS rid FROM {p}_pts GROUP BY key UNION ALL "
                       f"SELECT n.key, n.nt, n.nrid FROM {p}_starts s JOIN {p}_next n ON n.key = s.key AND n.t = s.t",
    }


def limiter(rows: str, width: int, prefix: str) -> dict[str, str]:
    """``<prefix>_verdict(request_id, allowed)`` for ``rows(request_id, label, rpm_limit, ms)``."""
    p = prefix
    return {
        **anchored(f"SELECT label AS key, ms AS t, request_id AS rid FROM {rows} WHERE rpm_limit > 0", width, p),
        f"{p}_placed": f"SELECT a.*, s.t AS start FROM {rows} a ASOF JOIN {p}_starts s "
                       f"ON a.label = s.key AND a.ms >= s.t WHERE a.rpm_limit > 0",
        f"{p}_verdict": f"""SELECT request_id, CASE WHEN row_number() OVER (PARTITION BY label, start
            ORDER BY ms, request_id) <= rpm_limit THEN 1 ELSE 0 END AS allowed FROM {p}_placed
          UNION ALL SELECT request_id, 1 FROM {rows} WHERE rpm_limit <= 0""",
    }


def replay(rows: str, ttl: int, prefix: str) -> dict[str, str]:
    """``<prefix>_out``: ``rows(request_id, created_at, request_hash, can_fill)`` with ``hit`` and ``source_id``."""
    p = prefix
    inside = f"s.t IS NOT NULL AND a.created_at - s.t < {ttl} AND (a.created_at > s.t OR a.request_id > s.rid)"
    return {
        **anchored(f"SELECT request_hash AS key, created_at AS t, request_id AS rid FROM {rows} WHERE can_fill = 1",
                   ttl - 1, p),
        f"{p}_out": f"SELECT a.*, CASE WHEN {inside} THEN 1 ELSE 0 END AS hit, CASE WHEN {inside} THEN s.rid END "
                    f"AS source_id FROM {rows} a ASOF LEFT JOIN {p}_starts s "
                    f"ON a.request_hash = s.key AND a.created_at >= s.t",
    }


# --- Sources, sinks, maintenance -----------------------------------------------------------------------------------

add("read_requests", r"""
SELECT a.request_id, r.model, CASE WHEN a.request_id % 4 = 1 THEN 1 ELSE 0 END AS stream,
  CASE a.request_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_messages,
  CASE a.request_id % 4 WHEN 0 THEN 'be brief' || chr(10) || 'ask ' || r.prompt_id
    WHEN 1 THEN 'terse' || chr(10) || 'ask ' || r.prompt_id || chr(10) || 'more'
    WHEN 2 THEN 'legacy ' || r.prompt_id ELSE '' END AS request_text,
  CASE a.request_id % 4 WHEN 0 THEN 'ask ' || r.prompt_id
    WHEN 1 THEN '[{"text":"ask ' || r.prompt_id || '","type":"text"},{"text":"no","type":"image"},'
      || '{"text":"","type":"text"},{"text":"more","type":"text"}]'
    ELSE '""' END AS last_user, a.body AS raw, 'ok' AS outcome, CAST(NULL AS VARCHAR) AS error
FROM archive a JOIN requests r ON r.request_id = a.request_id""")
_BODY_ERROR = """CASE WHEN body IS NULL OR trim(body) = '' THEN 'empty' WHEN NOT json_valid(body) THEN 'not_json'
  WHEN json_type(body) <> 'OBJECT' THEN 'not_object' END"""
add("bodies_rejected", f"""
SELECT request_id, '400' AS outcome, error FROM (SELECT request_id, {_BODY_ERROR} AS error FROM odd_bodies) q
WHERE error IS NOT NULL""")
add("bodies_accepted", f"""
SELECT o.request_id, r.model, CASE WHEN o.request_id % 12 = 11 THEN 1 ELSE 0 END AS stream,
  CASE o.request_id % 12 WHEN 1 THEN 2 WHEN 6 THEN 4 ELSE 0 END AS n_messages,
  CASE o.request_id % 12 WHEN 8 THEN 'legacy ' || r.prompt_id WHEN 11 THEN 'be brief' ELSE 'ask ' || r.prompt_id END
    AS request_text,
  CASE o.request_id % 12 WHEN 1 THEN 'ask ' || r.prompt_id
    WHEN 6 THEN '[{{"text":"ask ' || r.prompt_id || '","type":"text"}},null,{{"type":"image"}}]' ELSE '""' END AS last_user
FROM odd_bodies o JOIN requests r ON r.request_id = o.request_id WHERE {_BODY_ERROR} IS NULL""")

LOG_ROW = """SELECT CAST(request_id AS VARCHAR) AS id, request_id, provider, routed_model AS model, input_tokens,
  output_tokens, {duration} AS duration_ms, CAST(from_cache AS BIGINT) AS from_cache,
  CASE WHEN from_cache = 1 THEN 'exact' END AS cache_source, CAST(0 AS BIGINT) AS compressed, created_at, original_model,
  routed_model, routing_method, routing_tier, cost_usd, saved_usd, user_label{more} FROM {table}"""
DT = "strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS dt"
add("write_request_log", LOG_ROW.format(duration="CAST(duration_ms AS BIGINT)", more=f", {DT}", table="priced"), PRICED)
add("write_policy_log", f"SELECT *, {DT} FROM policy_log")
add("cache_upsert", """
SELECT id, request_hash, provider, model, created_at, expires_at FROM (
  SELECT *, row_number() OVER (PARTITION BY request_hash ORDER BY created_at DESC, id DESC) AS n FROM (
    SELECT id, request_hash, provider, model, created_at, expires_at FROM cache_entries
    UNION ALL SELECT k.request_id, k.request_hash, k.provider, k.model, k.created_at + 60, k.created_at + 60 + 86400
    FROM request_keys k))
WHERE n = 1""")
add("dim_upsert", """
SELECT coalesce(t.label, c.label) AS label, CASE WHEN c.label IS NOT NULL THEN c.token ELSE t.token END AS token,
  CASE WHEN c.label IS NOT NULL THEN c.upstream_key ELSE t.upstream_key END AS upstream_key,
  CASE WHEN c.label IS NOT NULL THEN c.allowed_models_csv ELSE t.allowed_models_csv END AS allowed_models_csv,
  CAST(CASE WHEN c.label IS NOT NULL THEN coalesce(c.rpm_limit, 0) ELSE t.rpm_limit END AS BIGINT) AS rpm_limit,
  CAST(CASE WHEN c.label IS NOT NULL THEN 0 ELSE t.revoked END AS BIGINT) AS revoked,
  coalesce(t.created_at, c.changed_at) AS created_at,
  CASE WHEN c.label IS NOT NULL THEN c.policy_name ELSE t.policy_name END AS policy_name
FROM tokens t FULL JOIN token_changes c ON t.label = c.label""")
add("policy_upsert", """
SELECT coalesce(p.name, c.name) AS name,
  CASE WHEN c.name IS NOT NULL THEN c.token ELSE upper(p.name) END AS display_name,
  CASE WHEN c.name IS NOT NULL THEN '{"dlp":{"action":"log"}}'
    ELSE '{"dlp":{"action":"' || p.dlp_action || '"}}' END AS config,
  CAST(CASE WHEN p.name IS NOT NULL THEN 1704067200 ELSE c.changed_at END AS BIGINT) AS created_at,
  CAST(CASE WHEN c.name IS NOT NULL THEN c.changed_at ELSE 1704067200 END AS BIGINT) AS updated_at
FROM (SELECT * FROM policies WHERE source = 'db') p
FULL JOIN (SELECT *, replace(label, 'user_', 'cust_') AS name FROM token_changes) c ON p.name = c.name""")
add("token_patch", """
SELECT t.label, t.token, t.email, t.created_at, CAST(t.revoked AS BIGINT) AS revoked,
  CASE WHEN c.has_upstream_key = 1 THEN c.upstream_key ELSE t.upstream_key END AS upstream_key,
  CASE WHEN c.has_allowed_models = 1 THEN c.allowed_models_csv ELSE t.allowed_models_csv END AS allowed_models_csv,
  CAST(coalesce(c.rpm_limit, t.rpm_limit) AS BIGINT) AS rpm_limit,
  CASE WHEN c.has_policy_name = 1 THEN c.policy_name ELSE t.policy_name END AS policy_name
FROM tokens t LEFT JOIN token_changes c ON t.label = c.label""")
add("token_revoke", """
SELECT label, CASE WHEN hit THEN 1 ELSE revoked END AS revoked, CASE WHEN hit THEN 1 ELSE 0 END AS changed
FROM (SELECT *, label IN (SELECT label FROM token_changes WHERE upstream_key IS NULL) AS hit FROM tokens)""")
add("policy_delete", """
SELECT name FROM policies WHERE source = 'db'
  AND name NOT IN (SELECT 'cust_' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)""")
add("touch_last_used", """
SELECT t.label, CASE WHEN t.revoked = 0 THEN u.seen END AS last_used_at
FROM tokens t LEFT JOIN (SELECT bearer, max(created_at) AS seen FROM requests GROUP BY bearer) u ON u.bearer = t.token""")
add("purge_cache", f"SELECT id FROM cache_entries WHERE NOT (expires_at IS NOT NULL AND expires_at < {PURGE_AT})")
add("purge_logs", f"SELECT request_id FROM request_log WHERE NOT (created_at < {AS_OF} - 15 * 86400)")
add("purge_by_policy", f"""
SELECT l.request_id FROM request_log l LEFT JOIN (
  SELECT t.label, e.retention_days FROM tokens t JOIN effective e ON e.name = t.policy_name) d ON d.label = l.user_label
WHERE d.retention_days IS NULL OR d.retention_days <= 0
  OR l.created_at >= {POLICY_PURGE_AT} - d.retention_days * 86400""", EFFECTIVE)
KEPT_SESSIONS = f"session_id NOT IN (SELECT session_id FROM memory_store WHERE created_at < {SESSION_CUTOFF})"
add("stream_maintenance", f"""
SELECT 'cache_entries' AS table_name, CAST(id AS VARCHAR) AS row_id FROM cache_entries, clock
  WHERE expires_at IS NULL OR expires_at >= now
UNION ALL SELECT 'memory_store', session_id || '/' || turn FROM memory_store
  WHERE session_id NOT IN (SELECT session_id FROM memory_store, clock WHERE created_at < now - {SESSION_SECONDS})
UNION ALL SELECT 'request_log', CAST(request_id AS VARCHAR) FROM request_log, clock WHERE created_at >= now - 15 * 86400""",
    {"clock": "SELECT max(created_at) AS now FROM requests"})
add("decode_embeddings", """
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS val
FROM embeddings""")

for _name in ("cache_upsert", "dim_upsert", "policy_delete", "purge_logs"):
    ORACLE[f"{_name}_stored"] = ORACLE[_name]
# A row that the earlier purge removes would be due at the later one as well.
ORACLE["purge_by_policy_stored"] = ORACLE["purge_by_policy"]

# --- Scan and govern --------------------------------------------------------------------------------------------------

add("extract_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS request_text FROM conversations GROUP BY conv_id")
SCANNED = {"scanned": f"SELECT prompt_id, {dlp_list('prompt', DLP_TYPES)} AS v FROM prompts"}
add("dlp_scan", """
SELECT prompt_id, array_to_string(v, ',') AS violations, CAST(len(v) AS BIGINT) AS n_violations,
  CASE WHEN len(v) > 0 THEN 1 ELSE 0 END AS blocked FROM scanned""", SCANNED)
add("dlp_redact", f"SELECT prompt_id, {dlp_redacted('prompt', DLP_TYPES)} AS redacted FROM prompts")
add("dlp_filter_block", "SELECT prompt_id FROM scanned WHERE len(v) = 0", SCANNED)
_CAPITAL, _PIRATE = lit(r"\bcapital\b"), lit(r"pirate\.")
add("custom_patterns", f"""
SELECT prompt_id, array_to_string(list_filter([CASE WHEN {dlp_found('prompt', 'ssn')} THEN 'ssn' END,
    CASE WHEN regexp_matches(prompt, {_CAPITAL}) THEN 'capital' END,
    CASE WHEN regexp_matches(prompt, {_PIRATE}) THEN 'pirate$' END], lambda x: x IS NOT NULL), ',') AS violations,
  regexp_replace(regexp_replace({dlp_redacted('prompt', ['ssn'])}, {_CAPITAL}, '[CAPITAL-REDACTED]', 'g'),
    {_PIRATE}, '[PIRATE$-REDACTED]', 'g') AS redacted
FROM prompts""")
GUARDED = {"guarded": f"SELECT prompt_id, {guard_max('prompt')} AS score, {guard_labels('prompt')} AS l, prompt FROM prompts"}
add("guard_score", f"""
SELECT prompt_id, score, array_to_string({in_order('l')}, ',') AS labels,
  CASE WHEN score >= 0.75 THEN 1 ELSE 0 END AS blocked FROM guarded""", GUARDED)
add("guard_label_report", f"""
SELECT label, count(*) AS n FROM (SELECT unnest({in_order('l')}) AS label FROM guarded
  UNION ALL SELECT unnest(v) FROM scanned) GROUP BY label""", {**GUARDED, **SCANNED})
_THREE = ["ssn", "email", "phone"]
add("redact_messages", f"SELECT conv_id, turn, role, {dlp_redacted('text', _THREE)} AS text FROM turns_pii")
add("output_redact", f"""
SELECT conv_id, turn, role, {dlp_redacted('text', _THREE)} AS text FROM turns_pii WHERE role = 'assistant'""")
add("detect_raw_keys", f"""
SELECT user_id, CASE WHEN regexp_matches(value, {lit('|'.join(RAW_KEY_PATTERNS))}) THEN 1 ELSE 0 END AS is_raw_key
FROM config_values""")
_KNOWN = ", ".join(lit(p) for p in [*PROVIDERS, "custom"])
add("provider_resolve", f"""
SELECT request_id, CASE WHEN header IN ({_KNOWN}) THEN header WHEN starts_with(auth_header, 'sk-ant-') THEN 'anthropic'
  WHEN starts_with(auth_header, 'gsk_') THEN 'groq' ELSE 'anthropic' END AS provider_resolved FROM provider_hints""")
add("provider_allow", """
SELECT i.request_id, CASE WHEN e.name IS NULL OR len(e.allowed) = 0 OR list_contains(e.allowed, i.provider)
  THEN 1 ELSE 0 END AS allowed FROM ident i LEFT JOIN effective e ON e.name = i.policy_name""", {**IDENTITY, **EFFECTIVE})
_ORIGIN = " OR ".join(f"starts_with(url, {lit(o)})" for o in INTERCEPTED_ORIGINS)
_URLP = " ".join(f"WHEN contains(url, {lit(part)}) THEN {lit(p)}" for part, p in URL_PROVIDERS)
add("provider_from_url", f"""
SELECT page_id, CASE WHEN {_ORIGIN} THEN 1 ELSE 0 END AS intercepted,
  CASE WHEN {_ORIGIN} THEN CASE {_URLP} ELSE 'anthropic' END END AS provider FROM urls""")
for _name in ("model_allow", "model_allow_join"):
    add(_name, f"SELECT request_id, CASE WHEN {MODEL_OK} THEN 1 ELSE 0 END AS allowed FROM ident", IDENTITY)
add("active_tokens", "SELECT label, created_at FROM tokens WHERE revoked = 0")
add("key_lookup", "SELECT label, token, policy_name FROM tokens WHERE label IN (SELECT label FROM token_changes)")
add("auth_resolve", "SELECT request_id, label, rpm_limit, 'ok' AS outcome FROM ident", IDENTITY)
add("auth_required", "SELECT request_id, label, rpm_limit, CASE WHEN known THEN 'ok' ELSE '401' END AS outcome FROM ident",
    IDENTITY)
add("policy_resolve", """
SELECT t.label, t.policy_name, e.source, e.dlp_action, e.block_threshold
FROM tokens t LEFT JOIN effective e ON e.name = t.policy_name""", EFFECTIVE)
add("policy_union", "SELECT name, source, retention_days FROM effective", EFFECTIVE)
add("list_policies", "SELECT name, dlp_action FROM policies WHERE source = 'db'")
TIMED = {"timed": "SELECT request_id, label, rpm_limit, created_at * 1000 AS ms FROM ident"}
for _name in ("rate_limit", "stream_rate_limit"):
    add(_name, "SELECT request_id, allowed FROM lim_verdict",
        {**IDENTITY, **TIMED, **limiter("timed", HOUR_MS, "lim")}, recursive=True)
add("rate_limit_minute", "SELECT request_id, allowed FROM lim_verdict",
    {"timed": "SELECT request_id, user_label AS label, 1 AS rpm_limit, created_at * 1000 AS ms FROM requests",
     **limiter("timed", 60_000, "lim")}, recursive=True)


EFFECTIVE_JSON = {"effective": EFFECTIVE["effective"].replace("system_prepend FROM policies", "system_prepend, custom_name, "
                  "custom_regex, config FROM policy_configs")}
# What a body says to the scan, and its last user string, which redaction rewrites.
BODY_TEXTS = {"body_texts": """SELECT request_id AS text_id, CASE request_id % 4
    WHEN 0 THEN 'be brief' || chr(10) || 'Research this ' || prompt_id || ' SSN 123-45-6789'
    WHEN 1 THEN 'terse' || chr(10) || 'ask ' || prompt_id || ' jo@example.org'
    WHEN 2 THEN 'mail jo@example.org' || chr(10) || 'ask ' || prompt_id
    ELSE 'legacy ' || prompt_id || ' SSN 123-45-6789' END AS prompt,
  CASE request_id % 4 WHEN 0 THEN 'Research this ' || prompt_id || ' SSN 123-45-6789' WHEN 2 THEN 'ask ' || prompt_id
    END AS said FROM requests"""}


# Identities and stored policies by the time of each request; an identity's revocation keeps its other fields.
_WHOLE = "{'token': token, 'models': allowed_models_csv, 'rpm': %s, 'policy': policy_name}"
HISTORIES = {
    "token_steps": f"""SELECT label, created_at AS moment, 0 AS rank, {_WHOLE % 'rpm_limit'} AS s, revoked AS gone FROM tokens
      UNION ALL SELECT label, changed_at, 1, {_WHOLE % 'coalesce(rpm_limit, 0)'}, 0 FROM token_events
      UNION ALL SELECT label, revoked_at, 3, NULL, 1 FROM token_ends""",
    "token_versions": """SELECT label, moment AS since, lead(moment) OVER w AS until, last_value(s IGNORE NULLS) OVER w AS s, gone
      FROM token_steps WINDOW w AS (PARTITION BY label ORDER BY moment, rank)""",
    "ident": f"""SELECT r.*, coalesce(t.label, 'anonymous') AS label, coalesce(t.s.rpm, 0) AS rpm_limit,
        {csv('t.s.models')} AS models, t.s.policy AS policy_name, t.label IS NOT NULL AS known
      FROM requests r LEFT JOIN token_versions t ON t.s.token = r.bearer AND t.gone = 0
        AND r.created_at >= t.since AND (t.until IS NULL OR r.created_at < t.until)""",
    "policy_steps": """SELECT name, changed_at AS moment, 0 AS deleted, detect_csv, dlp_action, block_threshold, allowed_providers_csv,
        retention_days, system_prepend FROM policy_events
      UNION ALL SELECT name, deleted_at, 1, NULL, NULL, NULL, NULL, NULL, NULL FROM policy_ends""",
    "policy_versions": """SELECT *, lead(moment) OVER (PARTITION BY name ORDER BY moment, deleted DESC) AS until FROM policy_steps""",
    "ruled": f"""SELECT i.request_id, coalesce(p.source, c.source) AS source, coalesce(p.name, c.name) AS name,
        CASE WHEN p.name IS NULL THEN {csv('c.detect_csv')} ELSE {csv('p.detect_csv')} END AS detect,
        CASE WHEN p.name IS NULL THEN c.dlp_action ELSE p.dlp_action END AS dlp_action,
        CASE WHEN p.name IS NULL THEN c.block_threshold ELSE p.block_threshold END AS block_threshold,
        CASE WHEN p.name IS NULL THEN {csv('c.allowed_providers_csv')} ELSE {csv('p.allowed_providers_csv')} END AS allowed,
        CASE WHEN p.name IS NULL THEN c.retention_days ELSE p.retention_days END AS retention_days,
        CASE WHEN p.name IS NULL THEN c.system_prepend ELSE p.system_prepend END AS system_prepend
      FROM ident i LEFT JOIN (SELECT *, 'db' AS source FROM policy_versions WHERE deleted = 0) p ON p.name = i.policy_name
        AND i.created_at >= p.moment AND (p.until IS NULL OR i.created_at < p.until)
      LEFT JOIN (SELECT * FROM policies WHERE source = 'config') c ON c.name = i.policy_name""",
}


def governed(limited: bool, own: bool = False, bodies: bool = False) -> dict[str, str]:
    """CTEs up to ``governed``: one row per request with outcome, events and the text to relay.

    ``own``: policies bring their own patterns; ``bodies``: requests bring their own texts.
    """
    gate = f"CASE WHEN known AND NOT {MODEL_OK} THEN '403_model' ELSE 'ok' END"
    ctes = {**IDENTITY, **(EFFECTIVE_JSON if own else EFFECTIVE), **(BODY_TEXTS if bodies else {})}
    texts, text_id, said = ("body_texts", "text_id", "said") if bodies else ("prompts", "prompt_id", "prompt")
    asked_id = "request_id" if bodies else "prompt_id"
    extra = """ || CASE WHEN len(e.detect) > 0 AND coalesce(regexp_matches(p.prompt, e.custom_regex), false)
          THEN [e.custom_name] ELSE [] END""" if own else ""
    masked = dlp_redacted("said", DLP_TYPES, "detect")
    if own:
        masked = f"regexp_replace({masked}, custom_regex, '[' || upper(custom_name) || '-REDACTED]', 'g')"
    if limited:
        ctes["gated"] = f"SELECT *, {gate} AS gate FROM ident"
        ctes["entering"] = ("SELECT request_id, label, rpm_limit, created_at * 1000 AS ms FROM gated "
                            "WHERE gate = 'ok' AND rpm_limit > 0")
        ctes |= limiter("entering", HOUR_MS, "lim")
        ctes["admitted"] = ("SELECT g.*, CASE WHEN v.allowed = 0 THEN '429' ELSE gate END AS admission "
                            "FROM gated g LEFT JOIN lim_verdict v ON v.request_id = g.request_id")
    else:
        ctes["admitted"] = "SELECT *, 'ok' AS admission FROM ident"
    ctes["verdicts"] = f"""SELECT {text_id} AS text_id, prompt, {said} AS said, {dlp_list('prompt', DLP_TYPES)} AS types, {guard_max('prompt')} AS score,
        {guard_labels('prompt')} AS l FROM {texts}"""
    ctes["judged"] = f"""SELECT a.*, e.name AS pol, e.dlp_action, e.block_threshold, e.allowed, e.detect, e.system_prepend,
        p.said, p.score, p.l, {"e.custom_name, e.custom_regex," if own else ""}
        CASE WHEN e.name IS NULL THEN [] ELSE list_filter(e.detect, lambda d: list_contains(p.types, d)){extra} END AS v
      FROM admitted a LEFT JOIN effective e ON e.name = a.policy_name LEFT JOIN verdicts p ON p.text_id = a.{asked_id}"""
    ctes["stops"] = """SELECT *, admission = 'ok' AND pol IS NOT NULL AND len(v) > 0 AS found,
        admission = 'ok' AND pol IS NOT NULL AND len(v) > 0 AND dlp_action = 'block' AS s_dlp,
        admission = 'ok' AND pol IS NOT NULL AND score >= block_threshold AS s_guard,
        admission = 'ok' AND pol IS NOT NULL AND len(allowed) > 0 AND NOT list_contains(allowed, provider) AS s_prov
      FROM judged"""
    ctes["governed"] = f"""SELECT *, CASE WHEN admission <> 'ok' THEN admission WHEN s_dlp THEN 'dlp_blocked'
        WHEN s_guard THEN 'injection_blocked' WHEN s_prov THEN 'provider_blocked' ELSE 'ok' END AS outcome,
        CASE WHEN found AND dlp_action = 'redact' THEN {masked} ELSE said END AS relay_text,
        list_filter([
          CASE WHEN found THEN {{'action': 'dlp_' || CASE dlp_action WHEN 'block' THEN 'blocked' WHEN 'redact'
            THEN 'redacted' ELSE 'logged' END, 'detail': '{{"violations":["' || array_to_string(v, '","') || '"]}}'}} END,
          CASE WHEN s_guard AND NOT s_dlp THEN {{'action': 'injection_blocked', 'detail': '{{"score":' || CAST(score AS VARCHAR)
            || ',"matches":["' || array_to_string({in_order('l')}, '","') || '"]}}'}} END,
          CASE WHEN s_prov AND NOT s_dlp AND NOT s_guard THEN {{'action': 'provider_blocked',
            'detail': '{{"provider":"' || provider || '"}}'}} END], lambda x: x IS NOT NULL) AS events
      FROM stops"""
    return ctes


add("govern_batch", "SELECT request_id, outcome FROM governed", governed(True), recursive=True)
add("govern_events", """
SELECT request_id, CAST(seq AS BIGINT) AS seq, e.action AS action, e.detail AS detail FROM (
  SELECT request_id, generate_subscripts(events, 1) AS seq, unnest(events) AS e FROM governed)""",
    governed(True), recursive=True)
_TOLD = "array_to_string(list_transform(events, lambda e: e.action || ' ' || e.detail), ';') AS events"
add("policy_parse", """
SELECT name, source, array_to_string(detect, ',') AS detect, dlp_action, CAST(1 AS BIGINT) AS guard_enabled, block_threshold,
  array_to_string(allowed, ',') AS allowed_providers, system_prepend,
  CASE WHEN dlp_action = 'redact' THEN 1 ELSE 0 END AS redact_output, retention_days,
  CASE WHEN len(detect) = 0 THEN '' WHEN dlp_action = 'block' THEN 'broken,' || custom_name ELSE custom_name END AS custom_names,
  CASE WHEN len(detect) = 0 THEN '' WHEN dlp_action = 'block' THEN '(,' || custom_regex ELSE custom_regex END AS custom_regexes
FROM effective""", EFFECTIVE_JSON)
add("govern_custom", f"SELECT request_id, outcome, {_TOLD} FROM governed", governed(True, own=True), recursive=True)
add("relay_custom", "SELECT DISTINCT prompt_id, relay_text FROM governed WHERE outcome = 'ok'", governed(True, own=True),
    recursive=True)
add("govern_bodies", f"SELECT request_id, outcome, {_TOLD} FROM governed", governed(True, own=True, bodies=True),
    recursive=True)
add("auth_asof", """SELECT request_id, label, rpm_limit, policy_name, CASE WHEN known THEN 'ok' ELSE '401' END AS outcome
FROM ident""", HISTORIES)
add("policy_asof", """SELECT i.request_id, i.policy_name, r.source, r.dlp_action, r.retention_days
FROM ident i JOIN ruled r ON r.request_id = i.request_id""", HISTORIES)
_ASOF = governed(True)
_ASOF = {**HISTORIES, **{k: q for k, q in _ASOF.items() if k not in ("ident", "effective")}}
_ASOF["judged"] = _ASOF["judged"].replace("LEFT JOIN effective e ON e.name = a.policy_name", "JOIN ruled e ON e.request_id = a.request_id")
add("govern_asof", f"SELECT request_id, outcome, {_TOLD} FROM governed", _ASOF, recursive=True)
add("output_redact_policy", f"""
SELECT i.request_id, CASE WHEN e.dlp_action = 'redact' THEN CASE WHEN len(e.detect) > 0
  THEN regexp_replace({dlp_redacted('p.prompt', DLP_TYPES, 'e.detect')}, e.custom_regex, '[' || upper(e.custom_name) || '-REDACTED]', 'g')
  ELSE p.prompt END ELSE p.prompt END AS text
FROM ident i JOIN prompts p ON p.prompt_id = i.prompt_id LEFT JOIN effective e ON e.name = i.policy_name""",
    {**IDENTITY, **EFFECTIVE_JSON})
add("stream_govern", f"SELECT request_id, outcome, {_TOLD} FROM governed", governed(False))

# --- Cache ----------------------------------------------------------------------------------------------------------------

def _semantic(threshold: float) -> dict[str, str]:
    return {
        "doubles": "SELECT vec_id, provider, model, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM prompt_vectors",
        "normed": "SELECT *, sqrt(list_dot_product(e, e)) AS n FROM doubles",
        "pairs": """SELECT a.vec_id, b.vec_id AS match_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 9) AS similarity
          FROM normed a JOIN normed b ON a.provider = b.provider AND a.model = b.model AND b.vec_id < a.vec_id""",
        "matches": f"""SELECT vec_id, match_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id
          ORDER BY similarity DESC, match_id) AS r FROM pairs WHERE similarity >= {threshold}) q WHERE r = 1""",
    }


add("semantic_match", "SELECT vec_id, match_id, round(similarity, 6) AS similarity, CAST(1 AS BIGINT) AS served FROM matches",
    _semantic(0.94))
add("semantic_dry_run", """
SELECT vec_id, 'semantic_dry_run' AS action, '{"match_id":' || match_id || ',"similarity":'
  || CAST(round(similarity * 1000000) AS BIGINT) || '}' AS detail FROM matches""", _semantic(LOOSE))
add("cache_live", f"SELECT id FROM cache_entries WHERE expires_at IS NULL OR expires_at > {PURGE_AT}")
_SERVES = ("SELECT 1 FROM cache_entries e WHERE e.request_hash = k.request_hash AND k.created_at >= e.created_at "
           "AND (e.expires_at IS NULL OR e.expires_at > k.created_at)")
add("cache_hits", f"SELECT request_id FROM request_keys k WHERE EXISTS ({_SERVES})")
add("cache_misses", f"SELECT request_id FROM request_keys k WHERE NOT EXISTS ({_SERVES})")
add("cache_asof", """
SELECT k.request_id, e.id AS entry_id FROM request_keys k ASOF JOIN (
  SELECT request_hash, created_at, max(id) AS id, arg_max(coalesce(expires_at, 9223372036854775807), id) AS expires_at
  FROM cache_entries GROUP BY request_hash, created_at) e
ON k.request_hash = e.request_hash AND k.created_at >= e.created_at WHERE e.expires_at > k.created_at""")
for _name, _fills in (("cache_replay", "1"), ("stream_cache", "CASE WHEN request_id % 4 = 0 THEN 0 ELSE 1 END")):
    add(_name, "SELECT request_id, hit FROM c_out",
        {"keys": f"SELECT *, {_fills} AS can_fill FROM request_keys", **replay("keys", TTL, "c")}, recursive=True)
HASH = ("sha256('{\"provider\":\"' || %s || '\",\"model\":\"' || model || '\",\"messages\":[{\"role\":\"user\",\"content\":'"
        " || CAST(to_json(%s) AS VARCHAR) || '}]}')")
add("request_hash", f"""
SELECT r.request_id, {HASH % ('provider', 'prompt')} AS request_hash
FROM requests r JOIN prompts p ON p.prompt_id = r.prompt_id""")

# --- Routing, prices, rewriting --------------------------------------------------------------------------------------------


def tier_case(text: str) -> str:
    whens = " ".join(f"WHEN contains(lower({text}), {lit(w)}) THEN '{tier}'" for tier, words in ROUTING_RULES for w in words)
    return f"CASE {whens} END"


def routed(source: str, text: str) -> str:
    """SELECT with tier, method and routed_model for mode ``rules``."""
    models = " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in TIER_MODELS.items())
    return f"""SELECT *, CASE WHEN valid THEN tier_header ELSE coalesce(rule, 'standard') END AS tier,
      CASE WHEN valid THEN 'header' WHEN rule IS NOT NULL THEN 'rule' ELSE 'default' END AS method,
      CASE WHEN valid OR rule IS NOT NULL THEN CASE (CASE WHEN valid THEN tier_header ELSE rule END) {models} END
        ELSE model END AS routed_model
      FROM (SELECT *, coalesce(tier_header IN ('simple', 'standard', 'complex'), false) AS valid, {tier_case(text)} AS rule
        FROM {source})"""


add("route_rules", f"SELECT prompt_id, {tier_case('prompt')} AS tier FROM prompts")
add("route_model", "SELECT request_id, tier, method, routed_model FROM routed",
    {"asked": "SELECT r.*, p.prompt FROM requests r JOIN prompts p ON p.prompt_id = r.prompt_id",
     "routed": routed("asked", "prompt")})
add("route_keywords", """
SELECT prompt_id, CASE WHEN bool_or(rule = 1) THEN 'complex' WHEN bool_or(rule = 2) THEN 'standard' WHEN bool_or(rule = 3) THEN 'simple' END
  AS tier
FROM (SELECT prompt_id, lower(prompt) AS low FROM prompts) p LEFT JOIN words ON contains(low, w) GROUP BY prompt_id""", {
    "words": """SELECT w, CASE WHEN length(w) > 11 THEN 1 WHEN length(w) > 9 THEN 2 ELSE 3 END AS rule FROM (
      SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) q WHERE length(w) > 4"""})
add("price_join", f"""
SELECT model, CAST({price_case('model', 1)} AS DOUBLE) / 1000 AS price_in, CAST({price_case('model', 2)} AS DOUBLE) / 1000
  AS price_out FROM (SELECT DISTINCT original_model AS model FROM request_log)""")
add("price_request", "SELECT request_id, cost_usd, saved_usd FROM priced", PRICED)
_BOTH = f"{lit(PREPEND)} || chr(10) || chr(10) || {{}}{lit(APPEND)}"
add("prompt_lock", f"""
SELECT c.conv_id, c.turn, c.role, CASE WHEN c.turn = s.t THEN {lit(PREPEND)} || chr(10) || chr(10)
  || CASE WHEN c.text = '' THEN '' ELSE c.text || chr(10) || chr(10) END || {lit(APPEND)} ELSE c.text END AS text
FROM conversations c JOIN sys s ON s.conv_id = c.conv_id
UNION ALL SELECT conv_id, -1, 'system', {lit(PREPEND)} || chr(10) || chr(10) || {lit(APPEND)} FROM sys WHERE t IS NULL""",
    {"sys": "SELECT conv_id, min(CASE WHEN role = 'system' THEN turn END) AS t FROM conversations GROUP BY conv_id"})
add("strip_params", """
SELECT request_id, '{' || CASE WHEN NOT contains(model, 'haiku') AND request_id % 3 = 0 THEN '"betas":["b"],' ELSE '' END
  || '"max_tokens":10,"model":"' || model || '"'
  || CASE WHEN NOT contains(model, 'haiku') AND request_id % 3 = 0 THEN ',"thinking":{"type":"on"}' ELSE '' END
  || '}' AS body FROM bodies""")
add("scrub_headers", f"""
SELECT request_id, CASE WHEN provider = 'anthropic'
  THEN '{{"anthropic-version":"{ANTHROPIC_VERSION}","content-type":"application/json","x-api-key":"t' || request_id || '"}}'
  ELSE '{{"authorization":"Bearer t' || request_id || '","content-type":"application/json"}}' END AS headers FROM bodies""")
add("cache_breakpoints", """
SELECT request_id, CASE request_id % 4
    WHEN 0 THEN '[{"cache_control":{"type":"ephemeral"},"text":"sys ' || model || '","type":"text"}]'
    WHEN 1 THEN '[{"text":"a","type":"text"},{"cache_control":{"type":"ephemeral"},"text":"' || model || '","type":"text"}]'
    WHEN 2 THEN '[]' END AS system_out,
  CASE request_id % 3 WHEN 0 THEN '[{"description":"s","name":"search"},{"cache_control":{"type":"ephemeral"},'
    || '"description":"d","name":"' || model || '"}]' WHEN 1 THEN '[]' END AS tools_out FROM bodies""")

# --- Conversations, memory, compression -----------------------------------------------------------------------------------

add("last_user_text", """
SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user FROM conversations GROUP BY conv_id""")
add("first_system", """
SELECT conv_id, min(turn) FILTER (WHERE role = 'system') AS system_turn FROM conversations GROUP BY conv_id""")
RECALLED = {"recalled": f"""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, turn) AS pos,
    role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, turn DESC) AS n
    FROM memory_store) WHERE n <= {2 * TOP_K}"""}
add("memory_recall", "SELECT session_id, pos, role, content FROM recalled", RECALLED)
add("memory_inject", """
SELECT r.request_id, coalesce(x.n, 0) + 1 AS n_messages,
  coalesce(x.m || chr(10), '') || 'user:ask ' || CAST(r.prompt_id AS VARCHAR) AS messages
FROM requests r LEFT JOIN (SELECT session_id, count(*) AS n, string_agg(role || ':' || content, chr(10) ORDER BY pos) AS m
  FROM recalled GROUP BY session_id) x ON x.session_id = 'sess_' || CAST(r.conv_id AS VARCHAR)""", RECALLED)
add("memory_inject_asof", f"""
SELECT request_id, count(x.turn) + 1 AS n_messages,
  coalesce(string_agg(x.role || ':' || x.content, chr(10) ORDER BY x.created_at, x.turn) || chr(10), '') || 'user:ask '
    || CAST(any_value(prompt_id) AS VARCHAR) AS messages
FROM (SELECT r.request_id, r.prompt_id, m.turn, m.role, m.content, m.created_at,
    row_number() OVER (PARTITION BY r.request_id ORDER BY m.created_at DESC, m.turn DESC) AS n
  FROM requests r LEFT JOIN memory_store m ON m.session_id = 'sess_' || CAST(r.conv_id AS VARCHAR)
    AND m.created_at < r.created_at) x
WHERE n <= {2 * TOP_K} GROUP BY request_id""")
add("session_purge", f"SELECT session_id, turn FROM memory_store WHERE {KEPT_SESSIONS}")
add("distinct_sessions", f"SELECT DISTINCT session_id FROM memory_store WHERE created_at < {SESSION_CUTOFF}")
_MSG = ("length('{\"role\":' || CAST(to_json(role) AS VARCHAR) || ',\"content\":' || CAST(to_json(text) AS VARCHAR) || '}')"
        " + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))")
SIZES = {"sizes": f"""SELECT conv_id, count(*) AS n, CAST(ceil((sum({_MSG}) + count(*) + 1) / 4.0) AS BIGINT) AS est_tokens
  FROM conversations GROUP BY conv_id""",
         "plan": f"SELECT *, est_tokens >= {TRIGGER} AND n > {2 * RETAIN} AS yes FROM sizes"}
add("estimate_tokens", "SELECT conv_id, est_tokens FROM sizes", {"sizes": SIZES["sizes"]})
add("compress_plan", f"""
SELECT conv_id, est_tokens, CASE WHEN yes THEN 1 ELSE 0 END AS compressed, CASE WHEN yes THEN n - {2 * RETAIN} ELSE 0 END
  AS n_head, CASE WHEN yes THEN {2 * RETAIN} ELSE n END AS n_tail FROM plan""", SIZES)
RANKED = {**SIZES, "ranked": """SELECT c.*, p.yes, p.n,
    row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS back FROM conversations c JOIN plan p ON p.conv_id = c.conv_id"""}


def compressed(summary: str) -> str:
    keep = 2 * RETAIN
    return f"""
SELECT conv_id, 0 AS pos, 'user' AS role, {lit(SUMMARY_HEADER.rstrip())} || chr(10) || {summary} AS text
  FROM ranked WHERE yes AND back > {keep} GROUP BY conv_id
UNION ALL SELECT conv_id, 1, 'assistant', {lit(SUMMARY_ACK)} FROM plan WHERE yes
UNION ALL SELECT conv_id, {keep} + 2 - back, role, text FROM ranked WHERE yes AND back <= {keep}
UNION ALL SELECT conv_id, turn, role, text FROM ranked WHERE NOT yes"""


add("compress_apply", compressed("count(*) || ' messages, starting with: ' || arg_min(text, turn)"), RANKED)
add("summariser_hook", compressed("count(*) || ' turns'"), RANKED)

# --- Reports ---------------------------------------------------------------------------------------------------------------


def report(divisor: str) -> str:
    counts = {"total": "true", "cached": "from_cache = 1", "streamed": "duration_ms = 0",
              "tier_simple": "routing_tier = 'simple'", "tier_standard": "routing_tier = 'standard'",
              "tier_complex": "routing_tier = 'complex'", "m_classifier": "routing_method = 'classifier'",
              "m_rule": "routing_method = 'rule'", "m_header": "routing_method = 'header'",
              "m_default": "routing_method = 'default'", "m_cache": "from_cache = 1"}
    cols = [f"{r2(f'(count(*) FILTER (WHERE {c})) / CAST({divisor} AS DOUBLE)')} AS {n}" for n, c in counts.items()]
    cols += [f"{r2(f'CAST(coalesce(sum({c}), 0) AS DOUBLE) / {divisor}')} AS {n}"
             for n, c in (("total_input", "input_tokens"), ("total_output", "output_tokens"))]
    cols += [f"{r2(f'CAST(coalesce(sum({c}), 0) AS DOUBLE) / 1e9 / {divisor}')} AS {n}"
             for n, c in (("actual_usd", "cost_nano"), ("saved_usd", "saved_nano"))]
    return ", ".join(cols)


WOULD = r2("actual_usd + saved_usd")
SHARE = f"CASE WHEN {WOULD} > 0 THEN {r2(f'saved_usd / {WOULD} * 100', 1)} ELSE 0.0::DOUBLE END"
_PERIOD_ROWS = ", ".join(f"('{n}', {period_bounds(AS_OF)[n][0]}, {period_bounds(AS_OF)[n][1]}, {d})" for n, _, d in PERIODS)
PERIOD = {"per": f"SELECT * FROM (VALUES {_PERIOD_ROWS}) AS t(period, lo, hi, divisor)"}
add("stats_cube", f"SELECT *, {WOULD} AS would_have_cost_usd, {SHARE} AS savings_pct FROM cube",
    {**PRICED, **PERIOD, "cube": f"""SELECT p.period, l.user_label, {report('max(p.divisor)')} FROM priced l
      JOIN per p ON l.created_at BETWEEN p.lo AND p.hi GROUP BY GROUPING SETS ((p.period, l.user_label), (p.period))"""})


def one_period(period: str, columns: str = "*") -> tuple[str, dict[str, str]]:
    lo, hi = period_bounds(AS_OF)[period]
    divisor = {n: d for n, _, d in PERIODS}[period]
    one = f"""SELECT '{period}' AS period, CAST({lo} AS BIGINT) AS from_ts, CAST({hi} AS BIGINT) AS to_ts, {report(str(divisor))}
      FROM priced WHERE created_at BETWEEN {lo} AND {hi}"""
    full = f"SELECT *, {WOULD} AS would_have_cost_usd, {SHARE} AS savings_pct FROM one"
    return f"SELECT {columns} FROM ({full})", {**PRICED, "one": one}


ORACLE["stats_cube_incremental"] = ORACLE["stats_cube"]
add("period_stats", *one_period("weekly"))
add("daily_avg", *one_period("daily_avg"))
add("stats_by_tier", *one_period("monthly", "period, total, tier_simple, tier_standard, tier_complex"))
add("stats_by_method", *one_period("monthly", "period, total, m_classifier, m_rule, m_header, m_default, m_cache"))
add("cost_summary", *one_period("today", "period, actual_usd, saved_usd, would_have_cost_usd, savings_pct"))
add("cache_stats", """
SELECT count(*) AS total_requests, CAST(sum(from_cache) AS BIGINT) AS cache_hits,
  CAST(count(*) - sum(from_cache) AS BIGINT) AS cache_misses, CAST(sum(from_cache) AS DOUBLE) / count(*) AS hit_rate,
  CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
  CAST(floor(CAST(sum(duration_ms) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS avg_duration_ms FROM request_log""")
_MONTH = "created_at BETWEEN {} AND {}".format(*period_bounds(AS_OF)["monthly"])
add("model_usage", f"""
SELECT routed_model AS model, CAST(floor(count(*) / 30.0 + 0.5) AS BIGINT) AS cnt FROM request_log
WHERE {_MONTH} AND routed_model <> '' GROUP BY routed_model""")
add("top_models", f"""
SELECT routed_model AS model, count(*) AS cnt FROM request_log WHERE {_MONTH} AND routed_model <> ''
GROUP BY routed_model ORDER BY cnt DESC, model LIMIT 8""")
add("routing_switches", f"""
SELECT original_model AS src, routed_model AS dst, count(*) AS cnt FROM request_log
WHERE {_MONTH} AND original_model <> '' AND routed_model <> '' AND original_model <> routed_model
GROUP BY ALL ORDER BY cnt DESC, src, dst LIMIT 20""")
USERS = {**PRICED, "users": """SELECT user_label, count(*) AS reqs, CAST(sum(cost_nano) AS DOUBLE) / 1e9 AS cost,
    CAST(sum(saved_nano) AS DOUBLE) / 1e9 AS saved FROM priced GROUP BY user_label"""}
add("user_stats", "SELECT user_label, reqs, cost, saved FROM users", USERS)
MASK = "substr(token, 1, 8) || '••••••••'"
add("user_summary", f"""
SELECT t.label, {MASK} AS token_masked, t.rpm_limit, t.policy_name, CAST(t.revoked AS BIGINT) AS revoked,
  coalesce(u.reqs, 0) AS requests, coalesce(u.cost, 0.0::DOUBLE) AS cost_usd, coalesce(u.saved, 0.0::DOUBLE) AS saved_usd
FROM tokens t LEFT JOIN users u ON u.user_label = t.label""", USERS)
add("recent_events", """
SELECT id, created_at, user_label, policy_name, action, detail FROM policy_log ORDER BY created_at DESC, id DESC LIMIT 50""")
add("log_tier_from_model", """
SELECT request_id, CASE WHEN contains(routed_model, 'haiku') THEN 'simple' WHEN contains(routed_model, 'sonnet')
  THEN 'standard' ELSE 'complex' END AS tier FROM request_log""")

# --- Scalar functions ---------------------------------------------------------------------------------------------------------

add("mask_token", f"SELECT label, {MASK} AS token_masked FROM tokens")
add("slugify", """
SELECT label, regexp_replace(lower(trim('  ' || email || ' ')), '[^a-z0-9_-]', '-', 'g') AS slug,
  regexp_replace(lower(email), '[^a-z0-9._-]', '_', 'g') AS label_slug FROM tokens""")
add("short_model", r"""
SELECT request_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(model, 'claude-', ''), '-20\d{6}$', ''),
  '-4-', '4-'), '-4\.', '4.') AS short_name FROM requests""")
add("strip_bearer", "SELECT request_id, bearer AS key, bearer AS token FROM requests")
add("truncate_prompt", "SELECT prompt_id, substr(prompt, 1, 500) AS excerpt, substr(prompt, 1, 100) AS echo FROM prompts")
add("period_bounds", """
SELECT period, CAST(lo AS BIGINT) AS from_ts, CAST(hi AS BIGINT) AS to_ts, count(*) AS n FROM requests
JOIN per ON created_at BETWEEN lo AND hi GROUP BY ALL""", PERIOD)
add("js_round", """
SELECT event_id, CAST(floor(value * 100e0 + 0.5e0) AS DOUBLE) / 100e0 AS rounded,
  CAST(floor(value * 0.1e0 + 0.5e0) AS BIGINT) AS whole FROM events""")
add("sse_usage", "SELECT request_id, input_tokens, output_tokens FROM requests")
add("stream_usage", "SELECT request_id, input_tokens, output_tokens, CAST(1 AS BIGINT) AS complete FROM requests")
add("parse_usage", """
SELECT request_id, CASE WHEN request_id % 3 = 2 THEN 0 ELSE input_tokens END AS input_tokens,
  CASE WHEN request_id % 3 = 2 THEN 0 ELSE output_tokens END AS output_tokens FROM requests""")
add("json_detail", """
SELECT id, detail ->> '$.provider' AS provider, '{"provider":"' || (detail ->> '$.provider') || '"}' AS encoded FROM policy_log""")

# --- Hooks -------------------------------------------------------------------------------------------------------------------

add("middleware_chain", """
SELECT request_id, CASE WHEN event_type = 'error' THEN 'a' ELSE 'abc' END AS trail,
  CASE WHEN event_type = 'error' THEN 'refused' END AS short_circuit FROM requests""")
add("middleware_response", """
SELECT request_id, CASE WHEN from_cache = 1 THEN output_tokens ELSE least(output_tokens, 100) END AS output_tokens,
  CASE WHEN from_cache = 1 THEN '' ELSE 'ab' END AS trail FROM request_log""")
add("middleware_error", """
SELECT request_id, s.name || provider AS note, CAST(s.step AS BIGINT) AS step
FROM requests, (VALUES ('count ', 1), ('log ', 2)) s(name, step) WHERE event_type = 'error'""")
add("classifier_hook", r"""
SELECT prompt_id, CASE WHEN n < 50 THEN 'simple' WHEN n > 70 THEN 'complex' ELSE 'standard' END AS classified
FROM (SELECT prompt_id, len(regexp_extract_all(substr(prompt, 1, 500), '\S+')) AS n FROM prompts)""")
add("embedder_hook", """
SELECT prompt_id, CAST(k AS BIGINT) AS dim,
  round(CAST(coalesce(n / nullif(sqrt(sum(n * n) OVER (PARTITION BY prompt_id)), 0), 0) AS DOUBLE), 3) AS val
FROM (SELECT prompt_id, k, CAST(length(low) - length(replace(low, chr(CAST(97 + k AS INTEGER)), '')) AS DOUBLE) AS n
  FROM (SELECT prompt_id, lower(prompt) AS low FROM prompts) p, (SELECT unnest(range(26)) AS k) letters) q""")

# --- Whole gateway -----------------------------------------------------------------------------------------------------------

def gateway(judged: dict[str, str], key: str, fills: str, asked: str = "relay_text") -> dict[str, str]:
    """CTEs up to ``final``: the priced answers of governed requests."""
    return {
        **judged,
        "passed": routed("(SELECT * FROM governed WHERE outcome = 'ok')", asked),
        "keyed": f"SELECT *, {key} AS request_hash, {fills} AS can_fill FROM passed",
        **replay("keyed", TTL, "c"),
        "answered": """SELECT c.request_id, c.created_at, c.label AS user_label, c.provider, c.hit AS from_cache, c.system_prepend,
            len(c.events) AS n_events, c.model AS original_model,
            CASE WHEN hit = 1 THEN c.model ELSE c.routed_model END AS routed_model,
            CASE WHEN hit = 1 THEN 'cache' ELSE method END AS routing_method,
            CASE WHEN hit = 1 THEN 'standard' ELSE tier END AS routing_tier,
            CASE WHEN hit = 1 THEN s.input_tokens ELSE c.input_tokens END AS input_tokens,
            CASE WHEN hit = 1 THEN s.output_tokens ELSE c.output_tokens END AS output_tokens
          FROM c_out c LEFT JOIN requests s ON s.request_id = c.source_id""",
        "final": priced("answered"),
    }


GATEWAY = gateway(governed(True), HASH % ("provider", "relay_text"), "1 - is_stream")
# Legacy prompts are no part of the key.
BODY_GATEWAY = gateway(
    governed(True, own=True, bodies=True),
    "provider || '|' || model || '|' || CASE request_id % 4 WHEN 1 THEN 'blocks ' || prompt_id WHEN 3 THEN 'none' "
    "ELSE (request_id % 4) || relay_text END",
    "CASE WHEN is_stream = 0 AND event_type <> 'error' THEN 1 ELSE 0 END",
    "(CASE request_id % 4 WHEN 1 THEN '[{\"text\":\"ask ' || prompt_id || ' jo@example.org\",\"type\":\"text\"},"
    "{\"text\":\"no\",\"type\":\"image\"}]' WHEN 3 THEN '\"\"' ELSE relay_text END)")
add("replay_bodies", LOG_ROW.format(duration="CAST(NULL AS BIGINT)", more="", table="final"), BODY_GATEWAY, recursive=True)
add("gateway_replay", LOG_ROW.format(duration="CAST(NULL AS BIGINT)", more="", table="final"), GATEWAY, recursive=True)
add("gateway_events", """
SELECT request_id, CAST(n_events + 1 AS BIGINT) AS seq, 'system_prompt_injected' AS action FROM final
WHERE from_cache = 0 AND coalesce(system_prepend, '') <> ''""", GATEWAY, recursive=True)

# --- Streams ------------------------------------------------------------------------------------------------------------------

add("stream_memory", f"""
SELECT session_id, turn, CAST(len(kept) AS BIGINT) AS n_recalled, '[' || array_to_string(kept, ', ') || ']' AS context FROM (
  SELECT session_id, turn, coalesce(list('{{"role": ' || CAST(to_json(role) AS VARCHAR) || ', "content": '
    || CAST(to_json(content) AS VARCHAR) || '}}') OVER (PARTITION BY session_id ORDER BY created_at, turn
    ROWS BETWEEN {2 * TOP_K} PRECEDING AND 1 PRECEDING), []) AS kept FROM memory_store)""")
add("stream_stats", """
SELECT created_at - created_at % 86400 AS day_start, user_label, count(*) AS total, CAST(sum(from_cache) AS BIGINT) AS cached,
  count(*) FILTER (duration_ms = 0) AS streamed, count(*) FILTER (routing_tier = 'simple') AS tier_simple,
  count(*) FILTER (routing_tier = 'standard') AS tier_standard, count(*) FILTER (routing_tier = 'complex') AS tier_complex,
  count(*) FILTER (routing_method = 'classifier') AS m_classifier, count(*) FILTER (routing_method = 'rule') AS m_rule,
  count(*) FILTER (routing_method = 'header') AS m_header, count(*) FILTER (routing_method = 'default') AS m_default,
  CAST(sum(from_cache) AS BIGINT) AS m_cache, CAST(sum(input_tokens) AS BIGINT) AS total_input,
  CAST(sum(output_tokens) AS BIGINT) AS total_output, CAST(sum(cost_nano) AS DOUBLE) / 1e9 AS total_cost,
  CAST(sum(saved_nano) AS DOUBLE) / 1e9 AS total_saved
FROM priced GROUP BY ALL""", PRICED)
add("stream_metrics", LOG_ROW.format(duration="CAST(duration_ms AS BIGINT)", more="", table="priced"), PRICED)
