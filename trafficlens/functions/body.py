"""Request bodies: open JSON documents held as VARIANT, read and rewritten with native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import (ANTHROPIC_VERSION, CONTROL_HEADERS, DROPPED_HEADERS, STRIP_ALWAYS, STRIP_HAIKU)
from .regex import WS

BODY_SCHEMA = "model string, system variant, messages variant, prompt variant, stream variant, _broken string"
STRICT = {"columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_BLANK = " \t\n\r"
_EMPTY = "array<string>"


def parse_body(raw: Column) -> Column:
    """View of a body whose parts may have any form; everything it does not name stays in the raw text."""
    return F.from_json(raw, BODY_SCHEMA, STRICT)


def body_error(raw: Column, body: Column) -> Column:
    """Why a body is no JSON object: ``empty``, ``not_json`` or ``not_object``; null for a good one.

    ``body`` is :func:`parse_body` of it. Parsers stop at the end of the first value, so what follows it is checked by
    reading the body as the first element of an array whose second is known. A key that stands twice inside a
    message, system text or prompt makes a body ``not_json`` (VARIANT holds no such object).
    """
    mark = F.hex(F.xxhash64(raw))
    whole = F.get_json_object(F.concat(F.lit("["), raw, F.lit(',"'), mark, F.lit('"]')), "$[1]") == mark
    broken = F.coalesce(body["_broken"].isNotNull(), F.lit(True))
    return (F.when(raw.isNull() | (F.btrim(raw, F.lit(_BLANK)) == ""), "empty")
            .when(~F.coalesce(whole, F.lit(False)), "not_json")
            .when(F.ltrim(raw, F.lit(_BLANK)).startswith("{"), F.when(body.isNull() | broken, "not_json"))
            .when(F.try_parse_json(raw).isNull(), "not_json").otherwise("not_object"))


def entries(messages: Column) -> Column:
    """The entries of a ``messages`` VARIANT, whatever their form; null when it is no array."""
    return F.try_variant_get(messages, "$", "array<variant>")


def role_of(entry: Column) -> Column:
    return string_or_null(F.try_variant_get(entry, "$.role", "variant"))


def content_of(entry: Column) -> Column:
    return F.try_variant_get(entry, "$.content", "variant")


def messages_of(messages: Column) -> Column:
    """Role and content of every entry. An entry that is no object has neither, and hides none of the others."""
    return F.transform(entries(messages), lambda m: F.struct(role_of(m).alias("role"), content_of(m).alias("content")))


def entry_fields(raw: Column) -> Column:
    """Each entry of ``messages`` as ``map<string, variant>`` with its keys in the order of the raw text.

    Null for an entry that is no object, except for a string that looks like one: see :func:`is_object`.
    """
    texts = F.from_json(raw, "messages array<string>")["messages"]
    return F.transform(texts, lambda t: F.from_json(t, "map<string,variant>"))


def is_object(entry: Column) -> Column:
    return F.try_variant_get(entry, "$", "map<string,variant>").isNotNull()


def is_true(flag: Column) -> Column:
    """Whether a VARIANT is the JSON literal ``true``."""
    return F.coalesce((F.schema_of_variant(flag) == "BOOLEAN") & F.try_variant_get(flag, "$", "boolean"), F.lit(False))


def _is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def string_or_null(value: Column) -> Column:
    return F.when(_is_string(value), F.try_variant_get(value, "$", "string"))


def content_texts(content: Column) -> Column:
    """Scannable texts of one message: its string, or its non-empty text blocks."""
    blocks = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(
        F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
        lambda b: string_or_null(F.try_variant_get(b, "$.text", "variant")))
    texts = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    return F.when(_is_string(content), F.array(F.try_variant_get(content, "$", "string"))) \
        .when(F.schema_of_variant(content).startswith("ARRAY"), texts) \
        .otherwise(F.array().cast(_EMPTY))


def request_text(body: Column) -> Column:
    """System string, message texts and legacy prompt, joined by newlines (see :func:`parse_body`)."""
    parts = F.coalesce(F.flatten(F.transform(entries(body["messages"]), lambda m: content_texts(content_of(m)))),
                       F.array().cast(_EMPTY))
    return F.concat_ws("\n", string_or_null(body["system"]), parts, string_or_null(body["prompt"]))


def last_user_text(messages: Column) -> Column:
    """Content of the last user message (see :func:`messages_of`); JSON text when it is not a string."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    content = F.get(F.reverse(users), F.lit(0))["content"]
    return F.when(content.isNull(), F.lit('""')).when(_is_string(content), F.try_variant_get(content, "$", "string")) \
        .otherwise(F.to_json(content))


def strip_params(body: Column, model: Column) -> Column:
    """Drop the top-level keys the target model does not accept. ``body`` is ``map<string, variant>``."""
    haiku = F.contains(F.coalesce(model, F.lit("")), F.lit("haiku"))
    return F.map_filter(body, lambda k, v: ~F.when(haiku, k.isin(STRIP_HAIKU)).otherwise(k.isin(STRIP_ALWAYS)))


def _marked(blocks: Column) -> Column:
    """Set the ephemeral cache mark on the last block of ``array<map<string, variant>>``."""
    mark = F.create_map(F.lit("cache_control"), F.parse_json(F.lit('{"type":"ephemeral"}')))
    last = F.map_concat(F.map_filter(F.element_at(blocks, -1), lambda k, v: k != "cache_control"), mark)
    return F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(last))


def mark_blocks(blocks: Column) -> Column:
    return F.when(F.size(blocks) > 0, _marked(blocks)).otherwise(blocks)


def mark_system(system: Column) -> Column:
    """Cache breakpoint on a ``system`` VARIANT: a string becomes one marked block; absent stays absent."""
    as_block = F.array(F.create_map(F.lit("type"), F.parse_json(F.lit('"text"')), F.lit("text"), system,
                                    F.lit("cache_control"), F.parse_json(F.lit('{"type":"ephemeral"}'))))
    blocks = F.try_variant_get(system, "$", "array<map<string,variant>>")
    return F.when(_is_string(system), as_block).when(blocks.isNotNull(), mark_blocks(blocks))


def by_key(mapping: Column) -> Column:
    """The map with its entries in key order, so that its JSON text is canonical."""
    order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.map_from_entries(F.array_sort(F.map_entries(mapping), order))


def sorted_json(mapping: Column) -> Column:
    return F.to_json(by_key(mapping))


def scrub_headers(headers: Column, provider: Column, upstream_key: Column | None = None,
                  control: Sequence[str] = CONTROL_HEADERS) -> Column:
    """Headers as sent upstream: lower-case, no control or hop headers, the provider's own key form."""
    key = F.lit(None).cast("string") if upstream_key is None else upstream_key
    has_key = key.isNotNull() & (key != "")
    anthropic = provider == "anthropic"
    lowered = F.transform(F.map_entries(headers),
                          lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    # Two spellings of one header: the later wins.
    lowered = F.filter(lowered, lambda e, i: ~F.exists(
        F.slice(lowered, i + 2, F.size(lowered)), lambda later: later["key"] == e["key"]))
    kept = F.map_filter(F.map_from_entries(lowered), lambda k, v: ~k.isin(list(control) + DROPPED_HEADERS)
                        & ~(has_key & k.isin("x-api-key", "authorization")))
    bearer = F.regexp_extract(F.coalesce(kept["authorization"], F.lit("")), f"^(?i:Bearer){WS}+(.+)$", 1)
    move = anthropic & ~has_key & (bearer != "") & (F.coalesce(kept["x-api-key"], F.lit("")) == "")
    empty = F.create_map().cast("map<string,string>")
    added = F.when(has_key & anthropic, F.create_map(F.lit("x-api-key"), key)) \
        .when(has_key, F.create_map(F.lit("authorization"), F.concat(F.lit("Bearer "), key))) \
        .when(move, F.create_map(F.lit("x-api-key"), bearer)).otherwise(empty)
    kept = F.map_filter(kept, lambda k, v: ~(move & k.isin("authorization", "x-api-key")))
    version = F.when(anthropic & (F.coalesce(kept["anthropic-version"], F.lit("")) == ""),
                     F.create_map(F.lit("anthropic-version"), F.lit(ANTHROPIC_VERSION))).otherwise(empty)
    kept = F.map_filter(kept, lambda k, v: ~((k == "anthropic-version") & (v == "") & anthropic))
    return F.map_concat(kept, added, version)
