"""Chat formatting with DataFrame functions only: tool calls are linked with their results, checked and serialised.

An assistant's text may be a JSON object with ``tool_calls``: ``[{"id", "name", "arguments", "depends_on"?}]``; a tool's
text is a JSON object with ``tool_call_id`` and ``content``. All else is plain text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.llm.store import written

#: JSON schema types by the start of a variant's type.
_TYPES = (("BIGINT", "integer"), ("BOOLEAN", "boolean"), ("STRING", "string"), ("ARRAY", "array"), ("OBJECT", "object"), ("VOID", "null"), ("DECIMAL", "number"), ("DOUBLE", "number"), ("FLOAT", "number"))


def _json_type(value: Column) -> Column:
    name = F.schema_of_variant(value)
    out = F.when(name.startswith("BIGINT"), F.lit("integer"))
    for start, kind in _TYPES[1:]:
        out = out.when(name.startswith(start), F.lit(kind))
    return out


def _get(value: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(value), path, kind)


def _schema_rows(tools: dict[str, dict]) -> list[tuple[str, str, list[str], bool]]:
    """(tool, argument, types, required) of all arguments; no types allow any; a tool without arguments has a row with argument ''."""
    out = []
    for tool, schema in sorted(tools.items()):
        known, needed = schema.get("properties", {}), set(schema.get("required", []))
        types = {a: known.get(a, {}).get("type", []) for a in sorted({*known, *needed})}
        out += [(tool, a, [t] if isinstance(t, str) else list(t), a in needed) for a, t in types.items()] or [(tool, "", [], False)]
    return out


def _checked(calls: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Add ``problems``: what the tool's schema objects to, sorted. Schemas are literals; extra arguments are allowed unless additionalProperties is false."""
    rows = _schema_rows(tools)
    schema = F.from_json(F.lit(json.dumps([dict(zip(("tool", "arg", "types", "required"), r, strict=True)) for r in rows])), "array<struct<tool:string,arg:string,types:array<string>,required:boolean>>")
    closed = [t for t, s in sorted(tools.items()) if s.get("additionalProperties") is False]
    own = F.filter(schema, lambda s: s["tool"] == F.col("name"))
    kinds = F.col("kinds")
    have = lambda s: F.try_element_at(kinds, s["arg"])
    missing = F.transform(F.filter(own, lambda s: s["required"] & have(s).isNull()), lambda s: F.concat(F.lit("missing:"), s["arg"]))
    wrong = F.transform(
        F.filter(own, lambda s: (F.size(s["types"]) > 0) & have(s).isNotNull() & ~F.array_contains(s["types"], have(s)) & ~(F.array_contains(s["types"], F.lit("number")) & (have(s) == "integer"))),
        lambda s: F.concat(F.lit("type:"), s["arg"]),
    )
    names = F.transform(own, lambda s: s["arg"])
    extra = F.when(F.col("name").isin(closed), F.transform(F.filter(F.map_keys(kinds), lambda a: ~F.array_contains(names, a)), lambda a: F.concat(F.lit("unknown:"), a)))
    found = F.when(F.col("name").isNull(), F.array(F.lit("no_name"))).when(F.size(own) == 0, F.array(F.lit("unknown_tool"))).when(kinds.isNull(), F.array(F.lit("no_arguments"))).otherwise(F.concat(missing, wrong, F.coalesce(extra, F.array().cast("array<string>"))))
    pairs = F.map_from_entries(F.transform(F.map_entries("args"), lambda e: F.struct(e["key"], _json_type(e["value"]))))
    return calls.withColumn("args", F.expr("try_cast(arguments as map<string,variant>)")).withColumn("kinds", pairs).withColumn("problems", F.array_sort(found)).drop("args", "kinds")


def _levels(calls: DataFrame) -> DataFrame:
    """Calls in topological order: (conv, call_id, level, anchor). A round for each step of the longest chain.

    A call's anchor is the last turn among its own and those of the calls it waits for. In or behind a cycle level and
    anchor are null.
    """
    ids = ["conv", "call_id"]
    turns = calls.select(*ids, "turn")
    edges = calls.select("conv", F.col("call_id").alias("to"), F.explode("depends_on").alias("call_id")).join(calls.select(*ids), ids).select("conv", F.col("call_id").alias("from"), F.col("to").alias("call_id")).distinct()
    edges = written(edges, "chat")
    done = turns.join(edges, ids, "left_anti").select(*ids, F.lit(0).alias("level"), F.col("turn").alias("anchor"))
    if edges.isEmpty():
        return done
    left, done, level = written(turns.join(edges, ids, "left_semi"), "chat"), written(done, "chat"), 0
    while True:
        level += 1
        blocked = edges.join(left.select("conv", F.col("call_id").alias("from")), ["conv", "from"], "left_semi").select(*ids)
        waited = edges.join(done.select("conv", F.col("call_id").alias("from"), "anchor"), ["conv", "from"]).groupBy(*ids).agg(F.max("anchor").alias("anchor"))
        free = written(left.join(blocked, ids, "left_anti").join(waited, ids).select(*ids, F.lit(level).alias("level"), F.greatest("turn", "anchor").alias("anchor")), "chat")
        if free.isEmpty():
            unknown = left.select(*ids, F.lit(None).cast("int").alias("level"), F.lit(None).cast(left.schema["turn"].dataType).alias("anchor"))
            return done.unionByName(unknown)
        done, left = done.unionByName(free), written(left.join(free, ids, "left_anti"), "chat")


def format_chats(turns: DataFrame, tools: dict[str, dict], *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Link calls and results, order them, validate arguments and serialise each message.

    Returns a row for each row of ``turns`` and one more for each tool call: conversation, turn, ``role`` (``call`` for a
    call), ``call_id``, ``status``, ``problems`` and ``message``, with the keys of a topological order of a conversation:
    ``order_turn``, ``order_level``, ``order_place``, ``order_kind``. By these a message stands at its turn, its calls
    follow it by level (a call's level is above those it depends on, and its turn not before theirs), and each result
    follows its call.

    status: of a call ``linked``, ``no_result``, ``duplicate_id`` (all but the first call of an id), ``cycle`` or ``no_id``;
    of a result ``linked``, ``duplicate_result`` (all but the first), ``no_call`` or ``no_id``; else ``plain``. problems:
    what the tool's JSON schema (type, required and additionalProperties of the arguments themselves) objects to; other keywords, and what lies
    within an argument, are not checked. message: canonical JSON, keys sorted
    and no white space.

    A null or empty text, or one that isn't such a JSON object, is plain text; null content is JSON null. Rows with a null
    conversation or turn are plain. Repeated rows stay repeated: their calls count as duplicates. An empty table gives
    an empty result. A very long text is parsed and serialised whole. Other columns are ignored. No conversation is gathered in one task: links are hash joins on
    conversation and call.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    tooling = F.col("role").isin("assistant", "tool") & F.col("conv").isNotNull() & F.col("turn").isNotNull() & F.col("text").rlike(r"^[ \t\r\n]*\{")
    parsed = rows.withColumn("json", F.when(tooling, F.try_parse_json("text")))
    parsed = parsed.withColumn("listed", F.when(F.col("role") == "assistant", _get("json", "$.tool_calls", "array<variant>"))).withColumn("answers", F.when(F.col("role") == "tool", F.expr("try_variant_get(json, '$.tool_call_id', 'string')")))
    is_call, is_result = F.size(F.coalesce("listed", F.array().cast("array<variant>"))) > 0, (F.col("role") == "tool") & F.col("json").isNotNull()

    order = ("order_turn", "order_level", "order_place", "order_kind")
    out_cols = ("conv", "turn", "role", "call_id", "status", "problems", "message", *order)
    none, no_problem = F.lit(None).cast("string"), F.array().cast("array<string>")
    content = F.when(is_call, _get("json", "$.content", "string")).otherwise(F.col("text"))
    plain = parsed.where(~F.coalesce(is_result, F.lit(False))).select(
        "conv", "turn", "role", none.alias("call_id"), F.lit("plain").alias("status"), no_problem.alias("problems"),
        F.to_json(F.struct(content.alias("content"), "role"), {"ignoreNullFields": "false"}).alias("message"),
        F.col("turn").cast("long").alias("order_turn"), F.lit(0).alias("order_level"), F.lit(0).alias("order_place"), F.lit(0).alias("order_kind"),
    )

    exploded = parsed.where(is_call).select("conv", "turn", F.posexplode("listed").alias("place", "call"))
    calls = written(
        exploded.select("conv", "turn", "place", _get("call", "$.id", "string").alias("call_id"), _get("call", "$.name", "string").alias("name"), _get("call", "$.arguments", "variant").alias("arguments"), _get("call", "$.depends_on", "array<string>").alias("depends_on"))
        .withColumn("key", F.monotonically_increasing_id()),
        "chat",
    )
    results = written(parsed.where(is_result).select("conv", "turn", F.col("answers").alias("call_id"), _get("json", "$.content", "variant").alias("content")).withColumn("key", F.monotonically_increasing_id()), "chat")

    first = calls.where("call_id is not null").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "place", "key")).alias("f")).select("conv", "call_id", F.col("f.turn").alias("call_turn"), F.col("f.place").alias("call_place"), F.col("f.key").alias("first_key"))
    answer = results.where("call_id is not null").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "key")).alias("f")).select("conv", "call_id", F.col("f.key").alias("answer_key"))
    unique = calls.join(first.select(F.col("first_key").alias("key")), "key", "left_semi")
    levels = _levels(unique)

    linked_calls = _checked(calls, tools).join(first.select("conv", "call_id", "first_key"), ["conv", "call_id"], "left").join(answer, ["conv", "call_id"], "left").join(levels, ["conv", "call_id"], "left")
    call_status = F.when(F.col("call_id").isNull(), "no_id").when(F.col("key") != F.col("first_key"), "duplicate_id").when(F.col("level").isNull(), "cycle").when(F.col("answer_key").isNull(), "no_result").otherwise("linked")
    call_rows = linked_calls.select(
        "conv", "turn", F.lit("call").alias("role"), "call_id", call_status.alias("status"), "problems",
        F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name"), {"ignoreNullFields": "false"}).alias("message"),
        F.coalesce("anchor", "turn").cast("long").alias("order_turn"), F.coalesce(F.col("level") + 1, F.lit(1 << 30)).alias("order_level"), F.col("place").alias("order_place"), F.lit(1).alias("order_kind"),
    )

    linked_results = results.join(first, ["conv", "call_id"], "left").join(answer, ["conv", "call_id"], "left").join(levels, ["conv", "call_id"], "left")
    found = F.col("call_turn").isNotNull()
    result_status = F.when(F.col("call_id").isNull(), "no_id").when(~found, "no_call").when(F.col("key") != F.col("answer_key"), "duplicate_result").otherwise("linked")
    result_rows = linked_results.select(
        "conv", "turn", F.lit("tool").alias("role"), "call_id", result_status.alias("status"), no_problem.alias("problems"),
        F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id")), {"ignoreNullFields": "false"}).alias("message"),
        F.coalesce("anchor", "call_turn", "turn").cast("long").alias("order_turn"), F.when(found, F.coalesce(F.col("level") + 1, F.lit(1 << 30))).otherwise(0).alias("order_level"), F.coalesce("call_place", F.lit(0)).alias("order_place"), F.when(found, 2).otherwise(0).alias("order_kind"),
    )
    out = plain.select(*out_cols).unionByName(call_rows.select(*out_cols)).unionByName(result_rows.select(*out_cols))
    return out.withColumnsRenamed({"conv": conv_col, "turn": turn_col})
