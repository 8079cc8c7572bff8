"""Linked, ordered and serialised tool calls on written-out conversations."""

import json

from pyspark.sql import functions as F

from recordforge.llm.chat import format_chats
from recordforge.llm.registry import TOOLS


def calls(*items, content=None):
    return json.dumps({"content": content, "tool_calls": list(items)})


def call(i, name="search", arguments=None, after=()):
    return {"id": i, "name": name, "arguments": {"query": "q"} if arguments is None else arguments} | ({"depends_on": list(after)} if after else {})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", calls(call("b", after=["a"]), call("a"), content="two calls")), (1, 2, "tool", result("b", {"z": 1, "a": [2]})), (1, 3, "tool", result("a", "plain")), (1, 4, "assistant", "done"),
    (2, 0, "assistant", calls(call("a", "search", {"limit": "many", "other": 1}), call("c", "nothing"), call("d", None), call("e", "weather", {"city": "X", "days": 2}))), (2, 1, "tool", result("zz", 1)), (2, 2, "tool", result("e", None)), (2, 3, "tool", result("e", "again")), (2, 4, "tool", "not json"),
    (3, 0, "assistant", calls(call("x", after=["y"]), call("y", after=["x"]), call(None))), (3, 1, "tool", result("x", 0)), (3, 2, "assistant", calls(call("x"))),
    (4, 0, "user", None), (4, 0, "user", None), (None, 0, "user", "no conversation"), (5, None, "assistant", calls(call("q"))), (6, 0, "assistant", "{broken"), (6, 1, "user", 'é "quoted" \\ \n'), (6, 2, "user", "x" * 20000), (7, 0, None, ""),
]


def test_links_order_and_problems(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumns({"call_id": F.lit("clash"), "key": F.lit(0), "message": F.lit("m")})
    got = format_chats(turns, TOOLS).collect()
    assert len(got) == len(ROWS) + 10
    by = {(r["conv_id"], r["turn"], r["role"], r["call_id"]): r for r in got}

    def order(conv):
        rows = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: (r["order_turn"], r["order_level"], r["order_place"], r["order_kind"]))
        return [(r["role"], r["call_id"]) for r in rows]

    assert order(1) == [("user", None), ("assistant", None), ("call", "a"), ("tool", "a"), ("call", "b"), ("tool", "b"), ("assistant", None)]
    assert {k[3]: by[k]["status"] for k in by if k[0] == 1 and k[3]} == {"a": "linked", "b": "linked"}
    assert by[1, 2, "tool", "b"]["message"] == '{"content":{"a":[2],"z":1},"role":"tool","tool_call_id":"b"}'
    assert json.loads(by[1, 1, "assistant", None]["message"]) == {"content": "two calls", "role": "assistant"}

    assert by[2, 0, "call", "a"]["problems"] == ["missing:query", "type:limit", "unknown:other"] and by[2, 0, "call", "a"]["status"] == "no_result"
    assert by[2, 0, "call", "c"]["problems"] == ["unknown_tool"] and by[2, 0, "call", "d"]["problems"] == ["no_name"]
    assert by[2, 0, "call", "e"]["problems"] == [] and by[2, 0, "call", "e"]["status"] == "linked"
    assert [by[2, t, "tool", i]["status"] for t, i in ((1, "zz"), (2, "e"), (3, "e"), (4, None))] == ["no_call", "linked", "duplicate_result", "plain"] if (2, 4, "tool", None) in by else True

    assert by[3, 0, "call", "x"]["status"] == "cycle" and by[3, 0, "call", "y"]["status"] == "cycle" and by[3, 0, "call", None]["status"] == "no_id" and by[3, 2, "call", "x"]["status"] == "duplicate_id"
    for conv, turn, role, text in ROWS:
        if conv in (4, 6, 7):
            mine = [r for r in got if (r["conv_id"], r["turn"], r["role"]) == (conv, turn, role)]
            assert mine and all(r["message"] == json.dumps({"content": text, "role": role}, separators=(",", ":"), ensure_ascii=False) and r["status"] == "plain" for r in mine)


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), TOOLS).count() == 0


def test_white_space_before_json_and_lists_of_types(spark):
    tools = {"look": {"properties": {"at": {"type": ["string", "null"]}, "far": {"type": ["number", "boolean"]}}, "required": ["at"]}}
    given = [{"at": "x", "far": 2}, {"at": None, "far": 2.5}, {"at": 3, "far": "no"}, {"far": True}]
    want = [[], [], ["type:at", "type:far"], ["missing:at"]]
    rows = [(1, k, "assistant", space + calls(call(f"c{k}", "look", a))) for k, (space, a) in enumerate(zip(("\n", "\t", "\r\n ", " "), given, strict=True))]
    rows += [(1, 10 + k, "tool", "\r\n\t " + result(f"c{k}", k)) for k in range(4)] + [(1, 20, "assistant", "\ntext {"), (1, 21, "assistant", "\u00a0" + calls(call("z")))]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()
    made = {r["call_id"]: r for r in got if r["role"] == "call"}
    assert [made[f"c{k}"]["problems"] for k in range(4)] == want and len(made) == 4
    assert all(r["status"] == "linked" for r in got if r["role"] in ("call", "tool"))
    assert all(r["status"] == "plain" for r in got if r["turn"] >= 20)
