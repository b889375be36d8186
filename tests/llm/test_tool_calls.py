import json

from plumeworks.llm import tool_calls

SCHEMAS = {"add": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": ["number", "object"]}}, "required": ["x"], "additionalProperties": False}}


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def answer(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", "hi é \"q\"\n"),
        (1, 1, "tool", answer("b")),  # ahead of its call
        (1, 2, "assistant", call(("b", "add", {"x": 1, "y": {"$result": "a"}}), ("a", "add", {"y": "no"}), content="text")),
        (1, 3, "tool", answer("a")),
        (1, 4, "tool", answer("lost")),
        (1, 5, "assistant", call(("b", "add", {"x": 2}), (None, "mul", "{\"x\": 1}"))),
        (2, 0, "tool", answer("a")),
        (2, 1, "assistant", call(("p", "add", {"x": {"$result": "q"}}), ("q", "add", {"x": {"$result": "p"}}))),
        (None, None, None, None),
        (3, 0, "assistant", "{not json"),
    ]
    got = tool_calls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas=SCHEMAS).collect()
    by = {(r["conv_id"], r["turn"], r["part"]): r for r in got}
    assert len(got) == 14
    assert by[1, 0, 0]["json"] == '{"content":"hi é \\"q\\"\\n","role":"user"}' and by[1, 0, 0]["linked"] is None
    assert [by[k]["level"] for k in ((1, 2, 2), (1, 3, 0), (1, 2, 1), (1, 1, 0))] == [0, 1, 2, 3]
    assert by[1, 2, 1]["valid"] and by[1, 2, 1]["linked"] and by[1, 2, 0]["json"] == '{"content":"text","role":"assistant"}'
    assert by[1, 2, 2]["errors"] == "$.x: missing; $.y: not number or object"
    assert by[1, 4, 0]["linked"] is False and by[2, 0, 0]["linked"] is False
    assert by[1, 5, 0]["linked"] is False and by[1, 5, 1]["errors"] == "no such tool"
    assert by[2, 1, 0]["level"] is None and by[2, 1, 1]["level"] is None
    assert by[None, None, 0]["json"] == '{"content":null,"role":null}' and by[3, 0, 0]["kind"] == "message"


def test_empty_table(spark):
    assert tool_calls.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_bad_schemas_and_enums():
    assert tool_calls.faults({"x": 1}, {"type": "thing"}) == ["$: bad schema, no type thing"]
    assert tool_calls.faults(3, {"minimum": "low"}) == ["$: bad schema"]
    assert tool_calls.faults({"x": 1}, {"properties": {"x": "number"}}) == ["$.x: bad schema"]
    assert tool_calls.faults(True, {"enum": [1]}) == ["$: not in enum"] and tool_calls.faults(1.0, {"enum": [1]}) == []


def test_arguments_nested_deep_do_not_fail():
    for n in (100, 1200, 3000, 20000):
        deep = "[" * n + '{"$result": "y"}' + "]" * n
        for given in ('{"a": ' + deep + "}", json.dumps('{"a": ' + deep + "}")):
            (part,) = tool_calls.parts("assistant", '{"tool_calls": [{"id": "x", "name": "f", "arguments": ' + given + "}]}", {"f": {"type": "object"}})
            assert part["kind"] == "message" or part["errors"] or part["refs"] == ["y"]
