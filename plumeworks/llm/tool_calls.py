"""Chat formatting with linked tool calls: one canonical JSON line for each message, call and result."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, saved

#: JSON types by the schema's names. Fixed values.
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


#: Parts of a schema, what stands for one that is missing, and their kinds.
SHAPES = (("type", "", (str, list)), ("enum", [], list), ("minimum", 0, (int, float)), ("maximum", 0, (int, float)), ("properties", {}, dict), ("required", [], list))


def same(x, y) -> bool:
    """Whether two JSON values are equal; true isn't 1."""
    return canonical(x) == canonical(y) or x == y and not isinstance(x, bool) and not isinstance(y, bool) and isinstance(x, (int, float)) and isinstance(y, (int, float))


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value: type, required, properties, additionalProperties, enum, items, minimum and maximum are known.

    A part of the schema that isn't of its kind, such as an unknown type's name, is a fault of every value.
    """
    if not isinstance(schema, dict) or not all(isinstance(schema.get(k, d), t) for k, d, t in SHAPES):
        return [f"{at}: bad schema"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if unknown := [str(k) for k in kinds if not isinstance(k, str) or k not in TYPES]:
        return [f"{at}: bad schema, no type {', '.join(unknown)}"]
    if kinds and not any(isinstance(value, TYPES[k]) and (not isinstance(value, bool) or k == "boolean") for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: {word}" for key, word, bad in (("minimum", "too small", lambda m: value < m), ("maximum", "too large", lambda m: value > m)) if key in schema and bad(schema[key])]
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += faults(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def references(value) -> set[str]:
    """Identifiers of calls whose results an argument takes: {"$result": id} anywhere in it, however deep."""
    found, left = set(), [value]
    while left:
        x = left.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$result"), str):
                found.add(x["$result"])
            left.extend(x.values())
        elif isinstance(x, list):
            left.extend(x)
    return found


def loaded(text: str | None):
    """The JSON object that a text is, or None."""
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text)
        canonical(value).encode()
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def parts(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[dict]:
    """The message, its calls and its result as rows."""
    value = loaded(text) if role in ("assistant", "tool") else None
    if role == "tool" and value and isinstance(value.get("tool_call_id"), str):
        return [{"kind": "result", "call_id": value["tool_call_id"], "json": canonical({"content": value.get("content"), "role": "tool", "tool_call_id": value["tool_call_id"]})}]
    if role == "assistant" and value and isinstance(value.get("tool_calls"), list):
        out = [{"kind": "message", "json": canonical({"content": value["content"], "role": role})}] if value.get("content") else []
        for call in value["tool_calls"]:
            call = call if isinstance(call, dict) else {"arguments": call}
            wrong, given = [], call.get("arguments")
            if isinstance(given, str):
                given = loaded(given)
            try:
                if not isinstance(given, dict):
                    wrong, given = ["$: not object"], {}
                elif call.get("name") in schemas:
                    wrong = faults(given, schemas[call["name"]])
                elif schemas:
                    wrong = ["no such tool"]
                canonical({"arguments": {"": given}})
            except RecursionError:  # nested so deep that it can't be compared or written
                wrong, given = ["$: nested too deep"], {}
            key, name = (call.get(k) if isinstance(call.get(k), str) else None for k in ("id", "name"))
            out.append({"kind": "call", "call_id": key, "name": name, "errors": wrong, "refs": sorted(references(given)), "json": canonical({"arguments": given, "id": key, "name": name, "role": "assistant"})})
        return out
    return [{"kind": "message", "json": canonical({"content": text, "role": role})}]


PART = pa.struct([("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("errors", pa.list_(pa.string())), ("refs", pa.list_(pa.string())), ("json", pa.string())])
PARTS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "call_id", "name")] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("errors", "refs")] + [T.StructField("json", T.StringType())]))


def link(messages: DataFrame, *, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages, tool calls and tool results, linked and in an order where each result follows its call.

    An assistant's text that is an object with `tool_calls` gives a row for each
    call (id, name, arguments), and a tool's text with `tool_call_id` a result; all else is a message as it is.
    Returns conv_col, turn_col, part (place in the message), kind, call_id, name, linked (a result
    whose call exists, a call that has a result; null for messages), valid and errors
    (of a call's arguments by schemas), level, json. Sorted by level, then turn, then part, a
    conversation is in topological order: a result stands above its call, and a call above the results
    that its arguments name; level is 0 without such needs and null in a circle or beyond one. Of calls that repeat an identifier in a
    conversation the first counts, and later ones are not linked. Null identifiers link nothing, nor does a null conversation.
    A null text or role is serialised as null. Empty tables give no rows. Other columns are ignored.

    Calls and results are joined by (conversation, identifier); no conversation is gathered.
    """
    spark = messages.sparkSession
    arrow_rows(spark)
    source = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema["conv"], source.schema["turn"], T.StructField("parts", PARTS)])
    rules = schemas or {}

    def run(batches):
        for batch in batches:
            rows = [parts(r, t, rules) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), pa.array(rows, pa.list_(PART))], ["conv", "turn", "parts"])

    rows = source.mapInArrow(run, schema).select("conv", "turn", F.posexplode("parts").alias("part", "p")).select("conv", "turn", "part", "p.*").withColumn("uid", F.monotonically_increasing_id())
    rows = saved(rows, "chat")
    tools = rows.filter("kind <> 'message' and call_id is not null and conv is not null")
    first = F.min(F.struct(F.col("turn").isNull().alias("late"), "turn", "part", "uid"))
    owners = saved(tools.filter("kind = 'call'").groupBy("conv", "call_id").agg(first.alias("f")).select("conv", "call_id", F.col("f.uid").alias("owner")), "owners")
    answered = tools.filter("kind = 'result'").groupBy("conv", "call_id").agg(F.count("*").alias("n")).join(owners, ["conv", "call_id"])
    results = tools.filter("kind = 'result'").join(owners, ["conv", "call_id"])
    linked = results.select("uid").union(answered.select(F.col("owner").alias("uid"))).withColumn("linked", F.lit(True))

    # Who must come before whom. A call that takes a call's result waits for the call itself, one level further down.
    asks = rows.filter("kind = 'call' and conv is not null").select("conv", F.col("uid").alias("after"), F.explode("refs").alias("call_id"))
    needs = results.select(F.col("owner").alias("before"), F.col("uid").alias("after"), F.lit(1).alias("step"))
    needs = saved(needs.union(asks.join(owners, ["conv", "call_id"]).select(F.col("owner").alias("before"), "after", F.lit(2).alias("step"))).distinct(), "needs")
    placed = saved(rows.join(needs.select(F.col("after").alias("uid")).distinct(), "uid", "left_anti").select("uid", F.lit(0).alias("level")), "levels")
    waiting = needs
    while not waiting.isEmpty():
        known = waiting.join(placed, F.col("before") == F.col("uid"), "left").groupBy("after").agg(F.max(F.col("level") + F.col("step")).alias("level"), F.max(F.col("level").isNull()).alias("open")).filter("not open")
        now = saved(known.select(F.col("after").alias("uid"), "level"), "levels")
        if now.isEmpty():
            break
        placed = saved(placed.union(now), "levels")
        waiting = saved(waiting.join(now.select(F.col("uid").alias("after")), "after", "left_anti").select("before", "after", "step"), "needs")
    out = rows.join(linked, "uid", "left").join(placed, "uid", "left")
    is_call = F.col("kind") == "call"
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "part", "kind", "call_id", "name",
        F.when(F.col("kind") != "message", F.coalesce("linked", F.lit(False))).alias("linked"),
        F.when(is_call, F.size("errors") == 0).alias("valid"),
        F.when(is_call, F.array_join("errors", "; ")).alias("errors"),
        "level", "json",
    )
