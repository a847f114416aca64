"""Chat formatting: tool calls linked with their results, checked and written as canonical JSON.

A call is ``<tool_call>{"id", "name", "arguments"}</tool_call>`` in a message's text; a result is a
message of role ``tool`` whose text is ``{"tool_call_id", "content"}``. Calls and results are joined
by conversation and identifier. In each conversation messages are put in topological order: by turn,
but a result follows the message that holds its call. Arguments are validated against the schema of
their tool. Each message becomes one line of canonical JSON: keys sorted, no blanks, text as it is.

Rows stay messages; a conversation of a third of all rows is never collected. Its order is made of
ranks within ranges of turns and the ranges' totals.

Edge cases: null text is empty; what can't be parsed (``BROKEN``) stays text and counts as a broken call; a call
whose identifier was used before in the conversation, and a result without a call or after the
call's first result, stay unlinked; equal turns are ordered by role and text; repeated rows repeat;
null conv_ids are one conversation; null turns come first; a tool without a schema is not validated;
a very long text is one message like any other.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, long, string, to_arrow

#: The tools that production transcripts may call, with the schemas of their arguments.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string", "pattern": "^https?://"}}, "required": ["url"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"], "additionalProperties": False},
    "run_code": {"type": "object", "properties": {"language": {"type": "string", "enum": ["python", "sql", "bash"]}, "source": {"type": "string"}, "timeout": {"type": "number", "minimum": 0}}, "required": ["language", "source"], "additionalProperties": False},
}

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
RANGE = 256  # turns ranked together
_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


#: What a message may hold that is no call or result: bad JSON, another type than an object, a missing
#: field, numbers that JSON has no form for, lone surrogates, and nesting too deep to read.
BROKEN = (ValueError, KeyError, TypeError, AttributeError, RecursionError, OverflowError)


def canonical(value: object) -> str:
    out = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    out.encode()  # lone surrogates are no text
    return out


def _text(value: object) -> str:
    return value if isinstance(value, str) and value.encode() is not None else canonical(value)


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` is against the schema: type, enum, properties, required,
    additionalProperties, items, minimum, maximum, minLength, maxLength and pattern."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]

        def fits(kind):
            if kind in ("number", "integer"):
                return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
            return isinstance(value, _KINDS[kind])

        if not any(map(fits, kinds)):
            return [f"{at}: not of type {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += problems(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += problems(v, schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        out += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: out of range"] * (not schema.get("minimum", value) <= value <= schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: bad length"] * (not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)))
        out += [f"{at}: no match"] * ("pattern" in schema and not re.search(schema["pattern"], value))
    return out


def read(role: str | None, text: str, schemas: dict[str, dict]) -> tuple[str, list[dict], int, str | None, str | None]:
    """Content, calls, broken calls, the result's call identifier and its content as JSON."""
    if role == "tool":
        try:
            x = json.loads(text)
            return "", [], 0, _text(x["tool_call_id"]), canonical(x.get("content"))
        except BROKEN:
            return text, [], 0, None, None
    if "<tool_call>" not in text:
        return text, [], 0, None, None
    calls, broken = [], 0

    def take(m):
        nonlocal broken
        try:
            x = json.loads(m[1])
            arguments, name = x.get("arguments", {}), _text(x["name"])
            schema = schemas.get(name)
            wrong = problems(arguments, schema) if schema is not None else []
            calls.append({"id": _text(x["id"]), "name": name, "arguments": canonical(arguments), "problems": wrong})
            return ""
        except BROKEN:
            broken += 1
            return m[0]

    return CALL.sub(take, text), calls, broken, None, None


def line(turn: int | None, role: str | None, content: str, calls: list[dict], result_of: str | None, result: str | None, answered: set[str]) -> str:
    """A message as canonical JSON, put together from parts that are: arguments and results aren't read
    again, so what could be read once can be written at any depth."""
    parts = {"content": canonical(content) if result_of is None else result, "role": canonical(role), "turn": canonical(turn)}
    if result_of is not None:
        parts["tool_call_id"] = canonical(result_of)
    if calls:
        each = [{"arguments": c["arguments"], "answered": canonical(c["id"] in answered), "id": canonical(c["id"]), "name": canonical(c["name"])} | ({"problems": canonical(c["problems"])} if c["problems"] else {}) for c in calls]
        parts["tool_calls"] = "[" + ",".join(map(_object, each)) + "]"
    return _object(parts)


def _object(parts: dict[str, str]) -> str:
    return "{" + ",".join(f'"{k}":{parts[k]}' for k in sorted(parts)) + "}"


_CALLS = T.ArrayType(T.StructType([string("id"), string("name"), string("arguments"), T.StructField("problems", T.ArrayType(T.StringType()))]))


def linked(messages: DataFrame, schemas: dict[str, dict] | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per message: conv_id, turn, ord (from 0), role, json, n_calls, n_invalid, linked."""
    schemas = schemas or {}
    source = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = [string("content"), T.StructField("calls", _CALLS), long("broken"), string("result_of"), string("result")]
    schema = T.StructType([source.schema["conv_id"], long("turn"), string("role"), *fields])
    types = [to_arrow(f.dataType) for f in fields]

    def parse(batches):
        for batch in batches:
            rows = [read(r, t, schemas) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=schema.names)

    rows = source.mapInArrow(parse, schema).withColumn("m", F.monotonically_increasing_id())
    rows = cut(rows)
    call = rows.where(F.size("calls") > 0).select("conv_id", "turn", "m", F.posexplode("calls").alias("k", "c")).select("conv_id", "turn", "m", "k", F.col("c.id").alias("call"))
    first = call.groupBy("conv_id", "call").agg(F.min(F.struct("turn", "m", "k")).alias("at"))
    answer = rows.where("result_of is not null").groupBy("conv_id", F.col("result_of").alias("call")).agg(F.min(F.struct("turn", "m")).alias("by"))
    link = first.join(answer.withColumnRenamed("conv_id", "ac").withColumnRenamed("call", "acall"), F.col("conv_id").eqNullSafe(F.col("ac")) & (F.col("call") == F.col("acall")))
    of_result = link.select(F.col("by.m").alias("m"), F.col("at.turn").alias("call_turn"))
    of_call = link.groupBy(F.col("at.m").alias("m")).agg(F.collect_set("call").alias("answered"))
    joined = rows.join(of_result, "m", "left").join(of_call, "m", "left")
    linked_ = F.col("call_turn").isNotNull()
    joined = joined.withColumns({"at": F.greatest("turn", "call_turn"), "phase": F.when(linked_, 1).otherwise(0), "span": F.floor(F.greatest("turn", "call_turn") / RANGE), "is_result": linked_})
    inner = Window.partitionBy("conv_id", "span").orderBy("at", "phase", "turn", "role", "content", "m")
    totals = joined.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("conv_id").alias("bc"), F.col("span").alias("bs"), "before")
    ranked = joined.withColumn("inner", F.row_number().over(inner) - 1).join(before, F.col("conv_id").eqNullSafe(F.col("bc")) & F.col("span").eqNullSafe(F.col("bs")))
    placed = ranked.withColumn("ord", (F.col("inner") + F.col("before")).cast("long")).select("conv_id", "turn", "ord", "role", "content", "calls", "broken", "result_of", "result", "answered", "is_result")
    out = T.StructType([placed.schema["conv_id"], long("turn"), long("ord"), string("role"), string("json"), long("n_calls"), long("n_invalid"), T.StructField("linked", T.BooleanType())])

    def write(batches):
        for batch in batches:
            lines, n, invalid, joined = [], [], [], []
            for turn, role, content, calls, broken, result_of, result, answered, is_result in zip(*[c.to_pylist() for i, c in enumerate(batch.columns) if i not in (0, 2)], strict=True):
                lines.append(line(turn, role, content, calls or [], result_of, result, set(answered or ())))
                n.append(len(calls))
                invalid.append(broken + sum(bool(c["problems"]) for c in calls))
                joined.append(bool(is_result) or bool(calls) and len(set(answered or ())) == len({c["id"] for c in calls}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(lines, pa.string()), pa.array(n, pa.int64()), pa.array(invalid, pa.int64()), pa.array(joined, pa.bool_())], names=out.names)

    return placed.mapInArrow(write, out)
