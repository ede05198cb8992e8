"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

An assistant turn whose text is a JSON object with ``tool_calls`` (a list of objects with id, name and arguments) holds calls; a
tool turn whose text is a JSON object with ``tool_call_id`` and ``content`` is a result; a system turn whose text is a JSON object
with ``tools`` (a list of objects with name and parameters, a JSON schema) defines the conversation's tools; every other turn is
a message with its text, and so is a turn of malformed, endless (NaN, Infinity) or too deeply nested JSON.  Results join their
calls, and calls their schemas, by hash joins on the conversation and the identifier or name.

The columns (conv_id, at_turn, rank, turn, at_place, json) order the lines in full: a result comes after its call, right behind
the call's turn if it stood before it; results moved behind one turn keep their own order.  Lines that tie in all of these are
equal rows.

Status: ``message``; calls are ``answered`` or ``unanswered``, or ``invalid`` if their arguments break the tool's schema or the
tool is unknown where tools are defined (in the conversation or by ``schemas``); results are ``linked`` or ``orphan``.  A repeated
identifier belongs to the first call of it in the conversation; further calls and results of it are ``duplicate``.

Null texts are empty, null roles stay null, a null conversation is one like any other.  Repeated rows keep their own lines, and
of repeated calls one is the first.  One line is one row, so a conversation of any length is never gathered; a very long text is
one row of a task.  An empty table gives an empty result.  Columns beside conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import from_files, materialise, place_of, small_batches

#: Tool name to a JSON schema of its arguments.
Schemas = dict[str, dict]
TYPES = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list, "null": type(None)}
LONE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks, and characters above ASCII as they are, but for lone surrogates, which stay escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parsed(text: str) -> object:
    """The JSON value of a text, or ValueError; numbers that are not finite and nesting that cannot be followed are none."""
    try:
        value = json.loads(text, parse_constant=_no_number)
        canonical(value)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    return value


def _is(value: object, kind: str) -> bool:
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("number", "integer"))


def schema_fault(value: object, schema: object, name: str) -> str | None:
    """Where a value breaks a JSON schema (type, enum, properties, required, additionalProperties, items), or None."""
    if schema is False:
        return f"unexpected {name}"
    if not isinstance(schema, dict):
        return None
    kinds = schema.get("type", [])
    kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str) and k in TYPES]
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{name} is no {' or '.join(kinds)}"
    # JSON tells true from 1, so values are compared as they are written.
    if isinstance(schema.get("enum"), list) and canonical(value) not in [canonical(x) for x in schema["enum"]]:
        return f"{name} is none of the allowed values"
    below = "" if name == "arguments" else f"{name}."
    if isinstance(value, dict):
        required, properties = schema.get("required", []), schema.get("properties", {})
        for key in required if isinstance(required, list) else []:
            if isinstance(key, str) and key not in value:
                return f"missing {below}{key}"
        properties = properties if isinstance(properties, dict) else {}
        for key in sorted(value):
            if fault := schema_fault(value[key], properties.get(key, schema.get("additionalProperties", True)), f"{below}{key}"):
                return fault
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            if fault := schema_fault(x, schema["items"], f"{name}[{k}]"):
                return fault
    return None


def argument_fault(arguments: object, schema: dict | None) -> str | None:
    """Why the arguments (an object, or one as JSON in a string) break the schema, or None."""
    try:
        arguments = parsed(arguments) if isinstance(arguments, str) else arguments
    except ValueError:
        return "arguments are no JSON"
    if not isinstance(arguments, dict):
        return "arguments are no object"
    if schema is None:
        return "unknown tool"
    try:
        return schema_fault(arguments, schema, "arguments")
    except RecursionError:
        return "schema nested too deeply"


LINE = ("kind", "call_id", "name", "arguments", "json")


def lines_of(role: str | None, text: str | None) -> list[dict]:
    """The lines of one turn: kind, call_id, name, arguments (as JSON) and json; kind ``tool`` has a tool's schema."""
    text = text or ""
    plain = dict.fromkeys(LINE) | {"kind": "message", "json": canonical({"role": role, "content": text})}
    if role not in ("assistant", "tool", "system") or not text.lstrip().startswith("{"):
        return [plain]
    try:
        body = parsed(text)
    except ValueError:
        return [plain]
    if role == "system":
        tools = body.get("tools")
        tools = [x for x in tools if isinstance(x, dict) and isinstance(x.get("name"), str)] if isinstance(tools, list) else []
        return [plain, *(plain | {"kind": "tool", "name": x["name"], "json": canonical(x.get("parameters", {}))} for x in tools)]
    if role == "tool":
        if "tool_call_id" not in body:
            return [plain]
        i = _identifier(body["tool_call_id"])
        return [plain | {"kind": "result", "call_id": i, "json": canonical({"role": "tool", "tool_call_id": i, "content": body.get("content")})}]
    calls = body.get("tool_calls")
    if not isinstance(calls, list) or not all(isinstance(c, dict) and "id" in c for c in calls):
        return [plain]
    lines = []
    if body.get("content"):
        lines.append(plain | {"json": canonical({"role": role, "content": body["content"]})})
    for call in calls:
        arguments, name, i = call.get("arguments", {}), call.get("name"), _identifier(call["id"])
        as_text = canonical(arguments)
        if isinstance(arguments, str):
            try:
                arguments = parsed(arguments)
            except ValueError:
                pass
        record = {"role": role, "tool_call": {"id": i, "name": name, "arguments": arguments}}
        lines.append({"kind": "call", "call_id": i, "name": name if isinstance(name, str) else None, "arguments": as_text, "json": canonical(record)})
    return lines or [plain]


def _identifier(value: object) -> str:
    return LONE.sub("�", value) if isinstance(value, str) else canonical(value)


def _clean(x: str | None) -> str | None:
    return LONE.sub("�", x) if x else x


def _parse(turns: DataFrame) -> DataFrame:
    extra = "place int, kind string, call_id string, name string, arguments string, json string"
    own = [c for c in turns.columns if c != "text"]
    schema = T.StructType([*(turns.schema[c] for c in own), *T.DataType.fromDDL(extra).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [lines_of(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            source = pa.array([i for i, x in enumerate(found) for _ in x], pa.int32())
            lines = [line for x in found for line in x]
            place = pa.array([k for x in found for k in range(len(x))], pa.int32())
            made = [pa.array([_clean(x[c]) if c == "name" else x[c] for x in lines], pa.string()) for c in LINE]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(source) for c in own), place, *made], names=schema.names)

    return turns.mapInArrow(run, schema)


def _with_faults(calls: DataFrame) -> DataFrame:
    """``calls`` with ``fault`` for its columns ``schema``, ``defined`` (any tools are) and ``untold`` (name of another type)."""
    kept = [c for c in calls.columns if c not in ("schema", "defined", "arguments")]
    schema = T.StructType([*(calls.schema[c] for c in kept), T.StructField("fault", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            faults = []
            for arguments, tool, defined in zip(*(batch.column(c).to_pylist() for c in ("arguments", "schema", "defined"))):
                known = json.loads(tool) if tool is not None else None if defined else {}
                faults.append(_clean(argument_fault(json.loads(arguments), known)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(faults, pa.string())], names=schema.names)

    return calls.mapInArrow(run, schema)


def format_chats(turns: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row a line: conv_id, turn, role, kind, call_id, status, fault, at_turn, rank, at_place, json.

    ``schemas``: tools that every conversation may call; one of a like name defined in the conversation takes its place.
    """
    turns = from_files(turns.select("conv_id", "turn", "role", "text"))
    turns = turns.select("conv_id", "turn", "role", "text", place_of(turns).alias("row"))
    # Only texts that may be JSON take the way of the joins.
    maybe = F.coalesce(F.col("role").isin("assistant", "tool", "system") & F.col("text").rlike(r"^\s*\{"), F.lit(False))
    rest, lines = _parse(turns.filter(~maybe)), materialise(_parse(turns.filter(maybe)))
    common = ["conv_id", "turn", "role", "kind", "call_id"]
    plain = rest.unionByName(lines.filter("kind = 'message'")).select(*common, F.lit("message").alias("status"), F.lit(None).cast("string").alias("fault"), F.col("turn").alias("at_turn"), F.lit(0).alias("rank"), F.col("place").alias("at_place"), "json")

    # Schemas: the last definition of a name in a conversation, else the common one.
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    defined = lines.filter("kind = 'tool'").groupBy(F.col("conv_id").alias("tool_conv"), F.col("name").alias("tool")).agg(F.max(F.struct("turn", "place", "json")).getField("json").alias("own"))
    any_tool = defined.groupBy(F.col("tool_conv").alias("any_conv")).agg(F.lit(True).alias("any_tool"))
    shared = lines.sparkSession.createDataFrame([(k, canonical(v)) for k, v in (schemas or {}).items()], "common string, shared string")
    calls = lines.filter("kind = 'call'").join(defined.hint("shuffle_hash"), same("tool_conv", "conv_id") & (F.col("tool") == F.col("name")), "left")
    calls = calls.join(any_tool.hint("shuffle_hash"), same("any_conv", "conv_id"), "left").join(F.broadcast(shared), F.col("common") == F.col("name"), "left")
    calls = calls.withColumn("schema", F.coalesce("own", "shared")).withColumn("defined", F.coalesce("any_tool", F.lit(schemas is not None)))
    columns = ["conv_id", "turn", "role", "row", "place", "kind", "call_id", "json"]
    calls = _with_faults(calls.select(*columns, "arguments", "schema", "defined"))
    tools = calls.unionByName(lines.filter("kind = 'result'").select(*columns, F.lit(None).cast("string").alias("fault")))

    # The first call and the first result of an identifier, from partial minima; its row tells it from repeated ones.
    order = F.struct(F.col("turn").isNull(), "turn", "place", "json", "row")
    first = lambda kind: F.min(F.when(F.col("kind") == kind, order))
    heads = lines.filter("kind in ('call', 'result')").groupBy(F.col("conv_id").alias("head_conv"), F.col("call_id").alias("head_call")).agg(first("call").alias("call"), first("result").alias("result"))
    linked = tools.join(heads.hint("shuffle_hash"), same("head_conv", "conv_id") & (F.col("head_call") == F.col("call_id")))
    mine = F.when(F.col("kind") == "call", F.col("call")).otherwise(F.col("result"))
    status = (
        F.when(F.col("fault").isNotNull(), "invalid")
        .when(~((mine["row"] == F.col("row")) & (mine["place"] == F.col("place"))), "duplicate")
        .when(F.col("kind") == "call", F.when(F.col("result").isNotNull(), "answered").otherwise("unanswered"))
        .otherwise(F.when(F.col("call").isNotNull(), "linked").otherwise("orphan"))
    )
    moved = F.coalesce((F.col("kind") == "result") & (F.col("call.turn") >= F.col("turn")), F.lit(False))
    ordered = linked.select(*common, status.alias("status"), "fault", F.when(moved, F.col("call.turn")).otherwise(F.col("turn")).alias("at_turn"), moved.cast("int").alias("rank"), F.col("place").alias("at_place"), "json")
    return plain.unionByName(ordered)


#: For tables without tool calls: every turn is a message.
ORACLE_SQL = """
SELECT conv_id, turn, role, 'message' AS kind, NULL::VARCHAR AS call_id, 'message' AS status, NULL::VARCHAR AS fault,
       turn AS at_turn, 0 AS rank, 0 AS at_place,
       '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json
FROM conversations
"""
