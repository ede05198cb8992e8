import json

from brindle.llm import chat_format as C

TURNS = "conv_id long, turn long, role string, text string, status string"
SCHEMAS = {"add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a", "b"], "additionalProperties": False}}


def call(i, name="add", **arguments):
    return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": arguments}]})


def result(i, content="3"):
    return json.dumps({"tool_call_id": i, "content": content})


def formatted(spark, rows, schemas=SCHEMAS):
    out = C.format_chats(spark.createDataFrame([(*r, "clash") for r in rows], TURNS), schemas).collect()
    return sorted(out, key=lambda r: (str(r.conv_id), r.at_turn is None, r.at_turn, r["rank"], r.turn or 0, r.at_place, r.json))


def test_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", 'say "é"\n'), (1, 1, "tool", result("x")), (1, 2, "assistant", call("x", b=2.5, a=1)), (1, 3, "tool", result("nobody")),
        (1, 4, "assistant", call("y", a="1", b=2)), (1, 5, "assistant", call("z", "other")), (2, 0, "assistant", call("x", a=1, b=1)), (2, 1, "assistant", call("x", a=1, b=2)),
        (2, 2, "assistant", "{broken"), (2, 3, None, None), (2, 4, "assistant", ""),
    ]
    got = formatted(spark, rows)
    assert [(r.conv_id, r.turn, r.status) for r in got] == [
        (1, 0, "message"), (1, 2, "answered"), (1, 1, "linked"), (1, 3, "orphan"), (1, 4, "invalid"), (1, 5, "invalid"),
        (2, 0, "unanswered"), (2, 1, "duplicate"), (2, 2, "message"), (2, 3, "message"), (2, 4, "message"),
    ]
    assert got[0].json == '{"content":"say \\"é\\"\\n","role":"user"}'
    assert got[1].json == '{"role":"assistant","tool_call":{"arguments":{"a":1,"b":2.5},"id":"x","name":"add"}}'
    assert [r.fault for r in got if r.status == "invalid"] == ["a is no integer", "unknown tool"]
    for r in got:
        assert C.canonical(json.loads(r.json)) == r.json


def test_every_result_follows_its_call(spark):
    rows = [(c, t, "assistant", call(f"k{t}", a=t, b=c)) for c in range(5) for t in range(1, 9)]
    rows += [(c, (t * 5) % 9, "tool", result(f"k{t}")) for c in range(5) for t in range(1, 9)]
    seen = set()
    for r in formatted(spark, rows):
        if r.kind == "call":
            seen.add((r.conv_id, r.call_id))
        else:
            assert (r.conv_id, r.call_id) in seen and r.status == "linked"


def test_faults():
    schema = SCHEMAS["add"]
    assert C.argument_fault({"a": 1, "b": 2}, schema) is None and C.argument_fault('{"a": 1, "b": 2}', schema) is None
    assert C.argument_fault("{", schema) and C.argument_fault([], schema) and C.argument_fault({"a": 1}, schema)
    assert C.argument_fault({"a": True, "b": 1}, schema) == "a is no integer" and C.argument_fault({"a": 1, "b": 1, "c": 0}, schema) == "unexpected c"
    assert C.argument_fault({"a": 1}, {"properties": {"a": {"enum": [2]}}})


def test_edge_cases(spark):
    assert formatted(spark, []) == []
    assert C.format_chats(spark.createDataFrame([], TURNS)).count() == 0
    got = formatted(spark, [(None, None, "tool", result("q")), (1, 1, "user", "x " * 60000), (1, 1, "user", "x " * 60000)])
    assert sorted(r.status for r in got) == ["message", "message", "orphan"]


def test_faults_of_nested_schemas():
    nested = {"type": "object", "properties": {"at": {"type": "object", "required": ["x"], "properties": {"x": {"type": ["number", "null"]}}}, "tags": {"type": "array", "items": {"type": "string"}}}}
    assert C.argument_fault({"at": {"x": None}, "tags": ["a"]}, nested) is None
    assert C.argument_fault({"at": {}}, nested) == "missing at.x"
    assert C.argument_fault({"at": {"x": "1"}}, nested) == "at.x is no number or null"
    assert C.argument_fault({"tags": ["a", 2]}, nested) == "tags[1] is no string"
    assert C.argument_fault({"a": 1}, {"properties": {"a": {"enum": [True]}}}) == "a is none of the allowed values"
    for odd in ({"type": ["nothing"]}, {"type": 5}, {"required": "a"}, {"properties": []}, {"type": "null"}, {"enum": 3}):
        C.argument_fault({"a": 1}, odd)


def test_odd_json_is_no_crash(spark):
    deep = "[" * 100_000 + "]" * 100_000
    odd = [
        '{"tool_calls": [{"id": "a", "name": "add", "arguments": {"a": "\\ud800"}}]}', json.dumps({"tool_calls": [{"id": "b", "arguments": deep}]}), '{"tool_calls": [{"id": "c", "name": ["x"], "arguments": {}}]}',
        '{"tool_calls": [{"id": "d", "name": "add", "arguments": {"a": NaN}}]}', '{"tool_calls": [{"id": "e", "arguments": {"a": 1e999}}]}', '{"x": ' + deep + "}", '{"tool_calls": [{"id": {"k": [1]}, "arguments": "{}"}]}', '{"tools": 5}',
    ]
    rows = [(1, k, role, t) for k, t in enumerate(odd) for role in ("assistant", "tool", "system")] + [(2, 0, "tool", '{"tool_call_id": "\\udc00", "content": Infinity}')]
    got = formatted(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        json.loads(r.json, parse_constant=C._no_number)
    status = {r.call_id: (r.status, r.fault) for r in got if r.kind == "call"}
    assert status == {"a": ("invalid", "missing b"), "b": ("invalid", "arguments are no JSON"), "c": ("invalid", "unknown tool"), '{"k":[1]}': ("invalid", "unknown tool")}


def test_tools_defined_in_the_conversation(spark):
    tools = json.dumps({"tools": [{"name": "sub", "parameters": {"required": ["n"], "properties": {"n": {"type": "integer"}}}}, {"name": "any"}, "odd"]})
    rows = [(1, 0, "system", tools), (1, 1, "assistant", call("s", "sub", n=1)), (1, 2, "assistant", call("t", "sub", n="1")), (1, 3, "assistant", call("u", "none")), (1, 4, "assistant", call("v", "any", q=2)), (2, 0, "assistant", call("w", "none"))]
    got = {r.call_id: r.fault for r in formatted(spark, rows, None) if r.kind == "call"}
    assert got == {"s": None, "t": "n is no integer", "u": "unknown tool", "v": None, "w": None}
    assert len(formatted(spark, rows, None)) == len(rows)


def slow(rows):
    """(conv, turn, kind, call_id, status, position) of every line of one JSON call or result a turn, without Spark."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[3]))
        kinds = []
        for _, turn, role, text in mine:
            body = json.loads(text) if text.startswith("{") else {}
            i = body["tool_calls"][0]["id"] if "tool_calls" in body else body.get("tool_call_id")
            kinds.append((turn, "call" if "tool_calls" in body else "result" if i else "message", i, text))
        calls = {i: turn for turn, kind, i, _ in reversed(kinds) if kind == "call"}
        answered = {i for _, kind, i, _ in kinds if kind == "result"}
        seen, lines = set(), []
        for turn, kind, i, text in kinds:
            if kind == "message":
                status = "message"
            elif (kind, i) in seen:
                status = "duplicate"
            elif kind == "call":
                status = "answered" if i in answered else "unanswered"
            else:
                status = "linked" if i in calls else "orphan"
            seen.add((kind, i))
            late = kind == "result" and calls.get(i, -1) >= turn
            lines.append((calls[i] if late else turn, late, turn, text, kind, i, status))
        for position, (_, _, turn, _, kind, i, status) in enumerate(sorted(lines)):
            out.append((conv, turn, kind, i, status, position))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, tmp_path):
    from brindle.llm import queries

    rng = __import__("random").Random(4)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 30)):
            i = f"k{rng.randrange(8)}"
            rows.append(rng.choice([(conv, turn, "user", f"hello {turn}"), (conv, turn, "assistant", call(i, a=turn)), (conv, turn, "tool", result(i, str(turn)))]))
    spark.createDataFrame([(*r, "clash") for r in rows], TURNS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got, last, position = [], None, 0
    for r in sorted(queries.op8_chat_format(spark, str(tmp_path)).collect(), key=lambda r: (r.conv_id, r.at_turn, r["rank"], r.turn, r.at_place, r.json)):
        position = position + 1 if r.conv_id == last else 0
        last = r.conv_id
        got.append((r.conv_id, r.turn, r.kind, r.call_id, r.status, position))
    assert sorted(got, key=str) == slow(rows)


def test_repeated_rows_keep_their_lines(spark):
    rows = [(1, 1, "assistant", call("x", a=1, b=1)), (1, 1, "assistant", call("x", a=1, b=1)), (1, 2, "tool", result("x")), (1, 2, "tool", result("x"))]
    assert sorted(r.status for r in formatted(spark, rows)) == ["answered", "duplicate", "duplicate", "linked"]
