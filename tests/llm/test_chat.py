import json

from pyspark.sql import functions as F

from lodestar.llm.chat import Rule, Tool, link, op10_chat, positions, traffic_of

SCHEMA = "conv_id long, turn long, role string, content string, call_id string, name string, arguments string, after array<string>, line int, status int"
ADD = Tool("add", {"a": Rule("integer"), "b": Rule("number", required=False, least=0, most=9), "how": Rule("string", required=False, longest=3, one_of=("x", "abcd"))})


def linked(spark, rows):
    df = spark.createDataFrame([(*r, *[None] * (8 - len(r)), 0, 0) for r in rows], SCHEMA)
    return [r.asDict() for r in link(df, [ADD]).orderBy("conv_id", "position").collect()]


def test_links_validates_and_orders(spark):
    got = linked(spark, [
        (1, 0, "user", "hi"),
        (1, 1, "call", None, "c", "add", '{"b": 2.50, "a": 1}', ["b"]),
        (1, 2, "call", None, "b", "add", '{"a": "x", "b": 10, "z": 0}', ["a"]),
        (1, 3, "call", None, "a", "add", '{"a": 3}', ["nope"]),
        (1, 4, "result", "r-c", "c"), (1, 5, "result", "again", "c"), (1, 6, "result", "?", "q"),
        (1, 7, "call", None, "a", "add", '{"a": 4}'),
        (2, 0, "call", None, "a", "add", "{bad", ["b"]), (2, 1, "call", None, "b", "sub", "[1]", ["a"]), (2, 2, "call", None, "d", "mul", "{}"),
        (None, 0, "call", None, "a", "add", None), (None, 1, "result", "ok", "a"), (None, None, None, None), (3, 0, "call", None, None, "add", '{"a": 1, "how": "abcd"}'),
    ])
    one = [r for r in got if r["conv_id"] == 1]
    order = [r["call_id"] for r in one if r["status"] in ("linked", "unanswered")]
    assert order == ["a", "b", "c"]
    by = {(r["call_id"], r["status"]): r for r in one}
    assert by["a", "unanswered"]["errors"] == "after: unknown nope" and not by["a", "unanswered"]["valid"]
    assert by["b", "unanswered"]["errors"] == "a: not integer; b: over 9; z: unknown"
    assert by["c", "linked"]["valid"] and by["c", "linked"]["result_turn"] == 4
    assert json.loads(by["c", "linked"]["line"]) == {"arguments": {"a": 1, "b": 2.5}, "id": "c", "name": "add", "result": "r-c", "status": "linked", "turn": 1}
    assert {("c", "extra"), ("q", "orphan"), ("a", "duplicate"), (None, "message")} <= set(by)
    assert [r["position"] for r in one] == list(range(1, len(one) + 1))
    two = {r["call_id"]: r for r in got if r["conv_id"] == 2}
    assert two["a"]["errors"] == "arguments: not JSON; after: cycle" and two["b"]["errors"] == "arguments: not an object; after: cycle" and two["d"]["errors"] == "name: unknown tool"
    none = [r for r in got if r["conv_id"] is None]
    assert [r["status"] for r in none] == ["linked", "message"] and none[0]["errors"] == "arguments: not JSON"
    assert [(r["status"], r["errors"]) for r in got if r["conv_id"] == 3] == [("no_id", "how: longer than 3")]


def test_lines_are_canonical(spark):
    got = linked(spark, [(1, 0, "call", None, "a", "add", ' {"b":1,\n "a": {"z": [1, null, "é"], "c": true}}')])
    assert got[0]["line"].startswith('{"arguments":{"a":{"c":true,"z":[1,null,"é"]},"b":1},"id":"a"')


def test_empty_and_repeated(spark):
    assert linked(spark, []) == []
    row = (1, 0, "call", "x" * 200000, "a", "add", '{"a": 1}')
    assert [r["status"] for r in linked(spark, [row, row])] == ["duplicate", "unanswered"] or [r["status"] for r in linked(spark, [row, row])] == ["unanswered", "duplicate"]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert traffic_of(empty).count() == 0


def test_plan_has_no_python(spark):
    plan = op10_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_hot_conversation_spans_tasks(spark):
    rows = spark.range(4000).select((F.col("id") % 3 * (F.col("id") % 7)).cast("string").alias("g"), (F.col("id") * 7919 % 4001).alias("x"))
    got = positions(rows, "g", ["x"]).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.g, []).append((r.position, r.x))
    assert sum(map(len, seen.values())) == 4000
    for pairs in seen.values():
        assert [p for p, _ in sorted(pairs)] == list(range(1, len(pairs) + 1)) and [x for _, x in sorted(pairs)] == sorted(x for _, x in pairs)


def test_the_query_orders_and_rejects(spark):
    """The registered query meets dependencies that point forward, circles, and each kind of bad arguments."""
    rows = [r.asDict() for r in op10_chat(spark, "/root/testdata/sf0.01").collect()]
    errors = {e for r in rows for e in (r["errors"] or "").split("; ")}
    assert {"after: cycle", "arguments: not JSON", "length: not integer", "note: unknown", "query: missing"} <= errors
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    moved = [c for c, rs in by.items() if [r["turn"] for r in sorted(rs, key=lambda r: r["position"])] != sorted(r["turn"] for r in rs)]
    assert moved
