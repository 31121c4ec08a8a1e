"""Tool-call linking and canonical chat lines; DataFrame functions only.

Calls and results are hash-joined by (conversation, identifier). A conversation's rows are put in a
topological order of its calls' dependencies: where every dependency stands before its dependant, the order of
turns is one already; the other conversations are ordered by level, taking away in each round the calls whose
dependencies are all placed, with the rounds' tables in the shared folder. Arguments are parsed as JSON and
held against the tool's schema, and each row is serialised as canonical JSON: keys sorted, no white space.

Nothing gathers a conversation: a row is a message, joins and windows spread by (conversation, identifier). Rows
are numbered by dealing them out in ranges of (conversation, place): each range counts its own rows, and a
conversation that spans ranges adds the counts of the ranges before, so one that holds a third of all rows (the null
conversation too) is spread over as many tasks.

Status of a row: `linked` (a call with its result, one row), `unanswered` (a call without one), `orphan` (a
result without a call), `duplicate` (a call whose identifier an earlier call of the conversation has), `extra`
(a further result of an answered call), `no_id` (a call or result without identifier), `message` (any other
role, null included).

Defined results: null content stays null and is left out of the line; null conversations are one conversation;
arguments that are null or no JSON object are invalid; dependencies on unknown calls are errors and
don't order anything; calls on a cycle come last, with an error; repeated rows are duplicates of the first;
ties of turn are ordered by kind, identifier and line; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialize, read_table

TYPES = {"integer": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$", "string": "^STRING$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID$"}


@dataclass(frozen=True)
class Rule:
    """What one argument must be."""

    type: str
    required: bool = True
    least: float | None = None
    most: float | None = None
    longest: int | None = None
    one_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tool:
    name: str
    rules: dict[str, Rule] = field(default_factory=dict)
    others: bool = False


def problems(name: Column, arguments: Column, tools: list[Tool]) -> Column:
    """Sorted array of what is wrong with a call's arguments; empty if they fit the tool's schema."""
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    found = F.lit(None).cast("array<string>")
    for tool in tools:
        checks = []
        for arg, rule in sorted(tool.rules.items()):
            value = F.try_variant_get(parsed, f"$.{arg}", "variant")
            fits = F.schema_of_variant(value).rlike(TYPES[rule.type])
            missing = F.lit(f"{arg}: missing") if rule.required else F.lit(None).cast("string")
            check = F.when(value.isNull(), missing).when(~fits, F.lit(f"{arg}: not {rule.type}"))
            if rule.least is not None:
                check = check.when(F.try_variant_get(parsed, f"$.{arg}", "double") < rule.least, F.lit(f"{arg}: under {rule.least:g}"))
            if rule.most is not None:
                check = check.when(F.try_variant_get(parsed, f"$.{arg}", "double") > rule.most, F.lit(f"{arg}: over {rule.most:g}"))
            if rule.longest is not None:
                check = check.when(F.length(F.try_variant_get(parsed, f"$.{arg}", "string")) > rule.longest, F.lit(f"{arg}: longer than {rule.longest}"))
            if rule.one_of:
                check = check.when(~F.try_variant_get(parsed, f"$.{arg}", "string").isin(list(rule.one_of)), F.lit(f"{arg}: not allowed"))
            checks.append(check)
        wrong = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        if not tool.others:
            keys = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
            known = F.array(*[F.lit(a) for a in tool.rules]).cast("array<string>") if tool.rules else F.array().cast("array<string>")
            unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(k, F.lit(": unknown")))
            wrong = F.concat(wrong, unknown)
        found = F.coalesce(found, F.when(name == tool.name, F.array_sort(wrong)))
    object_ = kind.startswith("OBJECT")
    return F.when(parsed.isNull(), F.array(F.lit("arguments: not JSON"))).when(~object_, F.array(F.lit("arguments: not an object"))).otherwise(F.coalesce(found, F.array(F.lit("name: unknown tool"))))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """ck, id, level of calls; null for calls on a cycle or behind one. Rounds: as many as the longest chain."""
    waiting, placed, level = calls.select("ck", "id"), None, 0
    edges = materialize(edges.select("ck", "id", "dep").distinct(), "chat-edges")
    while True:
        waiting = materialize(waiting, f"chat-round{level}")
        blocked = edges.join(waiting.select("ck", F.col("id").alias("dep")), ["ck", "dep"], "left_semi").select("ck", "id").distinct()
        free = waiting.join(blocked, ["ck", "id"], "left_anti")
        if free.isEmpty():
            rest = waiting.withColumn("level", F.lit(None).cast("int"))
            return rest if placed is None else placed.unionByName(rest)
        now = free.withColumn("level", F.lit(level))
        placed = now if placed is None else placed.unionByName(now)
        waiting = waiting.join(blocked, ["ck", "id"], "left_semi")
        level += 1


def link(messages: DataFrame, tools: list[Tool]) -> DataFrame:
    """messages: conv_id, turn, role (call, result or other), content, call_id, name, arguments, after.

    Gives conv_id, position, call_id, status, turn, result_turn, valid, errors, line.
    """
    rows = messages.select(
        "conv_id", F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string")).alias("ck"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("content").cast("string").alias("content"),
        F.col("call_id").cast("string").alias("id"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"), F.col("after").cast("array<string>").alias("after"),
    )
    traffic = F.coalesce(F.col("role"), F.lit("")).isin("call", "result")
    same = Window.partitionBy("ck", "id").orderBy(F.asc_nulls_last("turn"), "name", "arguments", "content")
    calls = rows.filter((F.col("role") == "call") & F.col("id").isNotNull()).withColumn("nth", F.row_number().over(same))
    results = rows.filter((F.col("role") == "result") & F.col("id").isNotNull()).withColumn("nth", F.row_number().over(same))
    first = calls.filter("nth = 1").drop("role", "nth")
    answer = results.filter("nth = 1").select("ck", "id", F.col("conv_id").alias("r_conv"), F.col("turn").alias("result_turn"), F.col("content").alias("result"), F.lit(True).alias("answered"))
    joined = first.withColumn("called", F.lit(True)).join(answer, ["ck", "id"], "full_outer")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    linked = joined.select(
        "ck", "id", F.coalesce("conv_id", "r_conv").alias("conv_id"), status.alias("status"), F.coalesce("turn", "result_turn").alias("turn"), F.when(F.col("called"), F.col("result_turn")).alias("result_turn"),
        F.col("content"), "name", "arguments", "after", "result", F.col("called").isNotNull().alias("is_call"),
    )
    nothing = F.lit(None)
    other = calls.filter("nth > 1").withColumn("status", F.lit("duplicate")).drop("nth").unionByName(results.filter("nth > 1").withColumn("status", F.lit("extra")).drop("nth"))
    other = other.unionByName(rows.filter(traffic & F.col("id").isNull()).withColumn("status", F.lit("no_id"))).unionByName(rows.filter(~traffic).withColumn("status", F.lit("message")))
    other = other.select("ck", "id", "conv_id", "status", "turn", nothing.cast("long").alias("result_turn"), "content", "name", "arguments", "after", nothing.cast("string").alias("result"), (F.col("role") == "call").alias("is_call"))

    # dependencies of first calls, and whether they stand before their dependants
    asked = first.select("ck", "id", "turn", F.explode("after").alias("dep")).filter(F.col("dep").isNotNull())
    at = first.select("ck", F.col("id").alias("dep"), F.col("turn").alias("dep_turn"))
    edges = asked.join(at, ["ck", "dep"], "left")
    before = (F.col("dep_turn") < F.col("turn")) | ((F.col("dep_turn") == F.col("turn")) & (F.col("dep") < F.col("id")))
    unknown = edges.filter(F.col("dep_turn").isNull()).groupBy("ck", "id").agg(F.array_sort(F.collect_set(F.concat(F.lit("after: unknown "), "dep"))).alias("unknown"))
    forward = edges.filter(F.col("dep_turn").isNotNull() & ~F.coalesce(before, F.lit(False))).select("ck").distinct()
    linked = linked.join(unknown, ["ck", "id"], "left")
    if forward.isEmpty():
        linked = linked.withColumn("level", F.lit(0))
    else:
        late = materialize(forward, "chat-late")
        depth = levels(first.join(late, "ck", "left_semi"), edges.filter(F.col("dep_turn").isNotNull()).join(late, "ck", "left_semi"))
        linked = linked.join(depth.withColumn("ordered", F.lit(True)), ["ck", "id"], "left").withColumn("level", F.when(F.col("ordered").isNull(), 0).otherwise(F.col("level"))).drop("ordered")
    other = other.withColumn("unknown", nothing.cast("array<string>")).withColumn("level", F.lit(0))

    every = linked.unionByName(other)
    errors = F.when(F.col("is_call"), F.concat(problems(F.col("name"), F.col("arguments"), tools), F.coalesce("unknown", F.array().cast("array<string>")), F.when(F.col("level").isNull(), F.array(F.lit("after: cycle"))).otherwise(F.array().cast("array<string>"))))
    line = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "content", "id", "name", "result", "status", "turn"))
    kind = F.when(F.col("is_call"), 0).otherwise(1)
    done = every.withColumn("errors", errors).withColumn("line", line)
    place = [F.asc_nulls_last("level"), F.asc_nulls_last("turn"), kind, F.asc_nulls_last("id"), "line"]
    numbered = positions(done, "ck", place)
    return numbered.select(
        "conv_id", "position", F.col("id").alias("call_id"), "status", "turn", "result_turn",
        F.when(F.col("is_call"), F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), "line",
    )


def positions(rows: DataFrame, group: str, place: list) -> DataFrame:
    """rows with position, from 1 in each group in the order of place. Rows equal in group and place have no order."""
    ranged = rows.repartitionByRange(group, *place).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "chat-ranges")
    inner = F.row_number().over(Window.partitionBy(group, "range").orderBy(*place))
    earlier = F.sum("n").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # only groups that span ranges: fewer rows than there are ranges
    before = ranged.groupBy(group, "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", earlier).filter("before IS NOT NULL").select(group, "range", "before")
    return ranged.withColumn("inner", inner).join(F.broadcast(before), [group, "range"], "left").withColumn("position", (F.col("inner") + F.coalesce("before", F.lit(0))).cast("int")).drop("range", "inner", "before")


#: The tool that the conversations' user turns call in op10_chat.
ASK = Tool("ask", {"length": Rule("integer", least=1, most=2000), "query": Rule("string", longest=400)})


def traffic_of(conversations: DataFrame) -> DataFrame:
    """Plain turns read as tool traffic: a user turn calls `ask` with its text, an assistant turn is the result of
    the turn before it, other turns are messages.

    A call depends on the user turn two before; one whose text's length is a multiple of 3 on the user turn two
    after, so that some dependencies stand after their dependants and some are circular. By the length's remainder
    by 11 the arguments lack the query (1), give the length as text (2), hold one more key (3) or break off (4)."""
    turn = F.col("turn").cast("long")
    name = lambda t: F.concat(F.lit("t"), t.cast("string"))
    text = F.col("text").cast("string")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    n, query = F.length(text), text.alias("query")
    odd = n % 11
    arguments = F.when(odd == 1, F.to_json(F.struct(n.alias("length")))).when(odd == 2, F.to_json(F.struct(query, n.cast("string").alias("length")))).when(odd == 3, F.to_json(F.struct(query, n.alias("length"), F.lit(1).alias("note")))).when(odd == 4, F.lit('{"query"')).otherwise(F.to_json(F.struct(query, n.alias("length"))))
    after = F.when(n % 3 == 0, F.array(name(turn + 2))).when(turn >= 2, F.array(name(turn - 2)))
    return conversations.select(
        "conv_id", turn.alias("turn"), F.when(user, "call").when(assistant, "result").otherwise(F.col("role")).alias("role"), F.when(user.isNull() | ~user, text).alias("content"),
        F.when(user, name(turn)).when(assistant, name(turn - 1)).alias("call_id"), F.when(user, "ask").alias("name"), F.when(user, arguments).alias("arguments"), F.when(user, after).alias("after"),
    )


def op10_chat(spark, sf_dir: str) -> DataFrame:
    return link(traffic_of(read_table(spark, sf_dir, "conversations")), [ASK])


OP10_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, role = 'user' AS is_call, role = 'assistant' AS is_result, length(text) AS n,
         CASE WHEN role = 'user' THEN 't' || CAST(turn AS VARCHAR) WHEN role = 'assistant' THEN 't' || CAST(turn - 1 AS VARCHAR) END AS id
  FROM conversations),
asked AS (SELECT *, CASE WHEN n % 3 = 0 THEN turn + 2 WHEN turn >= 2 THEN turn - 2 END AS dep FROM m WHERE is_call),
calls AS (SELECT a.*, a.dep IS NOT NULL AND p.turn IS NULL AS lacks, p.turn AS known FROM asked a LEFT JOIN asked p ON p.conv_id = a.conv_id AND p.turn = a.dep),
late AS (SELECT DISTINCT conv_id FROM calls WHERE known > turn),
follow(conv_id, turn, spot, level) AS (
  SELECT conv_id, turn, turn, 0 FROM calls WHERE conv_id IN (SELECT conv_id FROM late)
  UNION ALL
  SELECT f.conv_id, f.turn, c.known, f.level + 1 FROM follow f JOIN calls c ON c.conv_id = f.conv_id AND c.turn = f.spot
  WHERE c.known IS NOT NULL AND f.level <= (SELECT count(*) FROM calls x WHERE x.conv_id = f.conv_id)),
depth AS (SELECT f.conv_id, f.turn, min(CASE WHEN c.known IS NULL THEN f.level END) AS level FROM follow f JOIN calls c ON c.conv_id = f.conv_id AND c.turn = f.spot GROUP BY f.conv_id, f.turn),
results AS (SELECT * FROM m WHERE is_result),
joined AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.id, r.id) AS call_id, coalesce(c.turn, r.turn) AS turn, CASE WHEN c.id IS NOT NULL THEN r.turn END AS result_turn,
         c.id IS NOT NULL AS is_call, c.text AS query, c.n, c.dep, r.text AS result, CASE WHEN c.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
         coalesce(c.lacks, FALSE) AS lacks, d.turn IS NOT NULL AS leveled, d.level
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.id = r.id LEFT JOIN depth d ON d.conv_id = c.conv_id AND d.turn = c.turn),
every AS (
  SELECT conv_id, call_id, status, turn, result_turn, is_call, CASE WHEN leveled THEN level ELSE 0 END AS level,
    CASE WHEN is_call THEN concat_ws('; ',
      CASE WHEN n % 11 = 4 THEN 'arguments: not JSON' END,
      CASE WHEN n % 11 = 4 THEN NULL WHEN n % 11 = 2 THEN 'length: not integer' WHEN n > 2000 THEN 'length: over 2000' WHEN n < 1 THEN 'length: under 1' END,
      CASE WHEN n % 11 = 3 THEN 'note: unknown' END,
      CASE WHEN n % 11 = 4 THEN NULL WHEN n % 11 = 1 THEN 'query: missing' WHEN n > 400 THEN 'query: longer than 400' END,
      CASE WHEN lacks THEN 'after: unknown t' || CAST(dep AS VARCHAR) END,
      CASE WHEN leveled AND level IS NULL THEN 'after: cycle' END) END AS errors,
    '{' || concat_ws(',',
      CASE WHEN is_call AND n % 11 <> 4 THEN '"arguments":{' || concat_ws(',', '"length":' || CASE WHEN n % 11 = 2 THEN '"' || CAST(n AS VARCHAR) || '"' ELSE CAST(n AS VARCHAR) END,
        CASE WHEN n % 11 = 3 THEN '"note":1' END, CASE WHEN n % 11 <> 1 THEN '"query":' || CAST(to_json(query) AS VARCHAR) END) || '}' END,
      '"id":' || CAST(to_json(call_id) AS VARCHAR), CASE WHEN is_call THEN '"name":"ask"' END, '"result":' || CAST(to_json(result) AS VARCHAR),
      '"status":"' || status || '"', '"turn":' || CAST(turn AS VARCHAR)) || '}' AS line
  FROM joined
  UNION ALL
  SELECT conv_id, NULL, 'message', turn, NULL, FALSE, 0, NULL,
    '{' || concat_ws(',', '"content":' || CAST(to_json(text) AS VARCHAR), '"status":"message"', '"turn":' || CAST(turn AS VARCHAR)) || '}'
  FROM m WHERE NOT is_call AND NOT is_result)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, CASE WHEN is_call THEN 0 ELSE 1 END, call_id NULLS LAST, line) AS INT) AS position,
  call_id, status, turn, result_turn, CASE WHEN is_call THEN errors = '' END AS valid, errors, line
FROM every
"""
