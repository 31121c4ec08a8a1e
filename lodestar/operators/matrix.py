"""Claims x stages: what became of each claim, for everyone and for each respondent.

A table of transitions says what an event does to a claim: under what condition it writes which status to which
stage's cell, and whether the claim leaves the case. Events meet the table in a join, claims are exploded first, and
each claim of each view folds its own transitions in the order they took effect, as one aggregate expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.exprs import let

#: The stages, what each counts as remaining, how exits are called, and how outcomes rank.
STAGES = ("asserted", "instituted", "hearing", "final_id", "commission", "appeal")
COUNTED = dict(zip(STAGES, ("asserted", "instituted", "in_case", "infringed", "violation", "on_appeal")))
LEAVES = {"withdrawn": "withdrawn", "terminated_settlement": "settled"}
EXITS = LEAVES | {"found_invalid": "invalid", "found_not_infringed": "not_infringed"}
RANK = {"invalid": 3, "not_infringed": 2, "no_violation": 2, "infringed": 1, "violation": 1}
MOVES = ("asserted", "instituted", "added", "found_infringed", "not_reviewed", "violation", "no_violation", "default", *EXITS)
RULED = ("hearing", "final_id", "commission")

#: Conditions on a claim's cells: no final ID, one, the hearing ended in default, the Commission has yet to say (whatever
#: the final ID found, or on a finding of infringement).
ANY, UNDECIDED, DECIDED, DEFAULTED, OPEN, OPEN_FOUND = range(6)
#: How a status is written: always, into an empty cell, if it does not rank lower, or always and the claim is back.
PUT, FIRST, RANKED, BACK = range(4)
ADOPTED = "adopted"  # the final ID's own outcome


def transitions() -> list[tuple]:
    """(case-wide, action, stage or * for any, in order, condition, only if the event ends something, target stage or *
    for the event's own, status, how, leaves)."""
    own = [
        ("asserted", "asserted", ANY, False, "asserted", "asserted", PUT, False),
        ("instituted", "*", ANY, False, "instituted", "instituted", FIRST, False),
        ("added", "*", ANY, False, "instituted", "instituted", BACK, False),
        ("not_reviewed", "*", UNDECIDED, True, "hearing", "withdrawn", PUT, True),
        ("not_reviewed", "commission", DECIDED, False, "commission", ADOPTED, RANKED, False),
        ("found_infringed", "final_id", ANY, False, "final_id", "infringed", RANKED, False),
        ("found_infringed", "commission", ANY, False, "commission", "violation", RANKED, False),
    ]
    own += [(action, stage, ANY, False, stage, EXITS[action], RANKED, False) for action in ("found_not_infringed", "found_invalid") for stage in ("final_id", "commission")]
    own += [(action, "hearing", ANY, False, "hearing", status, PUT, True) for action, status in EXITS.items()]
    own += [(action, stage, ANY, False, stage, status, PUT, True) for action, status in LEAVES.items() for stage in ("final_id", "commission")]
    wide = [(action, "*", ANY, False, "*", status, PUT, True) for action, status in LEAVES.items()]
    wide += [
        ("default", "*", ANY, False, "hearing", "default", FIRST, False),
        ("violation", "*", DEFAULTED, False, "commission", "violation", FIRST, False),
        ("violation", "*", OPEN_FOUND, False, "commission", "violation", PUT, False),
        ("no_violation", "*", OPEN, False, "commission", "no_violation", PUT, False),
    ]
    return [(scope, *row[:2], i, *row[2:]) for scope, rows in ((False, own), (True, wide)) for i, row in enumerate(rows)]


def _with_transitions(spark: SparkSession, events: DataFrame) -> DataFrame:
    """events with `moves`: the transitions of each, in their order, with stages as places."""
    place = {s: i for i, s in enumerate(STAGES)}
    rows = []
    for scope, action, stage, n, when, ends, target, status, how, leaves in transitions():
        for s in [*STAGES, ""] if stage == "*" else [stage]:
            if action == "not_reviewed" and s == "final_id":
                continue
            to = (s or "hearing") if target == "*" else target
            rows.append((scope, action, s, n, when, ends, place[to], status, how, leaves))
    table = spark.createDataFrame(rows, "case_wide boolean, action string, at_stage string, n int, needs int, ends boolean, target int, to string, how int, leaves boolean")
    moves = table.groupBy("case_wide", "action", "at_stage").agg(F.array_sort(F.collect_list(F.struct("n", "needs", "ends", "target", "to", "how", "leaves"))).alias("moves"))
    keyed = events.withColumn("at_stage", F.coalesce("stage", F.lit("")))
    return keyed.join(F.broadcast(moves), ["case_wide", "action", "at_stage"], "left").drop("at_stage")  # a table of under 100 rows


CELL = "struct<status:string,event:string>"


def _rank(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), status), F.lit(0))


def _state(cells, left, split, review, seen) -> Column:
    return F.struct(cells.alias("cells"), left.alias("left"), split.alias("split"), review.alias("review"), seen.alias("seen"))


def _at(cells: Column, stage: str) -> Column:
    return F.get(cells, STAGES.index(stage))["status"]


def _written(cells: Column, target: Column, status: Column, event: Column) -> Column:
    return F.transform(cells, lambda c, i: F.when(i == target, F.struct(status.alias("status"), event.alias("event"))).otherwise(c))


def _move(acc: Column, m: Column, e: Column) -> Column:
    """The state after one transition of an event."""
    final, commission, hearing = (_at(acc["cells"], s) for s in ("final_id", "commission", "hearing"))
    unsaid = final.isNotNull() & commission.isNull()
    defaulted = F.coalesce(hearing == "default", F.lit(False))
    holds = (
        F.when(m["needs"] == UNDECIDED, final.isNull()).when(m["needs"] == DECIDED, final.isNotNull()).when(m["needs"] == DEFAULTED, defaulted)
        .when(m["needs"] == OPEN, unsaid).when(m["needs"] == OPEN_FOUND, unsaid & (final == "infringed") & ~defaulted).otherwise(True)
    )
    free = (~acc["left"] | e["action"].isin("asserted", "instituted", "added")) & holds & (~m["ends"] | e["ends"])
    status = F.when(m["to"] == ADOPTED, F.when(final == "infringed", "violation").otherwise(final)).otherwise(m["to"])
    there = F.get(acc["cells"], m["target"])["status"]
    put = free & F.when(m["how"] == FIRST, there.isNull()).when(m["how"] == RANKED, there.isNull() | (_rank(status) >= _rank(there))).otherwise(True)
    left = F.when(free & (m["how"] == BACK), False).otherwise(acc["left"] | (free & m["leaves"]))
    cells = F.when(put, _written(acc["cells"], m["target"], status, e["id"])).otherwise(acc["cells"])
    return _state(cells, left, acc["split"], acc["review"], acc["seen"])


def _step(acc: Column, e: Column) -> Column:
    """The state after one event. A claim is there from its first own event; events for some respondents only make
    the cell of the view of everyone differ by respondent."""
    there = acc["seen"] | ~e["case_wide"]
    applies = there & e["acts"] & e["mine"] & ~(acc["split"] & e["ruled"])
    differs = there & e["acts"] & ~applies & (e["view"] == "ALL") & (e["place"] >= 0) & (e["action"] != "asserted") & ~acc["left"]
    moved = F.aggregate(F.coalesce(e["moves"], F.array().cast("array<struct<n:int,needs:int,ends:boolean,target:int,to:string,how:int,leaves:boolean>>")), acc, lambda a, m: _move(a, m, e))
    marked = F.when(F.get(acc["cells"], e["place"])["status"].isNull(), _written(acc["cells"], e["place"], F.lit("by_respondent"), e["id"])).otherwise(acc["cells"])
    now = F.when(applies, moved).when(differs, _state(marked, acc["left"], acc["split"] | e["action"].isin(*LEAVES, "default"), acc["review"], acc["seen"])).otherwise(acc)
    return let(now, lambda x: _state(x["cells"], x["left"], x["split"], x["review"] | e["flagged"], there))


def matrix(events: DataFrame, respondents: DataFrame) -> DataFrame:
    """Cells of every view: case_id, view, patent, claim, stage, status, event, needs_review. events: case_id, id, ord,
    action, stage, speaker, patent, claims, respondents, status, date, effective_date, sentence, case_wide;
    respondents: case_id, respondents (array)."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")) - 1, F.lit(-1)).cast("int")
    speaks = F.when(F.col("action") == "asserted", F.coalesce(F.col("stage") == "asserted", F.lit(False))).otherwise(F.col("speaker") == "tribunal_ruling")
    waits = F.coalesce(F.col("status") == "needs_review", F.lit(False))
    told = events.select(
        "case_id", "id", "ord", "action", "stage", F.coalesce("patent", F.lit("unknown")).alias("patent"), "claims", "case_wide", place.alias("place"),
        F.coalesce("effective_date", "date", F.lit("")).alias("day"), (speaks & ~waits).alias("acts"), (speaks & waits & F.col("action").isin(*MOVES) & ~F.col("case_wide")).alias("flagged"),
        F.coalesce(F.lower("sentence").contains("terminat"), F.lit(False)).alias("ends"), F.coalesce(F.col("stage").isin(*RULED), F.lit(False)).alias("ruled"),
        F.when(F.size("respondents") > 0, F.col("respondents")).otherwise(F.array(F.lit("ALL"))).alias("who"),
    )
    told = _with_transitions(events.sparkSession, told)
    own = told.filter("NOT case_wide").withColumn("claim", F.explode("claims")).drop("claims")
    claims = own.select("case_id", "patent", "claim").distinct()
    every = own.unionByName(told.filter("case_wide").drop("claims", "patent").join(claims, "case_id").select(own.columns))
    known = respondents.select("case_id", F.col("respondents").alias("everyone"))
    seen = every.join(known, "case_id", "left").withColumn("everyone", F.coalesce("everyone", F.array().cast("array<string>")))
    views = seen.withColumn("view", F.explode(F.concat(F.array(F.lit("ALL")), "everyone")))
    all_of = (F.size("everyone") > 0) & (F.size(F.array_except("everyone", "who")) == 0)
    mine = F.array_contains("who", "ALL") | F.when(F.col("view") == "ALL", all_of).otherwise(F.array_contains(F.col("who"), F.col("view")))
    order = [F.col("day"), F.when(F.col("place") >= 0, F.col("place")).otherwise(9).alias("late"), F.col("case_wide"), F.col("ord"), F.col("id")]
    event = F.struct(*order, "action", "place", "acts", "flagged", "ends", "ruled", mine.alias("mine"), "view", "moves")
    # a claim's own events in one case, exploded by view: what a group holds is a claim's history
    told = views.groupBy("case_id", "view", "patent", "claim").agg(F.array_sort(F.collect_list(event)).alias("history"))
    none = F.lit(False)
    start = _state(F.array_repeat(F.lit(None).cast(CELL), len(STAGES)), none, none, none, none)
    folded = told.withColumn("s", F.aggregate("history", start, _step)).select("case_id", "view", "patent", "claim", F.col("s.cells").alias("cells"), F.col("s.review").alias("needs_review"))
    # a claim that a final ID decides was in the case at the hearing
    final = F.get("cells", STAGES.index("final_id"))
    filled = F.when(_at(F.col("cells"), "hearing").isNull() & final["status"].isNotNull(), _written(F.col("cells"), F.lit(STAGES.index("hearing")), F.lit("in_case"), final["event"])).otherwise(F.col("cells"))
    cells = folded.select("case_id", "view", "patent", "claim", "needs_review", F.posexplode(filled).alias("p", "c")).filter("c.status IS NOT NULL")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), F.col("p") + 1)
    return cells.select("case_id", "view", "patent", "claim", stage.alias("stage"), "c.status", "c.event", "needs_review")


def wide(cells: DataFrame) -> DataFrame:
    """One row a claim, a column a stage."""
    return cells.groupBy("case_id", "view", "patent", "claim").pivot("stage", list(STAGES)).agg(F.first("status"))


def counts(cells: DataFrame) -> DataFrame:
    """Claims that remain at each stage, by patent and in total (patent null)."""
    remaining = [F.count_if((F.col("stage") == s) & (F.col("status") == COUNTED[s])).alias(s) for s in STAGES]
    by = cells.rollup("case_id", "view", "patent").agg(*remaining, F.grouping_id().alias("g"))
    return by.filter("g <= 1").drop("g")


def contradictions(events: DataFrame) -> DataFrame:
    """id, note: rulings on claims that an earlier event took out, or that nothing instituted."""
    each = events.filter("NOT case_wide AND speaker = 'tribunal_ruling' AND status <> 'needs_review'").select("case_id", "patent", F.explode("claims").alias("claim"), "id", "ord", "action", F.coalesce("effective_date", "date").alias("d"))
    before = Window.partitionBy("case_id", "patent", "claim").orderBy("d", "ord").rowsBetween(Window.unboundedPreceding, -1)
    last_exit = F.max(F.when(F.col("action").isin(*LEAVES), F.struct("d", "ord"))).over(before)
    last_added = F.max(F.when(F.col("action") == "added", F.struct("d", "ord"))).over(before)
    started = F.max(F.col("action").isin("instituted", "added").cast("int")).over(before)
    marks = each.select("id", "action", "claim", (last_exit.isNotNull() & (last_added.isNull() | (last_added < last_exit))).alias("out"), (F.coalesce(started, F.lit(0)) == 0).alias("never"))
    notes = marks.filter(~F.col("action").isin("instituted", "added", "asserted") & (F.col("out") | F.col("never"))).withColumn("note", F.when(F.col("out"), "after the claim left the case").otherwise("claim was never instituted"))
    return notes.groupBy("id", "note").agg(F.array_sort(F.collect_set("claim")).alias("claims"))


def corroborate(events: DataFrame) -> DataFrame:
    """a, b, agree: pairs of rulings of different documents on shared claims of a patent, that say the same or not."""
    sign = F.when(F.col("action").isin("found_infringed", "violation"), 1).when(F.col("action").isin("found_not_infringed", "found_invalid", "no_violation"), -1)
    each = events.filter("NOT case_wide AND speaker = 'tribunal_ruling'").withColumn("sign", sign).filter("sign IS NOT NULL").select("case_id", "patent", F.explode("claims").alias("claim"), "id", "sign")
    a, b = each.alias("a"), each.alias("b")
    met = a.join(b, ["case_id", "patent", "claim"]).filter("a.id < b.id")
    return met.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.min((F.col("a.sign") == F.col("b.sign")).cast("int")).cast("boolean").alias("agree"), F.count(F.lit(1)).alias("claims"))
