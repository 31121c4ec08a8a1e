import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.operators import docket, matrix
from lodestar.operators.calendar import business_days

D = dt.date.fromisoformat
ONE, TWO = "8,350,294", "9,748,347"
EVENT = "case_id string, id string, ord int, action string, stage string, speaker string, patent string, claims array<int>, respondents array<string>, status string, date string, effective_date string, sentence string, case_wide boolean"


def event(i, eid, action, stage, patent, claims, date, respondents=("ALL",), status="ok", sentence=None, wide=False, speaker=None):
    return ("c", eid, i, action, stage, speaker or ("party_argument" if action == "asserted" else "tribunal_ruling"), patent, claims, list(respondents), status, date, None, sentence, wide)


BASE = [
    ("a", "asserted", "asserted", ONE, [1, 2, 3], "2023-05-26"), ("b", "instituted", "instituted", ONE, [1, 2, 3], "2023-06-27"), ("c", "instituted", "instituted", TWO, [1, 2, 3], "2023-06-27"),
    ("d", "withdrawn", "hearing", TWO, [1, 2, 3], "2023-12-01"), ("e", "found_infringed", "final_id", ONE, [2, 3], "2024-07-09"), ("f", "found_not_infringed", "final_id", ONE, [1], "2024-07-09"),
    ("g", "not_reviewed", "commission", ONE, [1, 2, 3], "2024-09-10"), ("h", "found_infringed", "final_id", TWO, [1], "2024-07-09"),
]


def built(spark, extra=(), base=BASE):
    events = spark.createDataFrame([event(i, *e) for i, e in enumerate(base)] + [event(100 + i, *e[0], **e[1]) for i, e in enumerate(extra)], EVENT)
    who = spark.createDataFrame([("c", ["Inn, Inc", "Inn America"])], "case_id string, respondents array<string>")
    cells = matrix.matrix(events, who).cache()
    return events, cells


def total(cells, view="ALL"):
    r = matrix.counts(cells).filter("patent IS NULL").filter(f"view = '{view}'").first()
    return tuple(r[s] for s in matrix.STAGES)


def test_claims_narrow(spark):
    events, cells = built(spark)
    assert total(cells) == (3, 6, 3, 2, 2, 0)
    got = {(r.patent, r.claim): r for r in matrix.wide(cells).filter("view = 'ALL'").collect()}
    assert got[ONE, 1].final_id == "not_infringed" and got[ONE, 2].commission == "violation" and got[TWO, 1].final_id is None and got[TWO, 1].hearing == "withdrawn"
    notes = {(r.id, r.note) for r in matrix.contradictions(events).collect()}
    assert ("h", "after the claim left the case") in notes
    assert [(r.a, r.b, r.agree) for r in matrix.corroborate(events).collect()] == []


def test_settlement_with_one_respondent(spark):
    _, cells = built(spark, [(("s", "terminated_settlement", "hearing", ONE, [1, 2, 3], "2024-01-15"), {"respondents": ["Inn America"]})])
    assert total(cells, "Inn, Inc")[3] == 2 and total(cells, "Inn America")[3] == 0
    got = {(r.view, r.claim): r for r in matrix.wide(cells).filter(f"patent = '{ONE}'").collect()}
    assert got["Inn America", 1].hearing == "settled" and got["ALL", 2].hearing == got["ALL", 2].final_id == "by_respondent"


def test_unreviewed_terminations_additions_and_case_wide(spark):
    _, cells = built(spark, [(("n", "not_reviewed", "commission", "p", [1, 2], "2024-03-12"), {"sentence": "Claims 1-2 are terminated."}), (("q", "added", "instituted", "p", [2], "2024-04-01"), {})], [("i", "instituted", "instituted", "p", [1, 2], "2023-06-27")])
    got = {r.claim: r for r in matrix.wide(cells).filter("view = 'ALL'").collect()}
    assert got[1].hearing == "withdrawn" and got[2].instituted == "instituted"
    _, cells = built(spark, [(("w", "no_violation", "commission", None, [], "2024-12-01"), {"wide": True})], BASE[:6])
    assert {r.commission for r in matrix.wide(cells).filter(f"view = 'ALL' AND patent = '{ONE}'").collect()} == {"no_violation"}


DOC = "case_id string, id string, document_type string, title string, day date, public boolean"
ORDER, NOTICE, ID, FINAL = "Order", "Notice", "ID/RD - Other Than Final on Violation", "ID/RD - Final on Violation"


def docs(spark, rows):
    return spark.createDataFrame([("c", f"{i:02}", k, t, D(d), p) for i, (k, t, d, p) in enumerate(rows)], DOC)


@pytest.mark.parametrize("kind, title, want", [
    (NOTICE, "Notice of Institution of Investigation", "institution"), (NOTICE, "F. R. Notice of Institution", None), (NOTICE, "Notice of Issuance of Initial Determination on Violation", "final_id"), (NOTICE, "Errata to Initial Determination on Violation", None),
    (NOTICE, "Extending the Target Date", None), (ID, "Granting Summary Determination and Staying", "summary_determination"), (ID, "Terminating the Investigation", "termination"), (ID, "Finding Acme in Default", "default"), (ID, "Remand Initial Determination", "remand_id"),
    (FINAL, "Initial Determination", "final_id"), (FINAL, "Recommended Determination", None), (NOTICE, "Determination Not to Review an ID Terminating", "not_reviewed"), (NOTICE, "Determination Not to Review Order 5", None), (NOTICE, "Determination to Review a Final Initial Determination", "review"),
    (NOTICE, "Final Determination of No Violation", "determination"), ("Order, Commission", "Limited Exclusion Order", "order"), ("Order, Commission", "Protective Order", None), ("Opinion, Commission", "Opinion", "opinion"), (ORDER, "Terminating", None),
])
def test_kinds(spark, kind, title, want):
    df = spark.createDataFrame([(title, kind)], "t string, k string")
    assert df.select(docket.kind_of(F.col("t"), F.col("k"))).first()[0] == want


def test_versions(spark):
    got = docket.versions(docs(spark, [
        (NOTICE, "Notice of Institution of Investigation", "2025-11-24", True), (ID, "Initial Determination Terminating the Investigation", "2026-07-22", False), (ID, "Initial Determination Terminating the Investigation (Public Version)", "2026-08-06", True),
        (NOTICE, "Determination Not to Review an ID Terminating", "2026-08-21", True), (NOTICE, "Motion for extension of time to stay", "2026-08-22", True), (ID, "Initial Determination Terminating the Investigation", "2027-07-22", True),
        (ID, "Initial Determination Terminatng the Investigation", "2027-08-01", False), (NOTICE, "Notice of Initial Determination on Violation", "2028-01-01", True), (FINAL, "Final ID", "2028-02-01", False), (FINAL, "Another name", "2028-04-01", True), (FINAL, "Far later", "2028-05-01", True),
    ])).orderBy("day").collect()
    assert [(r.day.isoformat(), r.kind, r.versions, r.first_id, r.link) for r in got] == [
        ("2025-11-24", "institution", 1, "00", "00"), ("2026-07-22", "termination", 2, "01", "02"), ("2026-08-21", "not_reviewed", 1, "03", "03"), ("2027-07-22", "termination", 2, "05", "05"), ("2028-01-01", "final_id", 3, "07", "09"), ("2028-05-01", "final_id", 1, "10", "10"),
    ]


def test_runs_are_anchored_at_their_first_day(spark):
    days = [D("2026-01-01") + dt.timedelta(i) for i in (0, 30, 60, 61, 90, 200)]
    got = docket.anchored(spark.createDataFrame([("g", d) for d in days], "g string, day date"), ["g"], F.lit(60)).orderBy("day").collect()
    assert [(r.day - r.first_day).days for r in got] == [0, 30, 60, 0, 29, 0]


def test_stays(spark):
    d = docs(spark, [(ORDER, "Order Staying the Procedural Schedule", "2026-08-25", True), (ORDER, "Order Extending Stay until September 30, 2026", "2026-09-10", True)])
    now, later = (docket.whole_stays(d, t).first() for t in ("2026-09-25", "2026-10-05"))
    assert (now.since, now.until, now.extended, now.active) == (D("2026-08-25"), D("2026-09-30"), True, True)
    assert not later.active and later.ended == "ran to 2026-09-30"
    days = docket.whole_stays(docs(spark, [(ORDER, "Order Staying the Case for Fourteen Days", "2026-09-20", True)]), "2026-09-25").first()
    assert days.until == D("2026-10-04")
    lifted = docket.whole_stays(docs(spark, [(ORDER, "Staying", "2026-01-01", True), (ORDER, "Order lifting the stay", "2026-02-01", True), (ORDER, "Staying again", "2026-03-01", True)]), "2026-04-01").first()
    assert (lifted.since, lifted.active) == (D("2026-03-01"), True)
    again = docket.whole_stays(docs(spark, [(ORDER, "Staying the case", "2026-01-01", True), (ORDER, "Setting the Procedural Schedule", "2026-02-01", True), (ORDER, "Denying motion to stay", "2026-03-01", True), ("Motion", "Stay", "2026-04-01", True)]), "2026-04-01").first()
    assert (again.active, again.ended) == (False, "a later order set the schedule again")
    some = docs(spark, [(ORDER, "Stay as to HP until January 1, 2026", "2025-06-01", True), (ORDER, "Stay as to HP", "2025-09-03", True), (ORDER, "Stay with respect to the Northwind respondents", "2026-09-24", True)])
    part = docket.partial_stays(some, "2026-09-25").orderBy("since").collect()
    assert [(r.who, r.since) for r in part] == [("HP", D("2025-09-03")), ("the Northwind respondents", D("2026-09-24"))]
    gone = spark.createDataFrame([("c", "HP Inc")], "case_id string, who string")
    assert [r.who for r in docket.partial_stays(some, "2026-09-25", gone).collect()] == ["the Northwind respondents"]


def test_final_exits(spark):
    got = docket.final_exits(docs(spark, [
        (ID, "Terminating the Investigation as to Unicorn based on settlement", "2026-01-01", True), (NOTICE, "Determination Not to Review an ID Terminating the Investigation as to Certain Respondents", "2026-02-01", True), (ID, "Terminating the Investigation as to Linkway; Order", "2026-03-01", True),
        (ID, "Terminating the Investigation as to Claims 1-3", "2026-03-02", True), (ID, "Finding respondent Harbor Ltd in Default", "2026-03-03", True), (ID, "Denying motion terminating the investigation as to Nobody", "2026-03-04", True),
    ]))
    assert {(r.who, r.how, r.final) for r in got.collect()} == {("Unicorn", "terminated", True), ("Linkway", "terminated", False), ("Harbor Ltd", "in default", False)}
    events = spark.createDataFrame([("c", "Deposition of Unicorn witness", "order"), ("c", "Unicorn hearing", "case data"), ("c", "Opening brief", "order")], "case_id string, label string, basis string")
    assert {r.label for r in docket.without_exited(events, got).collect()} == {"Unicorn hearing", "Opening brief"}


def test_schedules(spark):
    d = docs(spark, [(ORDER, "Setting the Procedural Schedule", "2026-01-01", True), (ORDER, "Extending the Target Date", "2026-01-05", True), (ORDER, "Amended Procedural Schedule", "2026-03-01", True), (ORDER, "Target date moved", "2026-04-01", True), (ORDER, "Seeking joint proposed procedural schedule", "2026-05-01", True), (ORDER, "Ground Rules", "2026-06-01", False)])
    assert [r.id for r in docket.schedule_documents(d).orderBy("day").collect()] == ["02", "03"]
    since = spark.createDataFrame([("c", D("2026-03-15"))], "case_id string, since date")
    assert [r.id for r in docket.schedule_documents(d, since).collect()] == ["03"]
    have = spark.createDataFrame([("c", "Target date (final)", D("2027-01-01")), ("c", "Evidentiary hearing", D("2026-09-01"))], "case_id string, label string, date date")
    plan = spark.createDataFrame([("c", "Target date", "target_date", D("2027-02-01")), ("c", "Evidentiary hearing begins", "hearing", D("2026-09-02")), ("c", "Pre-hearing brief before the evidentiary hearing", "hearing", D("2026-08-01")), ("c", "Opening", "briefs", D("2026-07-01"))], "case_id string, event string, category string, date date")
    assert {(r.label, r.basis) for r in docket.with_schedule(have, plan).collect()} == {("Target date (final)", "case data"), ("Evidentiary hearing", "case data"), ("Pre-hearing brief before the evidentiary hearing", "order"), ("Opening", "order")}


def test_overlay_and_upcoming(spark):
    ev = lambda e, d, c="discovery", end=None: (e, D(d), end and D(end), c)
    rows = [("c", "1", D("2026-01-01"), [ev("Exchange of initial witness lists", "2026-03-13"), ev("Rebuttal witness lists", "2026-03-20"), ev("Fact discovery cutoff", "2026-04-01"), ev("Hearing", "2026-06-01", "hearing")]),
            ("c", "2", D("2026-02-01"), [ev("initial witness lists", "2026-03-27"), ev("Evidentiary hearing", "2026-06-24", "hearing", "2026-06-30"), ev("Fact discovery cutoff and completion", "2026-04-09")])]
    got = {r.event: r for r in docket.overlay(spark.createDataFrame(rows, "case_id string, doc_id string, day date, events array<struct<event:string,date:date,end_date:date,category:string>>")).collect()}
    assert len(got) == 4 and got["initial witness lists"].replaces == D("2026-03-13") and got["Rebuttal witness lists"].doc_id == "1"
    assert (got["Evidentiary hearing"].date, got["Evidentiary hearing"].end_date) == (D("2026-06-24"), D("2026-06-30"))
    events = spark.createDataFrame([("c", "x", D("2026-01-05")), ("c", "y", D("2026-01-03")), ("c", "z", D("2026-09-03"))], "case_id string, label string, date date")
    assert [(r.label, r.turn, r.days_left) for r in docket.upcoming(events, "2026-01-01").orderBy("turn").collect()] == [("y", 1, 2), ("x", 2, 4)]


def test_stage_of(spark):
    schema = "case_id string, open boolean, withdrawn boolean, status string, phase string, received date, start date, target date, final_id date, reviewed date, not_reviewed date, extended boolean, determination string, determined date, latest date"
    base = dict.fromkeys(["received", "start", "target", "final_id", "reviewed", "not_reviewed", "determination", "determined", "latest"]) | {"open": True, "withdrawn": False, "status": "Active", "phase": "Violation", "extended": False}
    cases = {"closed": {"open": False}, "pre": {"status": "Pre-institution", "received": D("2026-09-01")}, "other": {"phase": "Remand"}, "undated": {}, "alj": {"start": D("2026-01-01")}, "comm": {"final_id": D("2026-09-01")},
             "pres": {"final_id": D("2026-01-02"), "determined": D("2026-05-01"), "determination": "Limited Exclusion Order"}, "done": {"final_id": D("2026-01-02"), "determined": D("2026-05-01"), "determination": "No violation"}, "quiet": {"start": D("2020-01-01"), "latest": D("2020-02-01")}}
    df = spark.createDataFrame([{**base, **v, "case_id": k} for k, v in cases.items()], schema)
    got = {r.case_id: r for r in docket.stage_of(df, business_days(spark, 2025, 2027), "2026-09-25").collect()}
    assert {k: r.stage for k, r in got.items()} == {"closed": None, "pre": "pre_institution", "other": "other", "undated": "undated", "alj": "alj", "comm": "commission", "pres": "presidential", "done": "concluded", "quiet": "dormant"}
    assert got["comm"].petitions_due == D("2026-09-14") and got["pre"].due is not None and got["comm"].responses_due > got["comm"].petitions_due
