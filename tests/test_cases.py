import pytest
from pyspark.sql import functions as F

from lodestar.operators import cases, fields
from lodestar.operators.flatten import flatten, slug
from tests.support import feed, feed_row


def test_slug(spark):
    of = lambda *x: [r[0] for r in spark.createDataFrame([(v,) for v in x], "v string").select(slug(F.col("v"))).collect()]
    assert of("Q.R. Number for Notice", "Is Active?", "Date of Notice (ABC)") == ["qr_number_for_notice", "is_active", "date_of_notice_abc"]
    assert of("finalRulingKind") == of("Final Ruling Kind")


def test_flatten(spark):
    more = {"Some New Field": " surprise ", "Odd": [{"Title": "t", "ID": 3, "Where": {"Name": "here", "Zone": 4}}, None, "x", {}], "A Dict": {"alpha": 1, "Alpha Two": "z", "Deep": {"n": 1}}, "When Date": "soon", "Blank": " ", "Requestor": ["Ann", {"Name": "Bo"}, "ann"]}
    r = flatten(feed(spark, [feed_row(complainants=("Tidewater Optics Inc.", "tidewater optics inc. "), **more)])).first()
    f, lists = r.fields, r.lists
    assert (f["investigation_status"], f["phase_number"], f["final_ruling_kind"], f["final_ruling_kind_is_active"]) == ("Open", "2", "Dismissal", "false")
    assert (f["start_date"], f["date_of_publication_of_notice"], f["comments_due_date"], f["when_date"]) == ("2031-03-02", "2031-03-09", "N/A", "soon")
    assert (f["case_manager"], f["case_manager_title"], f["case_manager_email"], f["some_new_field"], f["a_dict_alpha"], f["a_dict_alpha_two"]) == ("Outi Kallio", "Clerk", "outi@example.org", "surprise", "1", "z")
    assert not {"investigation_end_date", "blank", "final_ruling_kind_final_ruling_kind_id", "investigation_status_id", "a_dict_deep", "odd"} & set(f)
    assert [(p["name"], p["role"], p["is_petitioner"], p["country"]) for p in lists["participants"]] == [("Tidewater Optics Inc.", "Complainant", "true", "Norway"), ("Bramble Motors Corp.", "Respondent", "false", "Norway")]
    assert lists["staff"][0]["label"] == "Per Quist" and lists["intellectual_property"][0] == {"label": "Patent 7,001,002", "number": "7,001,002", "type": "Patent", "expiration_date": "2035-11-30"}
    assert [x["label"] for x in lists["odd"]] == ["t", "x"] and lists["odd"][0]["where"] == "here" and lists["odd"][0]["where_zone"] == "4"
    assert [x["name"] for x in lists["requestor"]] == ["Ann", "Bo"] and lists["investigation_categories"][0]["name"] == "Imports"


def test_flatten_edges(spark):
    rows = [feed_row(" "), "[1]", "{broken", "", "null", '{"Investigation Number": 7}', '{"Investigation Number": "8", "Same Name": 1, "same name": 2, "sameName": {"Name": 3, "More": 4}}', None]
    df = spark.createDataFrame([(x if x is None or isinstance(x, str) else __import__("json").dumps(x),) for x in rows], "row string")
    got = {r.number: r for r in flatten(df).collect()}
    assert set(got) == {"7", "8"} and got["8"].fields["same_name"] == "3" and got["8"].fields["same_name_more"] == "4" and got["7"].lists == {}
    assert flatten(df.limit(0)).count() == 0


def three(spark):
    return cases.fold(flatten(feed(spark, [
        feed_row(investigation_id=1, end_date="10-05-2032", status="Closed"), feed_row(phase="Remand", investigation_id=2, start_date="01-11-2034", status="On review", docket=None),
        feed_row(phase="Bond", investigation_id=3, start_date="06-30-2032", status="Closed", docket=None), feed_row(number=" "), "[1]", "{broken",
        feed_row("337-9004", status="Received", start_date=None, docket="9004", **{"official_investigation_number": "337-5001", "Topic": None}),
    ])), "2031-05-05")


def test_fold(spark):
    got = {r.number: r for r in three(spark).collect()}
    assert set(got) == {"337-5120", "337-9004"}
    case = got["337-5120"]
    assert case.stage_count == 3 and case.phases == ["Violation", "Bond", "Remand"]
    assert (case.primary_stage, case.current_stage, case.status, case.phase, case.docket_number, case.date_initiated) == ("1", "2", "On review", "Remand", "4410", "2031-03-02")
    other = got["337-9004"]
    assert (other.title, other.official_number, other.date_initiated) == ("Certain Folding Bicycles", "337-5001", "2031-01-20")


def test_diff_guard_carry_and_migrate(spark):
    old = cases.fold(flatten(feed(spark, [feed_row("337-1"), feed_row("337-2"), feed_row("337-3")])), "a")
    new = cases.fold(flatten(feed(spark, [feed_row("337-1"), feed_row("337-2", status="Terminated"), feed_row("337-9", docket="3")])), "b")
    assert {(r.number, r.change) for r in cases.diff(old, new).collect()} == {("337-2", "status"), ("337-3", "removed"), ("337-9", "added")}
    kept = {r.number: r.withdrawn for r in cases.carry_withdrawn(old, new).collect()}
    assert kept == {"337-1": False, "337-2": False, "337-9": False, "337-3": True}
    assert cases.check_removals(old, new) == (1, 3)
    many = cases.fold(flatten(feed(spark, [feed_row(f"337-{i}") for i in range(40)])))
    with pytest.raises(cases.SuspectSnapshot):
        cases.check_removals(many, new)
    assert cases.check_removals(many, new, allow=True)[0] > 10
    docs = spark.createDataFrame([("337-3", "d1"), ("337-1", "d2")], "key string, id string")
    assert {(r.key, r.id) for r in cases.migrate_dockets(docs, old, new).collect()} == {("337-9", "d1"), ("337-1", "d2")}
    parties = {(r.name, r.role) for r in cases.participants(new.filter("number = '337-1'")).collect()}
    assert parties == {("Tidewater Optics Inc.", "Complainant"), ("Bramble Motors Corp.", "Respondent")}


def test_field_specs(spark):
    df = three(spark)
    specs = [fields.Field.from_dict(x) for x in ({"source": "title"}, {"source": "phases"}, {"source": "target_date"}, {"source": "participants", "where": {"role": "complainant"}, "limit": 1}, {"source": "participants", "item": "role", "stage": "all"}, {"source": "investigation_status", "stage": "current"})]
    row = fields.project(df, specs).filter("number = '337-5120'").first()
    assert row[1:] == ("Certain Folding Bicycles", "Violation, Bond, Remand", "2032-07-14", "Tidewater Optics Inc.", "Complainant, Respondent", "On review")
    assert fields.unresolved(df, [*specs, fields.Field("nothing")]) == ["nothing"]
    share = {r.source: r.share for r in fields.sources(df).collect()}
    assert share["target_date"] == 1.0 and share["investigation_end_date"] == 0.5
    for bad in ({}, {"source": "x", "type": "no"}, {"source": "x", "limit": 0}, {"source": "x", "extra": 1}):
        with pytest.raises(ValueError):
            fields.Field.from_dict(bad)
