import json

from lodestar.operators import bundle, scoring
from lodestar.sources import register


def test_facts_and_report(spark):
    firms = bundle.positions(spark.createDataFrame([("f:b", "b", 2), ("f:a", "A", 2), ("f:c", "c", 9)], "id string, name string, cases long"))
    assert {r.id: r.ix for r in firms.collect()} == {"f:c": 0, "f:a": 1, "f:b": 2}
    cases = bundle.case_positions(spark.createDataFrame([("337-10",), ("337-9",), ("337-10",)], "number string"))
    assert {r.number: r.ix for r in cases.collect()} == {"337-9": 0, "337-10": 1}
    reps = spark.createDataFrame([("337-9", "f:a", ["x", "?"], "C"), ("337-10", "f:?", [], "R"), ("gone", "f:a", ["x"], "C")], "case string, firm string, companies array<string>, side string")
    companies = spark.createDataFrame([("x", 4)], "id string, ix long")
    assert {(r.case_ix, r.firm_ix, tuple(r.companies)) for r in bundle.facts(reps, firms, companies, cases).collect()} == {(0, 1, (4,)), (1, -1, ())}
    merges = bundle.merges_by_rule(spark.createDataFrame([(f"a{i}", "b", "typo", "") for i in range(12)] + [("x", "y", "alias", "")], "a string, b string, rule string, detail string"))
    assert {r.rule: (r.merges, len(r.samples)) for r in merges.collect()} == {"typo": (12, 8), "alias": (1, 1)}
    text = bundle.markdown(spark.createDataFrame([("firms", 5, 3)], "kind string, names int, entities int"), merges, "2026-01-01")
    assert "| firms | 5 | 3 |" in text and text.index("## typo: 12") < text.index("## alias: 1")


def test_scoring(spark):
    def score(prompts):
        if len(prompts) > 2:
            raise scoring.Overflow
        return [p.upper() for p in prompts]

    assert scoring.halving(score, list("abcde")) == list("ABCDE")
    q = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "id int, prompt string")
    cache = spark.createDataFrame([(3, "cached")], "id int, answer string")
    got = {r.id: r.answer for r in scoring.answers(q, cache, score, 4).collect()}
    assert got == {i: f"P{i}" for i in range(7)} | {3: "cached"}
    assert {r.answer for r in scoring.answers(q, cache).collect()} == {"cached", None}
    b = scoring.Budget(1.0)
    assert b.admit(0.6) and not b.admit(1.1)
    b.charge(0.6)
    assert not b.admit(0.5)
    calls = spark.createDataFrame([("c", 1, 0.4), ("c", 2, 0.4), ("c", 3, 0.4)], "k string, n int, w double")
    assert [r.admitted for r in scoring.admitted(calls, 1.0, "k", "n", "w").orderBy("n").collect()] == [True, True, False]
    assert [r.chunk for r in scoring.chunks(calls, "k", "n", 2).orderBy("n").collect()] == [0, 0, 1]
    ev = spark.createDataFrame([("d", "s1", "needs_review", 1), ("d", "s2", "ok", 2), ("d", "s3", "needs_review", 3)], "doc_id string, sentence string, status string, n int")
    again = spark.createDataFrame([("d", "s1", "ok", 9), ("d", "s2", "ok", 8)], ev.schema)
    assert sorted(r.n for r in scoring.second_pass(ev, again).collect()) == [2, 3, 9]
    tries = []
    assert scoring.retry(lambda: tries.append(1) or (_ for _ in ()).throw(OSError) if len(tries) < 1 else 5, (1,), lambda s: None) == 5


def test_register(spark):
    get = lambda n: json.dumps({"results": [{"document_number": 5, "title": "T", "publication_date": "2026-01-01", "raw_text_url": "u"}, {}]})
    assert register.search(get, "1478") == [{"id": "5", "title": "T", "date": "2026-01-01", "url": "u"}]
    notices = spark.createDataFrame([("5", "u"), ("6", "v")], "id string, url string")
    cache = spark.createDataFrame([("6", "have")], "id string, text string")
    got = register.texts(notices, cache, lambda u: "<p>A &amp; B</p>")
    assert {r.id: r.text.strip() for r in got.collect()} == {"5": "A & B", "6": "have"}
    assert register.institutes("Inv. No. 337-TA-1478", "Certain Wearable Devices; Notice of Institution", "337-1478", "Certain Wearable Devices and Components Thereof")
    assert not register.institutes("337-TA-1479", "Certain Wearable Devices", "337-1478", "Certain Wearable Devices") and not register.institutes("337-TA-1478", "Certain Pumps", "337-1478", "Certain Wearable Devices")
