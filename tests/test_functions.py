import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import claims, dates, names, similarity
from lodestar.operators.calendar import business_days, months_before, period_end


@pytest.mark.parametrize("raw, want", [
    ("2026/09/18 11:39:00", "2026-09-18T11:39:00"), ("01-13-2026", "2026-01-13"), ("04-05-2026", "2026-04-05"), ("13-01-2026", "2026-01-13"), ("09/18/26", "2026-09-18"),
    ("2026/02/31", "2026/02/31"), ("2026/13/13", "2026/13/13"), ("2026/08/21 16:25:00  (approx., from earliest complaint filing)", "2026-08-21T16:25:00"), ("  ", None), (None, None), ("soon", "soon"),
    ("2026-05-26T12:00:00.000+00:00", "2026-05-26T12:00:00"),
])
def test_dates(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string")
    row = df.select(dates.to_iso(F.col("v")).alias("iso"), dates.note_of(F.col("v")).alias("note"), dates.sort_key(F.col("v")).alias("k")).first()
    assert row.iso == want and row.k == (want or "")
    assert row.note == ("approx., from earliest complaint filing" if raw and "approx" in raw else None)
    again = spark.createDataFrame([(want,)], "v string").select(dates.to_iso(F.col("v"))).first()[0]
    assert again == want


def test_display_and_normalized(spark):
    df = spark.createDataFrame([("2026-09-03",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(dates.display(F.col("v"))).collect()] == ["03 Sep 2026", "Unknown", "x"]
    out, counts = dates.normalized(spark.createDataFrame([("01-02-2026", 1), ("2026-01-02", 2), ("x", 3)], "d string, n int"), "d")
    assert [r.d for r in out.orderBy("n").collect()] == ["2026-01-02", "2026-01-02", "x"] and tuple(counts.first()) == (1, 1)


def test_jwt(spark):
    import base64
    import json

    token = "h." + base64.urlsafe_b64encode(json.dumps({"exp": 1789}).encode()).decode().rstrip("=") + ".s"
    df = spark.createDataFrame([(token,), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(dates.jwt_expiry(F.col("t"))).collect()] == [1789, None, None]


def test_calendar(spark):
    cal = business_days(spark, 2025, 2028).cache()
    closed = {r.day.isoformat() for r in cal.filter(~F.col("open") & (F.weekday("day") < 5)).collect()}
    assert {"2026-07-03", "2026-06-19", "2026-11-26", "2026-01-19", "2027-12-31"} <= closed
    assert len([d for d in closed if d.startswith("2026")]) == 11
    rows = [("2026-10-02", 12, "2026-10-16"), ("2026-09-01", 12, "2026-09-14"), ("2026-09-04", 5, "2026-09-14")]
    df = spark.createDataFrame([(dt.date.fromisoformat(e), n, w) for e, n, w in rows], "e date, n int, w string")
    assert [r.w for r in df.collect()] == [r.period_end.isoformat() for r in period_end(df, cal, "e", "n").orderBy("w").select("period_end", "w").collect()] or all(r.period_end.isoformat() == r.w for r in period_end(df, cal, "e", "n").collect())
    assert all(r.period_end.isoformat() == r.w for r in period_end(df, cal, "e", "n").collect())
    day = lambda s: F.lit(s).cast("date")
    got = spark.range(1).select(months_before(day("2027-05-17"), 4), months_before(day("2027-06-30"), 4)).first()
    assert [d.isoformat() for d in got] == ["2027-01-17", "2027-02-28"]
    assert cal.filter("day = DATE'2027-01-17'").first().previous_open.isoformat() == "2027-01-15"


def of(spark, make, *values):
    """A column expression's values."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.select(make(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_folding(spark):
    assert of(spark, names.fold, "Séké & Sons", "Straße ﬁx", "Ōura’s", None) == ["seke  and  sons", "strasse fix", "oura's", ""]
    import unicodedata

    every = [chr(c) for c in [*range(0x21, 0x250), *range(0x1E00, 0x1F00)]]
    plain = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold().replace("&", " and ") for c in every]
    assert of(spark, names.fold, *every) == plain


def test_firm_keys(spark):
    variants = ["Alder, Birch, Cedar & Dunn, L.L.P.", "ALDER BIRCH CEDAR AND DUNN", "Alder Birch Cedar & Dunn LLP (DC)", "The Law Offices of Alder Birch Cedar Dunn, P.C."]
    assert set(of(spark, names.firm_key, *variants)) == {"alder birch cedar dunn"}
    assert of(spark, names.firm_key, "LLP", None, "J. R. Stone", "The Hall Firm") == ["llp", "", "jr stone", "hall firm"]


def test_company_names(spark):
    rows = ["Northwind Electronics, Co., Ltd.", "Kokadi GmbH & Co. KG", "X S.A. de C.V.", "Plain Goods", "Casa de", "Acme Incorporated (2)"]
    assert of(spark, names.company_core, *rows) == ["northwind electronics", "kokadi", "x", "plain goods", "casa de", "acme"]
    assert of(spark, names.company_form, *rows) == ["co ltd", "gmbh co kg", "sa de cv", "", "", "inc"]
    assert of(spark, names.company_key, "X S.A. de C.V.", "Plain Goods") == ["x [sa de cv]", "plain goods"]
    assert len(set(of(spark, names.company_key, "Pine IE Inc.", "Pine IE LLC", "Fir Electronics", "Fir Electronics, Inc."))) == 4
    got = of(spark, names.company_names, "HydroSpa LLC f/k/a Edge Works LLC", "Tom's East, Inc. (d/b/a Tom's Club)", "Old Co. n/k/a New Co.", "A Inc. (formerly known as B LLC) d/b/a C / D", None)
    assert [(x.primary, x.former, x.trade) for x in got] == [("HydroSpa LLC", ["Edge Works LLC"], []), ("Tom's East, Inc.", [], ["Tom's Club"]), ("New Co.", ["Old Co."], []), ("A Inc.", ["B LLC"], ["C", "D"]), ("", [], [])]
    assert of(spark, lambda c: names.family_key(c, ["the"], ["one"]), "the northwind sdi", "one", "12 x ab") == ["northwind", None, None]


def test_split_firms(spark):
    got = of(spark, names.split_firms, "Winter Tailor LLP, ABC Viper LLP (US), Houston Hanigan LLP, and Silberhall", "Stone, Jones & Lee LLP", "A Firm LLP; B Firm PC", "Jones et al", "Alpha L.L.P.and Beta PC", "Foo LLP, New York", None)
    assert [x.parts for x in got] == [["Winter Tailor LLP", "ABC Viper LLP (US)", "Houston Hanigan LLP", "Silberhall"], ["Stone, Jones & Lee LLP"], ["A Firm LLP", "B Firm PC"], ["Jones et al"], ["Alpha L.L.P.", "Beta PC"], ["Foo LLP, New York"], []]
    assert [x.rule for x in got[:3]] == ["suffix", None, "separator"] and got[3].review and not got[1].review
    known = spark.createDataFrame([("fen west",), ("finn henders",), ("fen",)], "key string")
    fields = spark.createDataFrame([("Fen West Finn Henders",), ("Fen Other",), ("Fen West",)], "field string")
    assert [tuple(r) for r in names.cover_by_known(fields, known).collect()] == [("Fen West Finn Henders", ["fen west", "finn henders"])]


def test_people(spark):
    got = of(spark, names.person, "James A. Fuller, III", "Bas de Blank", "Cher", "Dr. Hans van der Berg", "Dr.", None)
    assert [x and (x.first, x.middles, x.last) for x in got] == [("james", ["a"], "fuller"), ("bas", [], "de blank"), None, ("hans", [], "van der berg"), None, None]
    pairs = spark.createDataFrame([("T. Stone", "Tanner Stone"), ("John A. Stone", "John B. Stone"), ("John Stone", "J B Stone"), ("Ann Stone", "Ann Stoner")], "a string, b string")
    assert [r[0] for r in pairs.select(names.compatible(names.person(F.col("a")), names.person(F.col("b")))).collect()] == [True, False, True, False]


def test_similarity_against_plain_subsequences():
    rnd = random.Random(0)

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        a, b = ("".join(rnd.choices("abcd ", k=rnd.randrange(20))) for _ in range(2))
        assert similarity.lcs(a, b) == plain(a, b) == similarity.lcs(b, a)
    assert similarity.partial_ratio("abc", "xxabcxx") == 100 and similarity.token_set_ratio("a b", "b a c") == 100


@pytest.mark.parametrize("a, b, want", [("wiitgen group holding", "wirtgen group holding", "typo"), ("shenzhen carku technology", "shenzhen yark technology", "different"), ("sams east", "sams west", "different"), ("hong kong boze", "hongkong boze", "typo")])
def test_verdicts(a, b, want):
    assert similarity.compare(a.split(), b.split(), frozenset({"east", "west"})).verdict == want


@pytest.mark.parametrize("text, want", [("1-5, 8, and 12", [1, 2, 3, 4, 5, 8, 12]), ("1 through 4", [1, 2, 3, 4]), ("2—4 and 7", [2, 3, 4, 7]), ("claims 3", [3])])
def test_claim_lists(text, want):
    assert claims.expand_claims(text) == want


@pytest.mark.parametrize("text", ["5-2", "1-200", "see above", "", "0", None])
def test_what_is_no_claim_list(text, spark):
    with pytest.raises(ValueError):
        claims.expand_claims(text)
    assert spark.createDataFrame([(text,)], "v string").select(claims.expand_udf("v").alias("x")).first().x.claims is None


def test_sentences_and_patents(spark):
    text = "The U.S. Court agreed. See Order No. 5 at 3. Acme Inc. lost on claims 1-3 of the '294 patent. So held the Fed. Cir. in 2024."
    got = of(spark, claims.sentences, text, 'Is it? "Yes." He left! it ended (A. B. C). Then PTO. New one', None, " ")
    assert list(map(len, got)) == [4, 5, 0, 0] and got[1] == ["Is it?", '"Yes."', "He left! it ended (A. B. C).", "Then PTO.", "New one"]
    s = "claims 1-3 of the '294 patent and claims 4 and 5 of U.S. Patent No. 9,748,347"
    assert claims.references(s) == [("1-3", 0, 10), ("4 and 5", 34, 48)]
    got = [claims.patent_for(r, s, ["8,350,294", "9,748,347"]) for r in claims.references(s)]
    assert got == ["8,350,294", "9,748,347"]
    assert claims.references("Claim 1, 2, and 7 through 9, are; claims; a claim of 3") == [("1, 2, and 7 through 9", 0, 27)]
    assert claims.ranges([3, 1, 2, 5]) == "claims 1-3, 5" and claims.ranges([]) == "" and claims.ranges([4, 4]) == "claim 4"


def test_columns(spark):
    df = spark.createDataFrame([("Oak & Elm LLP", "Oka & Elm"), (None, "x")], "a string, b string")
    got = df.select(similarity.indel_udf("a", "b").alias("r")).collect()
    assert got[0].r > 60 and got[1].r is None
