import itertools
import random

from pyspark.sql import functions as F

from lodestar.functions.similarity import indel_ratio
from lodestar.operators import counsel, resolve
from lodestar.operators.graph import components, merge, parted


def test_vetoed_merging(spark):
    assert parted(list("abcd"), [("b", "a"), ("b", "c"), ("c", "d")], [("a", "c")]) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    nodes = spark.createDataFrame([(x,) for x in "abcdxyz"], "node string")
    edges = spark.createDataFrame([("b", "a", 1), ("b", "c", 2), ("c", "d", 0), ("x", "y", 0)], "a string, b string, phase int")
    roots = lambda *apart: {r.node: r.root for r in merge(nodes, edges, spark.createDataFrame(list(apart), "a string, b string")).collect()}
    assert roots(("a", "c"), ("q", "x"), ("x", "z")) == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x", "y": "x", "z": "z"}
    assert roots(("y", "x"))["y"] == "y" and roots()["d"] == "a"


def test_components(spark):
    n = 40
    nodes = spark.createDataFrame([(i,) for i in range(n + 3)], "node long")
    edges = spark.createDataFrame([(i + 1, i) for i in range(n - 1)] + [(n, n + 1), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(n)} | {n: n, n + 1: n, n + 2: n + 2}


def test_candidate_pairs_miss_none(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choices("abcde ", k=rnd.randrange(3, 24))).strip() or "x" for _ in range(60)]
    keys = set(base) | {"kye", "kaye", "abc", "ab", "abcd", "a"}
    for b in base:
        c = list(b)
        for _ in range(rnd.randrange(3)):
            c[rnd.randrange(len(c))] = rnd.choice("abcdez")
        keys.add("".join(c))
    want = {(a, b) for a, b in itertools.combinations(sorted(keys), 2) if indel_ratio(a, b) >= 85}
    got = {(r.a, r.b) for r in resolve.candidate_pairs(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got == want and want


def seen(spark, rows):
    return spark.createDataFrame([(s, c, i) for i, (s, c) in enumerate(rows)], "spelling string, case_id string, ord int")


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "a string, b string")


def decided(spark, *rows):
    return spark.createDataFrame(list(rows), resolve.DECISIONS)


def test_firms(spark):
    ents, found = resolve.resolve_firms(spark, seen(spark, [("Kirkwood & Ellison LLP", "1"), ("Kikwood & Ellison", "2"), ("KIRKWOOD & ELLISON", "3"), ("Pilsen Winter Shaw Pitt", "4"), ("Pilsen Winter", "4"), ("Hogan Loyal", "5"), ("Hogan Loyal Cadwell", "6")]))
    got = {r.name: r for r in ents.collect()}
    assert got["Kirkwood & Ellison LLP"].cases == 3 and got["Kirkwood & Ellison LLP"].id == "firm:kirkwood-ellison-llp"
    assert any(len(r.keys) == 2 and "pilsen winter" in r.keys for r in got.values())
    roots = {r.key: r.root for r in found.roots.collect()}
    assert roots["hogan loyal"] != roots["hogan loyal cadwell"] and {r.rule for r in found.merges.collect()} == {"typo", "short form"}
    vetoed, _ = resolve.resolve_firms(spark, seen(spark, [("Kirkwood & Ellison LLP", "1"), ("Kikwood & Ellison", "2")]), apart=pairs(spark, ("kirkwood ellison", "kikwood ellison")))
    assert vetoed.count() == 2


def test_companies_and_decisions(spark):
    rows = [("HydroSpa LLC f/k/a Edge Works LLC", "1"), ("Edge Works LLC", "2"), ("Pine IE Inc.", "3"), ("Pine IE LLC", "4"), ("Fir Electronics", "5"), ("Wiitgen Group Holding Co.", "6"), ("Wirtgen Group Holding Co.", "7")]
    ents, found = resolve.resolve_companies(spark, seen(spark, rows))
    assert sorted(len(r.spellings) for r in ents.collect()) == [1, 1, 1, 2, 2] and {r.rule for r in found.merges.collect()} == {"former name", "typo"}
    a, b = "alpha widget makers one", "alpha widget makkers tone"
    judged = spark.createDataFrame([(a, b, "review", "d"), (a, "other", "different", "")], "a string, b string, verdict string, detail string")
    q = judged.filter("verdict = 'review'").select(resolve.question_id("firm")).first()[0]
    nodes = spark.createDataFrame([(a,), (b,), ("other",)], "key string")
    for answer, same, asked in (((), False, 1), ((q, "same", 0.9), True, 0), ((q, "same", 0.8), False, 1), ((q, "different", 0.9), False, 0)):
        edges, apart, open_ = resolve.settle("firm", judged, decided(spark, answer) if answer else None)
        got = resolve.resolution(nodes, edges, apart, open_)
        roots = {r.key: r.root for r in got.roots.collect()}
        assert (roots[a] == roots[b], got.review.count()) == (same, asked)
    surer = spark.createDataFrame([("x", "y", "review", "a word added or dropped")], "a string, b string, verdict string, detail string")
    q = surer.select(resolve.question_id("company")).first()[0]
    assert resolve.settle("company", surer, decided(spark, (q, "same", 0.9)))[0].count() == 0 and resolve.settle("company", surer, decided(spark, (q, "same", 0.96)))[0].count() == 1


def test_keys_and_ratios_are_computed_once(spark, monkeypatch):
    """A key for each spelling, not for each row; a ratio for each pair that meets (twice: it is filtered by and shown)."""
    keyed, rated, real = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), resolve.company_key

    @F.udf("string")
    def tally(key):
        keyed.add(1)
        return key

    @F.udf("double")
    def ratio(a, b):
        rated.add(1)
        return indel_ratio(a, b)

    monkeypatch.setattr(resolve, "company_key", lambda name: tally(real(name)))
    monkeypatch.setattr(resolve, "indel_udf", ratio)
    names = ["Blue Anvil Manufacturing Inc.", "Blue Anvil Manufacturng, Inc.", "Blue Anvil Manufcturing Inc.", "Tidewater Optics Ltd."]
    ents, _ = resolve.resolve_companies(spark, seen(spark, [(names[i % 4], str(i)) for i in range(400)]))
    assert sorted(r.cases for r in ents.collect()) == [100, 300]
    assert 4 <= keyed.value <= 20 and 3 <= rated.value <= 12


def test_two_rounds_and_context(spark):
    rows = seen(spark, [("Sams East", "1"), ("Sams West", "2"), ("Beta", "3")])
    asked = []

    def ask(questions):
        asked.append(questions.count())
        return questions.select("id", F.lit("same").alias("answer"), F.lit(0.9).alias("confidence"))

    ents, found = resolve.two_rounds(lambda d: resolve.resolve_firms(spark, rows, d), ask)
    assert asked == [1] and ents.count() == 2 and found.review.count() == 0
    _, first = resolve.resolve_firms(spark, rows)
    told = resolve.pair_context(first.review, resolve.keyed_by(rows, resolve.firm_key(F.col("spelling")))).first()
    assert told.about_a.spellings == ["Sams East"] and told.about_b.cases == 1


def test_attorneys(spark):
    rows = [("John A. Stone", "1", "f"), ("John B. Stone", "2", "g"), ("John Stone", "3", "h"), ("T. Jonas", "1", "f"), ("Tanner Jonas", "2", "f"), ("Mareesa Fredrick", "4", "k"), ("Mareesa Frederick", "5", "k"), ("Mareesa Fredrich", "6", "l"), ("A. Lone", "7", "m"), ("Ann Lone", "8", "n"), ("Dr.", "9", "o")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "spelling string, case_id string, firm string, ord int")
    ents, found = resolve.resolve_attorneys(spark, df)
    roots = {r.key: r.root for r in found.roots.collect()}
    assert roots["t jonas"] == roots["tanner jonas"] and roots["a lone"] == roots["ann lone"] and roots["mareesa fredrick"] == roots["mareesa frederick"] != roots["mareesa fredrich"]
    assert len({roots[k] for k in ("john a stone", "john b stone", "john stone")}) == 3 and {r.kind for r in found.review.collect()} == {"attorney"}
    assert {r.rule for r in found.merges.collect()} == {"same firm", "one person by name", "typo"} and ents.count() == 7


def test_attorneys_against_all_pairs(spark):
    """The rules over all pairs of a surname, on random names."""
    rnd = random.Random(5)
    rows = [(" ".join(filter(None, [rnd.choice(["Ann", "A", "Al", "Bo", "B"]), rnd.choice(["", "", "C", "Dora", "D"]), rnd.choice(["Stone", "Moss"])])), str(i), rnd.choice("fghijk"), i) for i in range(40)]
    df = spark.createDataFrame(rows, "spelling string, case_id string, firm string, ord int")
    _, found = resolve.resolve_attorneys(spark, df)
    people, firms = {}, {}
    for spelling, _, firm, _ in rows:
        parts = spelling.lower().replace(".", "").split()
        key = " ".join(parts)
        people[key] = parts
        firms.setdefault(key, set()).add(firm)
    fits = lambda x, y: x == y or (len(x) == 1 and y.startswith(x)) or (len(y) == 1 and x.startswith(y))
    like = lambda x, y: x[-1] == y[-1] and fits(x[0], y[0]) and all(map(fits, x[1:-1], y[1:-1]))
    want = {}
    for a, b in itertools.combinations(sorted(people), 2):
        x, y = people[a], people[b]
        if not like(x, y):
            continue
        others = [z for c, z in people.items() if c not in (a, b) and z[-1] == x[-1] and fits(z[0], x[0])]
        if firms[a] & firms[b]:
            want[a, b] = "same firm"
        elif all(like(z, x) and like(z, y) for z in others):
            want[a, b] = "one person by name"
        elif len(x) > 2 and x[1:-1] == y[1:-1]:
            want[a, b] = "same middle names"
    assert {(r.a, r.b): r.rule for r in found.merges.collect()} == want and want


def test_kinds_and_successions(spark):
    firms = spark.createDataFrame([("1", "Oak & Elm LLP", ["Oak & Elm LLP"]), ("2", "Pine Corp.", ["Pine Corp."]), ("3", "Fir Holdings Inc", ["Fir Holdings Inc"]), ("4", "Department of Trees", ["Department of Trees"]), ("5", "Tree Institute", ["Tree Institute"]), ("6", "Maple Co", ["Maple Co"]), ("7", "Yew Stone", ["Yew Stone"]), ("8", "Birch, Elm & Ash, Ltd.", ["Birch, Elm & Ash, Ltd."])], "id string, name string, spellings array<string>")
    parties = spark.createDataFrame([("2", "Pine LLC"), ("3", "Fir Europe GmbH"), ("1", "Oak Goods Inc."), ("6", "Other")], "firm string, name string")
    got = {r.id: r.kind for r in resolve.kinds(firms, parties, spark.createDataFrame([("yew stone", "company")], "key string, kind string")).collect()}
    assert got == {"1": "law_firm", "2": "self_represented", "3": "self_represented", "4": "government", "5": "organization", "6": "company", "7": "company", "8": "law_firm"}
    roots = spark.createDataFrame([("oak", "oak"), ("elm", "oak"), ("fir", "fir")], "key string, root string")
    links = spark.createDataFrame([("Oak LLP", "Fir LLP"), ("Elm", "Oak"), ("Nobody", "Fir")], "predecessor string, successor string")
    assert [tuple(r) for r in resolve.successions(links, roots).collect()] == [("oak", "fir")]


def test_represented(spark):
    reps = spark.createDataFrame([("c", "oak", ["Ann B. Lee", "Nobody Known"], [("Pine Inc.", "Complainant")]), ("c", "elm", [], None)], "case_id string, firm_key string, attorneys array<string>, parties array<struct<name:string,role:string>>")
    ents = lambda *x: spark.createDataFrame(list(x), "id string, keys array<string>")
    got = {r.firm_key: r for r in resolve.represented(reps, ents(("f:1", ["oak"])), ents(("a:1", ["ann b lee"])), ents(("c:1", ["pine [inc]"]))).collect()}
    assert (got["oak"].firm_id, got["oak"].attorney_ids, got["oak"].party_ids) == ("f:1", ["a:1"], ["c:1"]) and (got["elm"].firm_id, got["elm"].attorney_ids) == (None, [])


def test_parties_in_text(spark):
    parties = ["Northwind Electronics Co., Ltd.", "Northwind Electronics America, Inc.", "Ringway, Inc.", "Ōuna Health Oy"]
    of = lambda make, v: spark.createDataFrame([(v,)], "v string").select(make(F.col("v"))).first()[0]
    assert of(counsel.split_parties, "Northwind Electronics Co., Ltd., Northwind Electronics America, Inc., Ringway Inc., and Ōuna Health Oy") == ["Northwind Electronics Co., Ltd.", "Northwind Electronics America, Inc.", "Ringway Inc.", "Ōuna Health Oy"]
    texts = spark.createDataFrame([("c", "Northwind Electronic Co., Ltd., Ringway Inc. and Ouna Health Oy"), ("c", "Nobody")], "case_id string, text string")
    got = {r.text: r.found for r in counsel.named_in(texts, spark.createDataFrame([("c", p) for p in parties], "case_id string, name string")).collect()}
    assert set(got["Northwind Electronic Co., Ltd., Ringway Inc. and Ouna Health Oy"]) == {parties[0], parties[2], parties[3]} and got["Nobody"] == []


def test_titles_and_notices(spark):
    title = "Notice of Appearance of Oak & Elm LLP and Yew Stone LLP on Behalf of Pine Inc.; Designation of Ann Lee as Lead Counsel"
    gone = "Notice of Withdrawal of Appearance of Bo Ray, and Cy Fox from Oak & Elm LLP on Behalf of Pine Inc."
    df = spark.createDataFrame([(0, title), (1, gone), (2, "Motion"), (3, None)], "i int, t string")
    got = [r.f for r in df.select("i", counsel.title_facts(F.col("t")).alias("f")).orderBy("i").collect()]
    assert (got[0].firms, got[0].lead) == (["Oak & Elm LLP", "Yew Stone LLP"], "Ann Lee") and (got[1].firms, got[1].withdrawn) == (["Oak & Elm LLP"], ["Bo Ray", "Cy Fox"]) and got[2].firms == got[3].firms == []
    texts = ["enters as counsel for the limited purpose of responding to the subpoena served on May 2, 2031 by Respondents in this investigation.", "Please take note. It has been served with a Subpoena Duces Tecum. More.", "as counsel for Proposed Intervenor Pine", "Nothing here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.p for r in df.select("i", counsel.limited_purpose(F.col("t")).alias("p")).orderBy("i").collect()]
    assert (got[0].served_by, str(got[0].served_on), got[0].subpoena) == ("Respondents", "2031-05-02", True) and got[1].purpose == "a Subpoena Duces Tecum" and (got[2].purpose, got[2].intervenor) == ("proposed intervenor", True) and got[3] is None and got[4] is None
    state = spark.createDataFrame([("x", None, None), (None, None, None), (None, "n", 2), (None, "n", None)], "p string, n string, f int")
    assert [r[0] for r in state.select(counsel.non_party_status(F.col("p"), F.col("n"), F.col("f"))).collect()] == ["read", "no_notice", "no_reason", "not_downloaded"]
    people = spark.createDataFrame([("c", "f", f"p{i}", i == 5, i == 0, i) for i in range(9)], "case_id string, firm_key string, person string, lead boolean, withdrawn boolean, ord int")
    assert [(r.shown, r.more) for r in counsel.shown_attorneys(people).collect()] == [(["p5", "p1", "p2", "p3", "p4", "p6"], 3)]


def test_representations(spark):
    docs = spark.createDataFrame([
        ("c", "1", 0, "Notice of Appearance", "Ann Lee", "Acme Inc.", "Big Law LLP", "2026-01-01"), ("c", "2", 1, "Motion", "Ann Lee", "Acme Inc.", "Big Law, LLP", "2026-02-01"), ("c", "3", 2, "Motion", "Ann Lee", "Acme", "Small Office", "2026-02-02"),
        ("c", "4", 3, "Notice of Appearance", "Bo Ray", "Globex Corp.", "Other Firm PC", "2026-01-05"), ("c", "5", 4, "Joint motion", "Bo Ray", "Acme Inc. and Globex Corp.", "Other Firm PC", "2026-03-01"), ("c", "6", 5, "Subpoena", "Cy Fox", "Google LLC", "Third Firm LLP", "2026-03-02"),
    ], "case_id string, id string, ord int, title string, filed_by string, on_behalf_of string, firm string, day string")
    parties = spark.createDataFrame([("c", "Acme Inc.", "Complainant"), ("c", "Globex Corp.", "Respondent")], "case_id string, name string, role string")
    reps, unmatched = counsel.representations(docs, parties)
    got = {r.firm_key: r for r in reps.collect()}
    assert set(got) == {"big law", "other firm", "third firm"}
    assert [p.name for p in got["big law"].parties] == ["Acme Inc."] and got["big law"].filings == 2 and [p.name for p in got["other firm"].parties] == ["Globex Corp."] and got["third firm"].parties is None
    assert [r.name for r in unmatched.collect()] == ["Google LLC"] and got["big law"].turn == 1


def test_signature_firms(spark):
    lines = spark.createDataFrame([("d", 1, "Ann Lee", True), ("d", 2, "BIG LAW LLP", False), ("d", 3, "1 Main St", False), ("d", 4, "Bo Ray", True), ("d", 5, "Known Partners", False), ("d", 6, "Cy Fox", True)], "doc_id string, pos int, line string, is_person boolean")
    known = spark.createDataFrame([("known partners",)], "key string")
    assert {(r.person, r.firm) for r in counsel.signature_firms(lines, known).collect()} == {("Ann Lee", "BIG LAW LLP"), ("Bo Ray", "Known Partners"), ("Cy Fox", "Known Partners")}
