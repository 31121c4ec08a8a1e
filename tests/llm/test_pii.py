import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.pii import KINDS, Crf, all_spans, base_spans, blank, find, luhn, op8_pii, redact, train

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "@c.d", "_", "é", "1", "255", "256", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "1.2.3.4", "+1 (212) 555-0100", "\n"]), max_size=30))
def test_base_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert base_spans(text) == plain(text)


def test_linear_in_long_runs():
    for text in ("1" * 300000, "a." * 150000, "a@" * 150000, "1.2." * 100000, "+1 " * 100000, "a@b" * 100000):
        base_spans(text)


def test_splitting_at_certain_tokens_is_exact():
    import random

    from lodestar.llm.pii import training_table

    model = train()
    whole = Crf(**{**model.__getstate__()})
    whole.margin = None
    assert model.margin is not None
    rnd = random.Random(3)
    for tokens, _ in training_table(200, seed=5):
        text = rnd.choice([" ", "\n", "  "]).join(tokens)
        assert model.label([text]) == whole.label([text])


def test_held_out_sentences():
    from lodestar.llm.pii import training_table

    model, right, total, extra = train(), 0, 0, 0
    for tokens, labels in training_table(400, seed=77):
        text = " ".join(tokens)
        got = {(k, a) for k, a, _ in model.label([text])[0]}
        at = 0
        want = set()
        for i, (t, y) in enumerate(zip(tokens, labels)):
            if y != "o" and (i == 0 or labels[i - 1] != y):
                want.add((y, at))
            at += len(t) + 1
        right, total, extra = right + len(want & got), total + len(want), extra + len(got - want)
    assert right / total > 0.93 and extra / total < 0.05


def held_out(model, n=400, seed=77):
    """Spans of a labelled table that was not learned from: how many there are, found by the patterns, found with the
    model, and found where none is."""
    from lodestar.llm.pii import training_table

    total = base_hits = hits = extra = 0
    for tokens, labels in training_table(n, seed=seed):
        at, want = 0, set()
        for i, (t, y) in enumerate(zip(tokens, labels)):
            if y != "o" and (i == 0 or labels[i - 1] != y):
                want.add((y, at))
            at += len(t) + 1
        base, spans = all_spans([" ".join(tokens)], model)[0]
        near = lambda found: sum(any(k == kind and abs(a - start) <= 3 for k, a, _ in found) for kind, start in want)  # noqa: B023, E731
        total, base_hits, hits = total + len(want), base_hits + near(base), hits + near(spans)
        extra += len(spans) - near(spans)
    return total, base_hits, hits, extra


def test_held_out_recall_over_the_patterns_alone():
    total, base, both, extra = held_out(train())
    print(total, base, both, extra)
    assert base / total < 0.5 and both / total > 0.9 and extra / total < 0.06


def test_labelled_table_is_read_as_data(spark):
    from lodestar.llm.pii import fit, labelled, training_table

    rows = [(t, y, 1) for t, y in training_table(250, seed=3)] * 2 + [(None, None, 0), (["a"], ["o", "o"], 0), (["a"], ["name"], 0), ([], [], 0), (["a", None], ["o", "o"], 0)]
    df = spark.createDataFrame(rows, "tokens array<string>, labels array<string>, text int")
    table = labelled(df)
    assert len(table) == len({tuple(t) for t, _ in training_table(250, seed=3)}) and len(labelled(df, most=10)) == 10
    model = fit(table)
    total, base, both, _ = held_out(model, 200)
    assert both > base and both / total > 0.8
    got = find(spark.createDataFrame([(1, "call (212) 555-0188 now")], "id long, text string"), "id", "text", model).first()
    assert [s.kind for s in got.spans] == ["phone"] and got.base == []


def test_shapes_read_whole_tokens():
    from lodestar.llm.pii import features

    assert features("1." * 18 + "x")[1] != features("1." * 18 + "@")[1]
    assert features("a1" * 30 + "@b.com")[1] != features("a1" * 30)[1]


def test_what_the_model_adds():
    model = train()
    text = "write to jane at corp dot com or call (212) 555-0188 on 2024-01-15 about part 1234"
    base, spans = all_spans([text], model)[0]
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [("email", "jane at corp dot com"), ("phone", "(212) 555-0188")]
    assert blank(text, spans) == "write to [EMAIL] or call [PHONE] on 2024-01-15 about part 1234"


def test_edges(spark):
    rows = [(1, None, 5, "q"), (2, "", 0, "q"), (3, "a@b.co", 6, "q"), (3, "a@b.co", 6, "q"), (None, "é 1.2.3.4", 9, None), (4, "word " * 60000 + "x@y.z", 300005, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r.id: [tuple(s) for s in r.spans] for r in find(df, "doc_id", "text").collect()}
    assert got == {1: [], 2: [], 3: [("email", 0, 6)], None: [("ip", 2, 9)], 4: [("email", 300000, 300005)]}
    out = redact(df, "text", "n_chars")
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    back = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert back[1] == (None, 5) and back[2] == ("", 0) and back[3] == ("[EMAIL]", 7) and back[None] == ("é [IP]", 6)
    assert find(df.limit(0), "doc_id", "text").count() == 0 and redact(df.limit(0), "text").count() == 0


def test_query_against_the_patterns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in KINDS)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
