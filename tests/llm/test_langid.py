import numpy as np

from lodestar.llm.langid import Filters, grams, learn, letters, op7_langid, predict


def text_of(cp):
    return "".join(map(chr, cp))


def test_letters():
    assert text_of(letters("Ab1, c!\n")) == " ab c "
    assert len(letters("12 %% \n")) == 0 and len(grams("")) == 0
    assert text_of(letters("é𝒳日")) == " é𝒳日 "


def test_masks_have_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(0, 1 << 63, 20000, dtype=np.uint64) for _ in range(3))
    f = Filters.build({"a": a, "b": b}, 18)
    assert (f.masks(a) & 1).all() and (f.masks(b) & 2).all()
    wrong = np.mean((f.masks(c) & 1) != 0)
    assert abs(wrong - f.false_rate[0]) < 0.01


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", 0.5), (2, "le chat et le chien", "fr", 0.5), (None, "the dog and the cat", "en", None), (4, None, "en", 1.0), (5, "12 34", None, 1.0), (6, "", "fr", 1.0), (7, "chat " * 60000, None, 1.0)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, score double")
    model = learn(df, "doc_id", "text", "lang", least=1)
    got = {(r[0], r.lang_pred) for r in predict(df, "text", model, ["doc_id"]).collect()}
    assert got == {(1, "en"), (2, "fr"), (None, "en"), (4, "und"), (5, "und"), (6, "und"), (7, "fr")}
    empty = learn(df.limit(0), "doc_id", "text", "lang")
    assert {r.lang_pred for r in predict(df, "text", empty, ["doc_id"]).collect()} == {"und"}
    assert predict(df.limit(0), "text", model, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_langid(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_more_languages_than_bits_of_a_word(spark):
    rng = np.random.default_rng(1)
    # language i is the more frequent the smaller i; each has letters of its own
    words = {f"l{i:03}": ["".join(chr(0x4E00 + 40 * i + int(c)) for c in rng.integers(0, 40, 4)) for _ in range(20)] for i in range(140)}
    rows = [(1000 * i + j, " ".join(rng.choice(w, 60).tolist()), name) for i, (name, w) in enumerate(words.items()) for j in range(3 if i < 70 else 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(df, "doc_id", "text", "lang", bits=16)
    assert set(model.languages) == set(words)
    got = {r.doc_id: r.lang_pred for r in predict(df, "text", model, ["doc_id"]).collect()}
    assert got == {k: name for k, _, name in rows}


def test_against_plain_sets(spark):
    """With filters so wide that nothing collides the prediction is that of plain sets of n-grams."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs, "doc_id", "text", "lang", least=1, bits=24)
    rows = docs.collect()
    sets = {}
    for r in rows:
        if r.text is not None and r.lang is not None:
            sets.setdefault(r.lang, set()).update(grams(r.text).tolist())
    names = sorted(sets)
    got = {r.doc_id: r for r in predict(docs, "text", model, ["doc_id"]).collect()}
    for r in rows:
        h = grams(r.text or "").tolist()
        share = [sum(x in sets[n] for x in h) / len(h) for n in names] if h else []
        want = names[int(np.argmax(share))] if h else "und"
        assert got[r.doc_id].lang_pred == want
        assert not h or abs(got[r.doc_id].score - max(share)) < 0.02


def test_ties_and_very_long_texts(spark):
    same = [(i, "abc def", lang) for i, lang in enumerate(["zz", "aa", "mm"] * 2)]
    df = spark.createDataFrame([*same, (9, "abc def " * 300000, None)], "doc_id long, text string, lang string")
    model = learn(df, "doc_id", "text", "lang")
    assert {(r.lang_pred, round(r.score, 3)) for r in predict(df, "text", model, ["doc_id"]).filter("doc_id < 9").collect()} == {("aa", 1.0)}
    assert predict(df, "text", model, ["doc_id"]).filter("doc_id = 9").first().lang_pred == "aa"
