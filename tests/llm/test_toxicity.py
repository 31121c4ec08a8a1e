import random
import zlib

import numpy as np

from lodestar.llm.toxicity import Lexicon, choose_terms, folded, learn, op4_toxicity, score


def test_folding():
    assert folded("Id1ot, ѕtupid!! ｓｃｕｍ tr@sh 123 m0r0n.") == " idiot stupid scum trash 123 moron "
    assert folded("") == folded(None) == "" and folded("!! %%") == ""
    assert folded("ÉTÉ the$$$ $5") == " ete the 5 "


def test_folding_reaches_beyond_the_basic_plane():
    bold = "".join(chr(0x1D41A + ord(c) - 97) for c in "scum")
    assert folded(f"you {bold} there") == " you scum there "
    assert folded("sc\u200bu\u00adm id\u0301iot \U000E0041x \U00020000y") == " scum idiot x y "


def test_hits_against_plain_search():
    """The automaton finds what a search for every term at every place finds."""
    rnd, parts = random.Random(3), ["scum", "scumbag", "idiot", "an", "trash", "can", "trashy", "x"]
    lex = Lexicon({" scum ": 3.0, " scu": 1.0, " idi": 2.0, " trash ": 2.5}, [" trash can "])
    for _ in range(300):
        text = folded(" ".join(rnd.choices(parts, k=rnd.randrange(8))))
        masked = [(i, i + 11) for i in range(len(text)) if text.startswith(" trash can ", i)]
        want = []
        for i in range(len(text)):
            here = [(w, t) for t, w in lex.weights.items() if text.startswith(t, i) and not any(a <= i and i + len(t) <= b for a, b in masked)]
            if here:
                w, t = max(here)
                want.append((i, t, w))
        assert lex.hits(text) == want


def test_hits_and_exceptions():
    lex = Lexicon({" trash ": 3.0, " idio": 2.0, " idiot ": 4.0}, [" trash can "])
    assert [h[1] for h in lex.hits(folded("an idiot, idiotic; trash can. trash!"))] == [" idiot ", " idio", " trash "]
    assert lex.hits("") == [] and Lexicon({}).hits(" trash ") == []


def test_terms_that_say_the_same_are_taken_once():
    got = choose_terms([(" tras", 50, 1), (" trash ", 50, 1), (" scum ", 40, 0), (" the ", 50, 500)], 50, 500, most=2)
    assert list(got) == [" scum ", " trash "] or list(got) == [" trash ", " scum "]


def test_edges(spark):
    docs = [(i, f"word{i} plain text of no harm {i}", "x") for i in range(60)] + [(100 + i, f"you utter scum number {i}", "x") for i in range(20)]
    docs += [(200, None, "x"), (201, "", "x"), (None, "scum", "x"), (202, "fine " * 50000, "x"), (202, "fine " * 50000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame([(i, 0, 1) for i in range(60)] + [(100 + i, 1, 1) for i in range(20)] + [(200, None, 0), (100, 0, 0), (None, 1, 1)], "doc_id long, toxic int, text int")
    lex = learn(d, lab, "doc_id", "text", "toxic")
    got = {}
    for r in score(d, "doc_id", "text", lex).collect():
        got.setdefault(r.id, []).append(r.score)
    assert min(got[110]) > 0.5 > max(got[3]) and got[200] == got[201] and len(got[202]) == 2
    assert all(0 <= s <= 1 for v in got.values() for s in v)
    none = learn(d, lab.limit(0), "doc_id", "text", "toxic")
    assert {round(r.score, 3) for r in score(d, "doc_id", "text", none).collect()} == {0.0}
    assert score(d.limit(0), "doc_id", "text", lex).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op4_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    y = np.array([(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth])
    hit = (y[:, 0] & y[:, 1]).sum()
    assert hit / y[:, 1].sum() > 0.85 and hit / y[:, 0].sum() > 0.85
