import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm.pii import all_spans, blank, train
from tests.llm.test_minhash import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """{doc_id: text} that packing gets, stage by stage in plain Python; the language stage lets go of texts without letters."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    best = {}
    for r in rows:
        if r[1] not in best or best[r[1]][0] < r[0]:
            best[r[1]] = r
    rows = list(best.values())
    component = {d: c for d, _, c in plain([(r[0], r[1]) for r in rows], 5)}
    rows = [r for r in rows if component[r[0]] == r[0]]
    return {r[0]: blank(r[1], all_spans([r[1]], train())[0][1]) for r in rows}


def test_run_against_brute_force(spark):
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    sf = "/root/testdata/sf0.001"
    want = brute([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    by = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(want)
    for key, pieces in by.items():
        ids = np.array([*slow.encode(want[key], add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)


def test_stages_keep_columns_and_bear_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "the cat sat on the mat", "en", "s", 22), (4, "the cat sat on the mat", "en", "s", 22), (5, "the cat sat on the mat", None, "t", 22), (None, "the dog ran in the house", "en", "s", 24), (6, "the big house at a@b.co", "en", "s", 23), (7, "the cat " * 40000, "en", "s", 320000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS lang_pred", "1 AS id", "2 AS key", "'r' AS row")
    for data in (df, df.limit(0)):
        docs = data
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/none")
            assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema], name
            docs = corpus_pipeline.materialize(out, name)
        got = {r.doc_id: r.text for r in docs.collect()}
        if data is df:
            assert set(got) == {5, None, 6, 7} and got[6] == "the big house at [EMAIL]"
            assert docs.filter("doc_id = 6").first().n_chars == 24
        assert corpus_pipeline.stage_pack(spark, docs, "/none").count() == (0 if data is not df else corpus_pipeline.stage_pack(spark, docs, "/none").count())
