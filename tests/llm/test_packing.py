import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestar.llm.packing import PRODUCTION, PROMPT, Limits, Packer, op5_packing, pack, tokenizer


def rebuilt(rows, limits):
    """Holds the pieces against the plain statement of the contract."""
    docs, seqs = {}, {}
    for key, start, length, ids, total, seq, off, loss, _ in rows:
        docs.setdefault(key, []).append((start, ids, total))
        seqs.setdefault(seq, []).append((off, length, loss))
        assert len(ids) == 4 * length and length > 0
    padding = 0
    for pieces in seqs.values():
        at = 0
        for off, length, _ in sorted(pieces):
            assert off == at
            at += length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(p[2] for p in pieces) <= limits.loss_tokens
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return {k: b"".join(x[1] for x in sorted(v)) for k, v in docs.items()}, padding


@pytest.mark.parametrize("limits", [Limits(), PRODUCTION, Limits(64, 3, 64), Limits(128, 500, 50)])
def test_packer_is_lossless_and_within_every_limit(limits):
    rnd = random.Random(5)
    packer, rows, want = Packer(limits, 7), [], {}
    for key in range(900):
        ids = np.array([rnd.randrange(50000) for _ in range(rnd.choice([1, 2, 5, 40, 300, 2500]))], dtype="<u4")
        want[key] = ids.tobytes()
        rows += packer.add(key, ids, rnd.choice([0, 0, len(ids) // 2]))
    rows += packer.end()
    got, padding = rebuilt(rows, limits)
    assert got == want
    assert padding == 0


def test_both_libraries_agree():
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    rnd, encode = random.Random(1), tokenizer("byte_bpe_50k")
    alphabet = [chr(c) for c in [*range(0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x203B)]] + [" ", "\n", "the ", "'ll", "<|endoftext|>", "12"] * 20
    for _ in range(400):
        text = "".join(rnd.choices(alphabet, k=rnd.randrange(60)))
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids
    assert encode("日本 क्ष 🙂").tolist() == slow.encode("日本 क्ष 🙂", add_special_tokens=False).ids


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "a b", None), (3, "word " * 5000, 1)], "doc_id long, text string, start int")
    rows = [tuple(r) for r in pack(df, "doc_id", "text").collect()]
    assert sorted(r[4] for r in rows if r[0] in (1, 2)) == [1, 1, 1]
    assert sum(r[2] for r in rows if r[0] is None) == 3
    assert sum(r[2] for r in rows if r[0] == 3) == 5002 or sum(r[2] for r in rows if r[0] == 3) > 5000
    assert pack(df.limit(0), "doc_id", "text").count() == 0


def test_query_against_plain_tokenizer(spark):
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = {}
    for r in op5_packing(spark, sf).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for key, pieces in by.items():
        ids = np.array([*slow.encode(texts[key] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)


def test_every_limit_binds_in_the_query(spark):
    """On the query's own documents each axis alone closes sequences, and each keeps to its limit."""
    sf = "/root/testdata/sf0.01"
    seqs = {}
    for r in op5_packing(spark, sf).collect():
        x = seqs.setdefault(r.sequence_id, [0, 0, 0])
        x[0], x[1], x[2] = x[0] + r.length, x[1] + 1, x[2] + r.loss_tokens
    limits = (PRODUCTION.tokens, PRODUCTION.segments, PRODUCTION.loss_tokens)
    assert all(a <= b for x in seqs.values() for a, b in zip(x, limits))
    at = [sum(x[i] == limits[i] for x in seqs.values()) for i in range(3)]
    print(len(seqs), at)
    assert at[0] > 0.4 * len(seqs) and at[2] > 0
    short = spark.createDataFrame([(i, "a few words") for i in range(400)], "doc_id long, text string")
    few, many = (len({r.sequence_id for r in pack(short.coalesce(1), "doc_id", "text", x, prompt=PROMPT).collect()}) for x in (PRODUCTION, Limits(1024, 500, 992)))
    assert many < 6 and few > 400 / PRODUCTION.segments


def test_both_libraries_agree_on_every_document():
    import public_tokenizers
    import pyarrow.parquet as pq

    slow, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokenizer("byte_bpe_50k")
    slow.encode_special_tokens = True
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert encode(text or "").tolist() == slow.encode(text or "", add_special_tokens=False).ids
