import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm.pieces import Lattice, Vocabulary, decode, decode_table, encode, gumbel_below, op3_pieces, samples, spelled, split_words, text_of, uniform

VOCAB = Vocabulary.load("piece_bpe_32k.model", 1.0)


def seeds(n, at=0):
    return np.random.default_rng(at).integers(0, 1 << 63, n, dtype=np.uint64)


def every(text):
    """All segmentations of a short text as {ids: probability}, by plain recursion."""
    known = {p: i for i, p in enumerate(VOCAB.pieces) if i >= 259}
    s = "▁" + text.replace(" ", "▁")

    def go(i):
        if i == len(s):
            return [((), 0.0)]
        out = []
        for j in range(i + 1, min(len(s), i + 16) + 1):
            if s[i:j] in known:
                step, w = (known[s[i:j]],), VOCAB.weights[known[s[i:j]]]
            elif j == i + 1:
                raw = s[i].encode()
                step, w = tuple(b + 3 for b in raw), len(raw) * VOCAB.weights[3]
            else:
                continue
            out += [(step + ids, w + x) for ids, x in go(j)]
        return out

    weight = {}
    for ids, w in go(0):
        weight[ids] = weight.get(ids, 0) + math.exp(w)
    total = sum(weight.values())
    return {ids: w / total for ids, w in weight.items()}


def test_pieces_hold_no_newline_and_no_inner_space():
    assert not any("\n" in p for p in VOCAB.pieces[259:])
    assert not any("▁" in p[1:] and set(p) != {"▁"} for p in VOCAB.pieces[259:])


@pytest.mark.parametrize("text", ["the cat", "ab é", "a𝒳b", " x  y"])
def test_probabilities_are_those_of_the_lattice(text):
    want = every(text)
    got = {}
    for found, _ in samples([text] * 4000, seeds(4000), 1, VOCAB):
        (ids, logp, _), = found
        got[tuple(ids.tolist())] = got.get(tuple(ids.tolist()), 0) + 1
        assert math.isclose(math.exp(logp), want[tuple(ids.tolist())], rel_tol=1e-9)
    assert all(abs(got.get(ids, 0) / 4000 - p) < 5 * math.sqrt(p / 4000) + 2e-3 for ids, p in want.items())


def test_samples_without_replacement_follow_the_sequential_law():
    text = "then"
    want, n = every(text), 6000
    pairs = Counter()
    for found, _ in samples([text] * n, seeds(n, 3), 2, VOCAB):
        assert found[0][2] > found[1][2]
        pairs[tuple(tuple(f[0].tolist()) for f in found)] += 1
    assert all(a != b for a, b in pairs)
    for (a, b), c in pairs.items():
        p = want[a] * want[b] / (1 - want[a])
        assert abs(c / n - p) < 6 * math.sqrt(p / n) + 2e-3
    assert abs(sum(want[a] * want[b] / (1 - want[a]) for a, b in pairs) - 1) < 0.05


def test_inclusion_estimates_are_unbiased():
    text, n, k = "other one", 3000, 3
    total = 0.0
    for found, kappa in samples([text] * n, seeds(n, 5), k, VOCAB):
        total += sum(math.exp(logp) / -math.expm1(-math.exp(logp - kappa)) for _, logp, _ in found)
    assert abs(total / n - 1) < 0.05


def test_round_trip_and_distinct():
    rnd = random.Random(2)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "日本", "🙂", "123", "<s>", "\u0000", "﻿", "x" * 40]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(30))) for _ in range(400)] + ["z" * 20000, "ab " * 20000]
    for text, (found, _) in zip(texts, samples(texts, seeds(len(texts)), 4, VOCAB)):
        assert len({tuple(ids.tolist()) for ids, *_ in found}) == len(found)
        assert all(decode(ids, VOCAB) == text for ids, *_ in found)
        assert [v for *_, v in found] == sorted((v for *_, v in found), reverse=True)
    assert "".join(split_words("a b\n c")).replace("▁", " ") == " a b\n c"


def test_all_segmentations_come_out_in_the_end():
    want = every("ab")
    found, kappa = samples(["ab"], seeds(1), 1000, VOCAB)[0]
    assert {tuple(ids.tolist()) for ids, *_ in found} == set(want) and kappa == -np.inf


def test_samples_depend_on_the_key_alone():
    texts = ["some words here", "other words there", "same again"]
    s = seeds(3)
    together = samples(texts, s, 3, VOCAB)
    for i in range(3):
        alone = samples([texts[i]], s[i : i + 1], 3, VOCAB)[0]
        assert [ids.tolist() for ids, *_ in alone[0]] == [ids.tolist() for ids, *_ in together[i][0]]


def test_truncated_gumbel():
    u = uniform(np.random.default_rng(0).integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2))
    x = gumbel_below(np.full(20000, -1.0), np.full(20000, 0.3), u)
    assert x.max() <= 0.3
    cdf = lambda t: math.exp(-math.exp(-(t + 1.0)))
    assert abs((x < -1.0).mean() - cdf(-1.0) / cdf(0.3)) < 0.02


def test_backward_mass_is_one():
    lattice = Lattice(["▁the", "▁x́y", "q" * 50], VOCAB)
    total = np.bincount(lattice.source, weights=np.exp(lattice.logp))
    assert np.allclose(total[total > 0], 1)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "ab"), (3, "ab"), (None, "the cat"), (4, "word " * 30000), (5, "日" * 500)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, rank int, ids string")
    got = {}
    for r in encode(df, "doc_id", "text", k=3).collect():
        got.setdefault(r.id, []).append(r)
    assert [(r.n_pieces, r.logp, r.inclusion) for r in got[1] + got[2]] == [(0, 0.0, 1.0)] * 2
    assert sorted(r.rank for r in got[3]) == [1, 1, 2, 2, 3, 3] and len({bytes(r.ids) for r in got[3]}) == 3
    assert all(decode(np.frombuffer(r.ids, dtype="<u2"), VOCAB) == rows[5][1] and 0 <= r.inclusion <= 1 for r in got[4])
    assert sorted(r.rank for r in got[None]) == [1, 2, 3]
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_text_of_is_decode():
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(["a", " ", "▁", "é", "🙂", "\n", "the"], k=20)) for _ in range(50)]
    for found, _ in samples(texts, seeds(50), 2, VOCAB):
        assert all(text_of(ids, spelled("piece_bpe_32k.model")) == decode(ids, VOCAB) for ids, *_ in found)
    assert text_of(np.array([VOCAB.first_byte + 0xC3]), spelled("piece_bpe_32k.model")) == "\ufffd"


def test_table_is_decoded(spark):
    rows = [(1, None), (2, ""), (3, " a▁b  é🙂\n"), (None, "the cat"), (4, "word " * 1_000_000)]
    df = spark.createDataFrame(rows, "id long, text string")
    found = encode(df, "id", "text", k=2).withColumnRenamed("id", "decoded_")
    got = {(r.decoded_, r.text) for r in decode_table(found, "ids").collect()}
    assert got == {(k, t or "") for k, t in rows}
    assert {(r.id, r.decoded) for r in encode(df, "id", "text", k=2, decode=True).collect()} == got
    nulls = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert {r.text for r in decode_table(nulls, "ids").collect()} == {None, ""}
    assert decode_table(found.limit(0), "ids").count() == 0


def test_query_decodes_every_row(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: r.sha for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
    rows = op3_pieces(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(want) and all(r.decoded_sha256 == want[r.doc_id] for r in rows)
