import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm.suffix_dedup import Suffixes, covered, fragments, op1_suffix_dedup, pieces_of, repeated, repeats, sliding_min


def plain(rows, length):
    """(id, spans, kept) of each row by counting all strings."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for d, x in data:
        mark = np.zeros(len(x) + 1, dtype=np.int8)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                mark[i : i + length] = 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mark))))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((d, spans, bytes(b for b, m in zip(x, mark) if not m)))
    return sorted(out, key=repr)


def run(spark, rows, length, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, data string, id int")
    return sorted([(r.id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in repeats(df, "doc_id", "text", length, **more).collect()], key=repr)


def corpus(rnd, docs=60, alphabet="ab c"):
    passages = ["".join(rnd.choices("abcdefgh ", k=rnd.randrange(20, 90))) for _ in range(8)]
    out = []
    for i in range(docs):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choices("ijklmnop ", k=rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, 6))]
        text = "".join(parts)
        if rnd.random() < 0.2:
            text = text[: rnd.randrange(len(text) + 1)] + rnd.choice("xyzé") + text[rnd.randrange(len(text) + 1) :]
        out.append((i, text))
    out += [(1000 + i, out[3][1]) for i in range(5)] + [(2000, "xy" * 200), (2001, "z" * 300), (2002, "abc" * 40 + "q" + "abc" * 40)]
    return out


def test_anchors_cover_every_string_and_depend_on_it_alone():
    rnd = random.Random(1)
    for _ in range(50):
        data = "".join(rnd.choices("ab", k=rnd.randrange(1, 200))).encode()
        at = {}
        for h, s, e, a in fragments(data, 20, 6):
            for p in range(s, e - 20 + 1):
                assert p not in at and p <= a <= p + 14
                at[p] = (h, a - p)
        assert sorted(at) == list(range(max(0, len(data) - 19)))
        by = {}
        for p, x in at.items():
            assert by.setdefault(data[p : p + 20], x) == x


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 50, 103)
    for w in (1, 2, 7, 103):
        assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_suffix_sort_against_plain_sort():
    rnd = random.Random(2)
    for _ in range(40):
        raw = bytes(rnd.choices(b"ab", k=300))
        starts = np.array(sorted(rnd.sample(range(300), 90)))
        ends = np.minimum(starts + rnd.randrange(1, 60), 300)
        groups = np.sort(np.array([rnd.randrange(4) for _ in starts]))
        groups = np.unique(groups, return_inverse=True)[1]
        s = Suffixes(np.frombuffer(raw, dtype=np.uint8), starts, ends)
        order = s.sort(groups)
        assert order.tolist() == sorted(range(90), key=lambda i: (groups[i], raw[starts[i] : ends[i]], i))
        lcp = s.common(order[:-1], order[1:])
        for n, i, j in zip(lcp, order[:-1], order[1:]):
            x, y = raw[starts[i] : ends[i]], raw[starts[j] : ends[j]]
            assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def test_pieces_hold_each_string_once_and_share_their_core():
    rnd = random.Random(8)
    for _ in range(100):
        data = bytes(rnd.choices(b"abc", k=rnd.randrange(30, 90)))
        at = rnd.randrange(0, len(data) - 10)
        seen = []
        for block, lo, hi, core in pieces_of(at, data, 30, 8):
            assert len(core) == 23 and hi - lo < 8
            for s in range(lo, hi + 1):
                assert core in data[s : s + 30] and (at - s) // 8 == block
                seen.append(s)
        assert sorted(seen) == list(range(len(data) - 29))


def test_repeated_and_covered():
    got = repeated([(5, 3, b"xxxABCDEyy"), (5, 2, b"zxABCDEq"), (9, 0, b"ABCDE")], 6)
    assert [g.tolist() for g in got] == [[2], [1], []]
    assert covered(np.array([0, 1, 5, 30]), 6) == [0, 11, 30, 36] and covered(np.array([], dtype=int), 6) == []


@pytest.mark.parametrize("most", [4096, 8, 1])
def test_against_counting_all_strings(spark, most):
    rows = corpus(random.Random(5))
    assert run(spark, rows, 40, gram=12, most=most) == plain(rows, 40)


def test_edges(spark):
    rnd = random.Random(9)
    text = "".join(rnd.choices("abcdefgh é", k=900))
    rows = [(1, None), (2, ""), (3, "short"), (4, text), (4, text), (None, text[100:700] + "!"), (5, "-" * 1000), (6, "".join(rnd.choices("abcd", k=5000)))]
    assert run(spark, rows, 400) == plain(rows, 400)
    assert run(spark, [], 400) == []


def test_a_very_long_text():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 123, 3_000_000, dtype=np.uint8).tobytes()
    at = 0
    for _, s, e, _ in fragments(data, 400, 128):
        assert s == at
        at = e - 399
    assert at == len(data) - 399


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    size = {d: len((t or "").encode()) for d, t in rows}
    want = [(d, size[d], sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, spans, kept in plain(rows, 400)]
    assert sorted((tuple(r) for r in op1_suffix_dedup(spark, sf).collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 0


def test_passages_over_fifty_words_go_by_their_bytes(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(3, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    long, short = prose(90), " ".join(w[:5] for w in rnd.choices(words, k=51))
    assert len(long) >= 400 and 51 * 4 < len(short) < 396
    rows = [(i, f"{prose(200)} {(long, short, prose(90))[i % 3]} {prose(200)}") for i in range(60)]
    got = run(spark, rows, 400)
    assert got == plain(rows, 400)
    for i, spans, kept in got:
        assert bool(spans) == (i % 3 == 0) and long.encode() not in kept
        assert (short.encode() in kept) == (i % 3 == 1) and (kept == dict(rows)[i].encode() or i % 3 == 0)
