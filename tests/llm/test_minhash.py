import random
import re

import numpy as np
import pytest

from lodestar.llm.minhash import Index, cluster, components, connect, forest, keep_one, op9_minhash, open_pairs, shingles


def plain_set(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    n = min(width, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def plain(rows, width):
    """(id, set size, least id reached) of each row, by comparing all pairs."""
    sets = [plain_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=repr)


def run(spark, rows, width=5, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n int")
    return sorted([(r.id, r.n_shingles, r.component_id) for r in cluster(df, "doc_id", "text", width, **more).collect()], key=repr)


def prose(rnd, n):
    return " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(300)) for _ in range(n))


def edited(rnd, text, share):
    w = text.split()
    for i in rnd.sample(range(len(w)), int(share * len(w))):
        w[i] = f"new{rnd.randrange(10**9)}"
    return " ".join(w)


def test_sets_are_those_of_the_words():
    rnd = random.Random(0)
    for _ in range(200):
        text = "".join(rnd.choices(["a", "B", "b", "É", " ", "\n", "\x0b", " ", "c.", "日"], k=rnd.randrange(40)))
        for width in (1, 4, 5):
            assert len(shingles(text, width)) == len(plain_set(text, width))
    assert (shingles("The CAT sat", 2) == shingles(" the\tcat sat\n", 2)).all()
    assert (shingles("É a", 2) != shingles("é a", 2)).any()
    assert not np.isin(shingles("ab c", 1), shingles("a bc", 1)).any()


def test_every_pair_within_the_threshold_meets():
    index, rng = Index(), np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, index.symbols).astype("<u2")
        b = a.copy()
        b[rng.choice(index.symbols, index.threshold, replace=False)] ^= 1
        ka, kb = index.keys(np.stack([a, b]))
        assert np.isin(ka, kb).any()


def test_forest():
    sig = np.array([[0] * 4, [0, 0, 0, 1], [0, 0, 1, 1], [9, 9, 9, 9]], dtype="<u2")
    assert forest(np.array([10, 11, 12, 13]), sig, 2) == [(10, 11), (11, 12)]


def test_each_open_pair_is_taken_by_one_bucket():
    index, rng = Index(), np.random.default_rng(2)
    sigs = np.repeat(rng.integers(0, 1 << 16, (1, index.symbols)), 12, axis=0).astype("<u2")
    for row in sigs:
        row[rng.choice(index.symbols, 9, replace=False)] ^= 7
    keys, taken = index.keys(sigs), {}
    for key in np.unique(keys):
        rows = np.flatnonzero((keys == key).any(axis=1))
        if len(rows) > 1:
            for i, js in open_pairs(sigs[rows], keys[rows], key, np.full(len(rows), 50), rows.copy(), np.ones(len(rows), dtype=bool), index.threshold):
                for j in js.tolist():
                    taken[int(rows[i]), int(rows[j])] = taken.get((int(rows[i]), int(rows[j])), 0) + 1
    within = {(i, j) for i in range(12) for j in range(i + 1, 12) if (sigs[i] != sigs[j]).sum() <= index.threshold}
    assert taken == dict.fromkeys(within, 1)


def test_connect_gives_links_that_join_components():
    sets = [np.arange(0, 10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(2, 12, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    comps = np.array([1, 2, 3, 4])
    pairs = ((i, np.arange(i + 1, 4)) for i in range(3))
    assert connect(sets, comps, pairs) == [(0, 1), (1, 2)] and comps[0] == comps[1] == comps[2] != comps[3]


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n)] + [(b"\xf0", b"\xf1")], "u binary, v binary")
    got = {bytes(r.node): bytes(r.comp) for r in components(links).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(n + 1)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_groups_of_near_copies_against_all_pairs(spark, block):
    rnd = random.Random(7)
    rows, n = [], 0
    for group in range(6):
        base = prose(rnd, 60 + 40 * group)
        for _ in range(4 * group + 1):
            rows.append((1000 - n, edited(rnd, base, rnd.choice([0, 0.01, 0.02, 0.035, 0.05]))))
            n += 1
    rows += [(2000 + i, prose(rnd, 50)) for i in range(20)]
    assert run(spark, rows, block=block) == plain(rows, 5)


def test_edges(spark):
    rnd = random.Random(3)
    text = prose(rnd, 80)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (7, text), (7, text), (7, prose(rnd, 30)), (None, text), (8, "w " * 60000), (9, "w " * 50000), (None, "alone at last"), (10, None)]
    assert run(spark, rows) == plain(rows, 5)
    assert run(spark, []) == []
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n int")
    kept = keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "")[:9]) for r in kept.collect()), key=repr) == sorted([(1, ""), (2, ""), (3, " \n"), (4, "one"), (6, "one two"), (7, text[:9]), (7, rows[8][1][:9]), (8, "w w w w w"), (None, "alone at "), (10, "")], key=repr)
    assert keep_one(df.limit(0), "doc_id", "text").count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op9_minhash(spark, sf).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == plain(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
