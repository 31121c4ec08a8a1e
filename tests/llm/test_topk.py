import math
import random

from pyspark.sql import functions as F

from lodestar.llm.topk import search


def plain(rows, k):
    ok = [(i, [min(2**26, max(-(2**26), math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if i is not None and i % 20 == 0}:
        scored = sorted(((sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q), key=lambda s: (-s[0], s[1] is None, s[1]))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def run(spark, rows, k=5, **sizes):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=k, **sizes)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, [round(rnd.gauss(0, 0.3), 3) for _ in range(12)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 520)]  # one very common vector: ties go to the smaller id
    assert run(spark, rows, block=60, queries=4) == plain(rows, 5)
    assert run(spark, rows[:300], k=20) == plain(rows[:300], 20)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (40, [inf, 1.0]), (5, []), (None, [3.0, 1.0]), (6, [1e30, -1e30]), (7, [0.0, 0.0]), (7, [0.0, 0.0])]
    assert run(spark, rows, k=4) == plain(rows, 4)
    assert run(spark, rows[:1]) == [] and run(spark, []) == []
