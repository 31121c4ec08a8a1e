import hashlib
from collections import Counter, defaultdict
from dataclasses import replace

from pyspark.sql import functions as F

from lodestar.llm import exact_dedup
from lodestar.llm.exact_dedup import build_directory, build_index, class_of, drop_copies, look_up, op2_exact_dedup


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


ROWS = [(1, "a", "x", 1), (2, "a", None, 2), (None, "a", "y", 3), (3, None, "z", 4), (4, "", "z", 5), (5, "A", "z", 6), (6, "b" * 300000, "z", 7), (7, "b" * 300000, "z", 7), (7, "b" * 300000, "z", 7)]


def table(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, key string, copies int")


def test_directory_splits_overfull_buckets_and_covers_every_key(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    made = build_directory(keys, capacity=20)
    sizes = Counter(r.bucket for r in made.route(keys).collect())
    assert sum(sizes.values()) == 3000 and max(sizes.values()) <= 20 and made.depth >= 8
    cells = [r.cell for r in made.cells.orderBy("cell").collect()]
    assert len(cells) == len(set(cells)) == made.size <= 1 << made.depth
    assert build_directory(keys.limit(0)).size == 0 and build_directory(keys.limit(9)).depth == 0
    # keys that share more first bits than the directory may be deep: their bucket stays overfull, cells stay few
    close = spark.range(64).select((F.lit(5 << 56) + F.shiftleft("id", 10)).alias("key"))
    deep = build_directory(close.union(keys), capacity=20)
    assert deep.size <= 1 << (8 + exact_dedup.SPREAD) and deep.route(close).select("bucket").distinct().count() == 1


def test_rows_are_found_through_the_directory(spark):
    df = table(spark)
    index = build_index(df, "doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    rows = df.select(F.col("doc_id").alias("id"), F.xxhash64(body).alias("key"), body.alias("body"))
    assert look_up(rows, index).count() == len(ROWS)
    wrong = replace(index, directory=replace(index.directory, cells=index.directory.cells.withColumn("bucket", F.col("bucket") + 1)))
    assert look_up(rows, wrong).count() == 0


def test_edges_and_clashing_names(spark):
    df = table(spark)
    got = sorted((tuple(r) for r in class_of(df, "doc_id", "text", capacity=4).collect()), key=repr)
    assert got == plain([(r[0], r[1]) for r in ROWS])
    kept = drop_copies(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7]
    assert class_of(df.limit(0), "doc_id", "text").count() == 0 and drop_copies(df.limit(0), "doc_id", "text").count() == 0


def test_collisions_are_chained_and_compared_by_bytes(spark):
    weak = lambda c: F.length(c).cast("long") % 2
    df = table(spark)
    assert {r.chain for r in build_index(df, "doc_id", "text", hashed=weak).entries.collect()} == {1, 2}
    got = sorted((tuple(r) for r in class_of(df, "doc_id", "text", hashed=weak).collect()), key=repr)
    assert got == plain([(r[0], r[1]) for r in ROWS])
    assert sorted(r.doc_id for r in drop_copies(df, "doc_id", "text", hashed=weak).collect()) == [2, 4, 5, 7]


def test_hot_texts_and_large_directories_take_the_other_way(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"t{i % 50}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, cells in ((1, 0), (600, 1 << 17), (100, 0)):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        monkeypatch.setattr(exact_dedup, "CELLS", cells)
        assert sorted((tuple(r) for r in class_of(df, "doc_id", "text", capacity=4).collect()), key=repr) == plain(rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op2_exact_dedup(spark, sf).collect()), key=repr) == plain(rows)


def test_plan_has_no_python(spark):
    plan = op2_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
