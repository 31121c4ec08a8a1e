import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators.flatten import flatten
from lodestar.sinks import tables
from lodestar.sources import docket, documents, snapshots
from lodestar.streaming import incremental
from tests.support import feed_row


def at(day, hour=1):
    return dt.datetime.fromisoformat(f"{day}T{hour:02}:00:00+00:00")


def test_snapshots(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/snap", []
    raw = json.dumps({"date": "x", "count": 2, "data": [feed_row(), "no row", feed_row("999-1", **{"Investigation Categories": []})]}).encode()

    def flaky():
        calls.append(1)
        if len(calls) == 1:
            raise OSError
        return b"{broken" if len(calls) == 2 else raw

    waits = []
    name, fresh = snapshots.sync(spark, folder, flaky, now=at("2026-09-22"), wait=waits.append)
    assert fresh and waits == [10, 30] and snapshots.sync(spark, folder, flaky, now=at("2026-09-22", 5)) == (name, False)
    for day, hour in (("2026-09-23", 1), ("2026-09-23", 2), ("2026-09-24", 1)):
        snapshots.store(spark, folder, raw, at(day, hour))
    (tmp_path / "snap" / "other.txt").write_text("x")
    assert len(snapshots.names(spark, folder)) == 4 and snapshots.latest(spark, folder, "2026-09-23").endswith("T020000Z.json.gz")
    flat = flatten(snapshots.rows(spark, folder, name))
    assert {r.number for r in flat.collect()} == {"337-5120", "999-1"}
    assert [r.number for r in snapshots.in_category(flat, "Imports", "337-").collect()] == ["337-5120"]
    assert len(snapshots.prune(spark, folder, 2)) == 1 and snapshots.prune(spark, folder, 0) == []
    with pytest.raises(snapshots.BadSnapshot):
        snapshots.store(spark, folder, b"[]")
    (tmp_path / "snap" / "snapshot-2026-09-25T010000Z.json.gz").write_bytes(gzip.compress(b'{"data": [1'))
    with pytest.raises(Exception):
        snapshots.rows(spark, folder, "snapshot-2026-09-25T010000Z.json.gz").count()


def test_docket_source(spark, tmp_path):
    page = lambda ids: "<documents>" + "".join(f"<document><id>{i}</id><documentTitle> A &amp;amp; B </documentTitle><filedBy> </filedBy></document>" for i in ids) + "</documents>"
    (tmp_path / "337-TA-5").mkdir()
    for i, ids in enumerate(([9, 8], [7, 6], [5])):
        (tmp_path / "337-TA-5" / f"{i + 1}.xml").write_text(page(ids))
    spark.dataSource.register(docket.DocketSource)
    read = lambda **o: sorted(r.id for r in spark.read.format("docket").options(numbers="337-5,337-6", pages=str(tmp_path), **o).load().collect())
    assert read() == ["5", "6", "7", "8", "9"] and read(known="7,6") == ["6", "7", "8", "9"]
    row = spark.read.format("docket").options(numbers="337-5", pages=str(tmp_path)).load().first()
    assert row.documentTitle == "A & B" and row.filedBy is None and row.number == "337-5"


def test_case_files_and_merge(spark, tmp_path):
    (tmp_path / "337-1.json").write_text('[{"id": "a", "title": "x"}, {"id": "b"}]')
    (tmp_path / "337-2.json").write_text("{broken")
    got = docket.case_files(spark, f"file://{tmp_path}")
    assert {(r.key, r.id) for r in got.collect()} == {("337-1", "a"), ("337-1", "b")}
    fresh = spark.createDataFrame([("337-1", "b", "new"), ("337-1", "c", "new")], "key string, id string, document string")
    assert {(r.id, r.document[:3]) for r in docket.merged(got, fresh).collect()} == {("a", '{"i'), ("b", "new"), ("c", "new")}
    assert docket.load_json(str(tmp_path / "337-2.json"), 7) == 7 == docket.load_json("/none", 7)


def test_page_texts(spark, tmp_path):
    (tmp_path / "12_3_file_name.txt").write_bytes(b"one|" + b"x" * 200)
    (tmp_path / "13_1_bad.txt").write_bytes(b"!")
    found = documents.files(spark, f"file://{tmp_path}")
    read = lambda c: c.decode().split("|") if c != b"!" else 1 / 0
    got = documents.page_texts(found, read, lambda c, i: f"ocr {i}").orderBy("page").collect()
    assert [(r.doc_id, r.page, r.text[:5]) for r in got] == [("12", 1, "ocr 0"), ("12", 2, "xxxxx")]
    assert documents.uncached(found, spark.createDataFrame([(got[0].path,)], "path string")).count() == 1
    df = spark.createDataFrame([(10,), (2,), (0,)], "n int").select(documents.wanted_pages(F.col("n"), 3, 2)).collect()
    assert [r[0] for r in df] == [[1, 2, 3, 9, 10], [1, 2], []]
    prompt = documents.as_prompt(spark.createDataFrame([("d", 1, "a"), ("d", 4, "b")], "doc_id string, page int, text string")).first().text
    assert prompt == "[page 1]\na\n\n[...]\n[page 4]\nb"
    parts = spark.createDataFrame([("d", "1", 0, 3, "no"), ("d", "2", 1, 9, "body"), ("e", "3", 0, 2, "no"), ("e", "4", 1, 5, "no")], "doc_id string, att string, ord int, pages int, text string")
    assert {(r.doc_id, r.att) for r in documents.main_file(parts, F.col("text") == "body").collect()} == {("d", "2"), ("e", "4")}


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        tables.swap(spark.range(n), path)
    assert tables.load(spark, path).count() == 5
    with pytest.raises(Exception):
        tables.swap(spark.range(2).select(F.raise_error(F.lit("broken")).alias("id")), path)
    (tmp_path / "t" / "v8").mkdir()  # a version that was never finished
    assert tables.load(spark, path).count() == 5
    tables.swap(tables.load(spark, path).union(spark.range(1)), path)
    assert tables.load(spark, path).count() == 6 and sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v2", "v9"]
    assert tables.load(spark, path + "-none") is None
    df = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "key string, v int")
    assert len(tables.save_changed(df, None, "key", path + "2")) == 16
    back = lambda: spark.read.parquet(path + "2").select("key", "v")
    new = df.filter("key <> 'k7'").withColumn("v", F.when(F.col("key") == "k3", 99).otherwise(F.col("v")))
    assert 1 <= len(tables.save_changed(new, back(), "key", path + "2")) <= 2
    assert back().count() == 39 and back().filter("v = 99").count() == 1 and tables.save_changed(new, back(), "key", path + "2") == []
    log = spark.createDataFrame([("a", 1.0)], "started string, cost double")
    assert tables.append_log(log, path + "3") == tables.append_log(log, path + "3")
    assert tables.append_log(log.withColumn("more", F.lit(1)), path + "3").endswith(".v2") and spark.read.csv(path + "3", header=True).count() == 2
    docs = spark.createDataFrame([("a", [("x/a/1", "l")]), ("b", [("x/b/1", "l")])], "key string, attachments array<struct<href:string,label:string>>")
    moved = {r.key: r.attachments[0].href for r in tables.repoint(docs, spark.createDataFrame([("a", "z")], "key string, to string")).collect()}
    assert moved == {"z": "x/z/1", "b": "x/b/1"}
    pairs = spark.createDataFrame([("a", "b", "same", 1)], "a string, b string, verdict string, ord int")
    assert [(r.a, r.b, r.verdict) for r in tables.upsert_pairs(pairs, spark.createDataFrame([("b", "a", "different", 2)], pairs.schema)).collect()] == [("a", "b", "different")]


def test_merge_stream_resumes(spark, tmp_path):
    src, table, mark = (f"file://{tmp_path}/{n}" for n in ("in", "table", "mark"))
    schema = "id string, v int, ord int"
    for rows in ([("a", 1, 1), ("b", 1, 1)], [("a", 2, 2)], [("c", 3, 3), ("a", 0, 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.merge_stream(spark, src, schema, table, "id", mark).awaitTermination(60)
    got = lambda: {(r.id, r.v) for r in tables.load_buckets(spark, table, schema).collect()}
    assert got() == {("a", 2), ("b", 1), ("c", 3)}
    written = {p.name: len(list(p.glob("in_bucket=*"))) for p in (tmp_path / "table").iterdir()}
    assert max(written, key=lambda n: int(n[1:])) == "v3" and written["v3"] <= 2  # only the buckets of a and c
    spark.createDataFrame([("a", 7, 2), ("a", 5, 2), (None, 4, None)], schema).coalesce(1).write.mode("append").parquet(src)
    incremental.merge_stream(spark, src, schema, table, "id", mark).awaitTermination(60)
    assert got() == {("a", 7), ("b", 1), ("c", 3), (None, 4)}  # of equal ord the largest row
    incremental.merge_stream(spark, src, schema, table, "id", mark).awaitTermination(60)
    assert got() == {("a", 7), ("b", 1), ("c", 3), (None, 4)}


def test_replay_stream(spark, tmp_path):
    src = f"file://{tmp_path}/ev"
    schema = "claim string, id int, at timestamp, action string"
    t = dt.datetime(2026, 1, 1)
    batches = [[("1", 1, t, "instituted"), ("1", 2, t, "withdrawn"), ("2", 3, t, "instituted")], [("1", 4, t, "found_infringed"), ("2", 5, t, "found_infringed")], [("1", 6, t, "added")]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = incremental.replay_stream(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append({r.claim: (r.status, r.left) for r in df.collect()})).option("checkpointLocation", f"{src}-mark").trigger(availableNow=True).start()
        q.awaitTermination(90)
    latest = {}
    for s in seen:
        latest |= s
    assert latest == {"1": ("instituted", False), "2": ("found_infringed", False)}
    assert any(s.get("1") == ("withdrawn", True) for s in seen)
    assert incremental.once(spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int"), ["k"], "n").count() == 1
