"""Sinks: swap-on-success tables, changed partitions only, logs that turn over when their columns change."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column by which swap_buckets() lays out its files.
BUCKET = "in_bucket"


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of a table's versions, and of those that were written to the end, newest first."""
    fs, at = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = sorted((int(n[1:]) for n in names if re.fullmatch("v[0-9]+", n)), reverse=True)
    return found, [n for n in found if fs.exists(_fs(spark, f"{path}/v{n}/_SUCCESS")[1])]


def _delete(spark: SparkSession, folder: str) -> None:
    fs, at = _fs(spark, folder)
    fs.delete(at, True)


def swap(df: DataFrame, path: str) -> None:
    """Write the table's next version, which load() takes up with its success marker: a failure at any point leaves
    the last good one. One version before it is kept for those who still read it. One writer at a time."""
    spark = df.sparkSession
    new = max(_versions(spark, path)[0], default=0) + 1
    df.write.parquet(f"{path}/v{new}")
    found, complete = _versions(spark, path)
    for n in found:
        if n < new and n not in complete[:2]:
            _delete(spark, f"{path}/v{n}")


def load(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The version that swap() last wrote to the end; None if there is none."""
    complete = _versions(spark, path)[1]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/v{complete[0]}") if complete else None


def _bucket_folders(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """Of each bucket the folders that hold it, newest first."""
    out: dict[int, list[str]] = {}
    for n in _versions(spark, path)[1]:
        fs, at = _fs(spark, f"{path}/v{n}")
        for name in (s.getPath().getName() for s in fs.listStatus(at)):
            if name.startswith(f"{BUCKET}="):
                out.setdefault(int(name.split("=")[1]), []).append(f"{path}/v{n}/{name}")
    return out


def swap_buckets(df: DataFrame, bucket: Column, path: str) -> None:
    """Write the buckets that df has rows of, each whole, as one version; the others stay as they are. What swap()
    says of failures and readers holds for each bucket."""
    spark = df.sparkSession
    new = max(_versions(spark, path)[0], default=0) + 1
    df.withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/v{new}")
    folders = _bucket_folders(spark, path)
    for old in (f for held in folders.values() for f in held[2:]):
        _delete(spark, old)
    live = {f.rsplit("/", 2)[1] for held in folders.values() for f in held[:2]}
    for n in _versions(spark, path)[0]:
        if n < new and f"v{n}" not in live:
            _delete(spark, f"{path}/v{n}")


def load_buckets(spark: SparkSession, path: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """The newest rows of the buckets (all, if none are named); without any the empty table."""
    held = _bucket_folders(spark, path)
    folders = [f[0] for b, f in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def fingerprint(df: DataFrame, key: str):
    """One hash for all rows of a key, whatever their order."""
    return df.groupBy(key).agg(F.sum(F.xxhash64(F.to_json(F.struct(*[c for c in sorted(df.columns) if c != key]))).cast("decimal(38,0)")).cast("string").alias("print"))


def save_changed(df: DataFrame, previous: DataFrame | None, key: str, path: str, buckets: int = 16) -> list[int]:
    """Rewrite only the buckets in which some key's rows changed, came or went; returns their numbers."""
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    if previous is None:
        changed = list(range(buckets))
    else:
        a, b = fingerprint(df, key), fingerprint(previous.select(df.columns), key).withColumnRenamed("print", "was")
        moved = a.join(b, key, "full_outer").filter(~F.col("print").eqNullSafe(F.col("was")))
        changed = sorted(r.b for r in moved.select(bucket.alias("b")).distinct().collect())  # at most `buckets` rows
    if changed:
        rows = df.withColumn("bucket", bucket).filter(F.col("bucket").isin(changed))
        fs, _ = _fs(spark, path)
        # a bucket whose keys are all gone is not written, so it is cleared first
        present = {r.bucket for r in rows.select("bucket").distinct().collect()}
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        for b in set(changed) - present:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}"), True)
    return changed


def append_log(df: DataFrame, path: str) -> str:
    """Append to a CSV log; if its columns differ the log goes on in a new version. Returns the folder written."""
    spark, n = df.sparkSession, 1
    while True:
        at = path if n == 1 else f"{path}.v{n}"
        fs, folder = _fs(spark, at)
        if not fs.exists(folder) or spark.read.csv(at, header=True).columns == df.columns:
            df.coalesce(1).write.mode("append").csv(at, header=True)
            return at
        n += 1


def repoint(documents: DataFrame, moves: DataFrame) -> DataFrame:
    """Documents under their new keys (moves: key, to), links in their attachments following."""
    links = F.transform("attachments", lambda a: F.struct(F.replace(a["href"], F.concat(F.lit("/"), F.col("key"), F.lit("/")), F.concat(F.lit("/"), F.col("to"), F.lit("/"))).alias("href"), a["label"].alias("label")))
    both = documents.join(moves, "key", "left")
    return both.withColumn("attachments", F.when(F.col("to").isNotNull(), links).otherwise(F.col("attachments"))).withColumn("key", F.coalesce("to", "key")).drop("to").select(documents.columns)


def upsert_pairs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Human decisions on pairs: the newest for each unordered pair. Columns a, b, verdict, ord."""
    both = existing.unionByName(new).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    return both.groupBy("lo", "hi").agg(F.max_by("verdict", "ord").alias("verdict"), F.max("ord").alias("ord")).select(F.col("lo").alias("a"), F.col("hi").alias("b"), "verdict", "ord")
