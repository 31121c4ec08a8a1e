"""Exact dedup over an extendible-hash index kept on shared files; DataFrame functions only.

A text's key is its 64-bit hash. Buckets are found by splitting: a bucket (the keys that share their first bits)
that holds more than `capacity` distinct keys is split by one more bit, and the directory doubles until it is as
deep as the deepest bucket. The directory is a table of cells, one for each value of that many first bits, so it
grows with the keys: at most 2 ** SPREAD cells for each bucket's worth of keys. Only hashes far from random could
leave more than `capacity` keys in a cell then; such a bucket stays overfull, and results are the same. Only the
directory's depth and its number of cells come to the driver.

Every text is routed by its cell to a bucket, and grouped there by (bucket, key, bytes), copies summed before
anything is shuffled. Owner tasks take ranges of (bucket, key), chain the distinct texts of a key and write the
entries to the shared folder. A row is looked up under its bucket and key. Where a key has one entry, all its
texts were found equal byte for byte and the entry is the row's; where a chain is longer, the bytes of row and
chain are compared in the bucket.

Hot texts: an entry that holds more than one in HOT of all rows (there are fewer than HOT such entries, whatever the
input) is broadcast, so its rows stay where they are; all other keys are joined by bucket and key.

Defined results: null text counts as empty and equals it; texts are compared as they are; of equal texts
the largest id stays (a null id is the smallest; if the largest id is on several equal rows each of them
says kept in class_of, and drop_copies keeps one); other columns never matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialize, read_table, text_or_empty

CAPACITY = 1 << 16
HOT = 10_000
#: The largest directory that is broadcast, in cells of 16 bytes; a larger one is joined by cell.
CELLS = 1 << 17
SPREAD = 12


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def prefix(key: Column, bits: int) -> Column:
    """The first bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


@dataclass(frozen=True)
class Directory:
    """cells: cell, bucket; a bucket is named by its first cell at the depth of the counts."""

    cells: DataFrame
    depth: int
    size: int

    def route(self, rows: DataFrame) -> DataFrame:
        """rows (with key) and the bucket that the directory gives each."""
        cells = F.broadcast(self.cells) if self.size <= CELLS else self.cells
        return rows.withColumn("cell", prefix(F.col("key"), self.depth)).join(cells, "cell").drop("cell")


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """The directory over distinct keys (column key) in which no bucket has more than `capacity` of them."""
    if capacity < 4:
        raise ValueError("a bucket holds at least four keys")
    n = keys.count()
    least = math.ceil(math.log2(n / capacity)) if n > capacity else 0
    bits, deepest = least + 3 if least else 0, least + SPREAD
    while True:
        counts = materialize(keys.groupBy(prefix(F.col("key"), bits).alias("p")).agg(F.count(F.lit(1)).alias("n")), "extendible-counts")
        if bits == deepest or counts.filter(F.col("n") > capacity).isEmpty():
            break
        bits = min(deepest, bits + 4)
    # the keys under every prefix of every length, then the buckets: prefixes that fit whose parent does not
    each = counts.select(F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("local"), "p", "n")
    sums = each.groupBy("local", F.expr(f"shiftrightunsigned(p, {bits} - local)").alias("p")).agg(F.sum("n").alias("n"))
    fits = (F.col("n") <= capacity) | (F.col("local") == bits)
    overfull = sums.filter(~fits).select((F.col("local") + 1).alias("local"), F.col("p").alias("parent"))
    split = sums.filter(fits & (F.col("local") > 0)).withColumn("parent", F.shiftrightunsigned("p", 1)).join(overfull, ["local", "parent"], "left_semi")
    buckets = materialize(split.select("local", "p").union(sums.filter(fits & (F.col("local") == 0)).select("local", "p")), "extendible-buckets")
    depth = buckets.agg(F.max("local").alias("d")).first().d or 0
    first = lambda p: F.expr(f"shiftleft({p}, {depth} - local)")
    cells = buckets.select(F.explode(F.sequence(first("p"), first("(p + 1)") - 1)).alias("cell"), F.expr(f"shiftleft(p, {bits} - local)").alias("bucket"))
    cells = materialize(cells, "extendible-directory")
    return Directory(cells, depth, cells.count())


@dataclass(frozen=True)
class Index:
    """entries: bucket, key, chain, sha, n_bytes, keep_id, copies, in files by ranges of (bucket, key)."""

    entries: DataFrame
    directory: Directory
    rows: int


def build_index(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = key_of) -> Index:
    """The index over the texts of docs, written to the shared folder."""
    body = text_or_empty(F.col(text))
    rows = docs.select(F.col(key).alias("id"), hashed(body).alias("key"), body.alias("body"))
    directory = build_directory(materialize(rows.select("key").distinct(), "extendible-keys"), capacity)
    # equal bytes under one key of one bucket
    grouped = directory.route(rows).groupBy("bucket", "key", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    entries = grouped.select("bucket", "key", F.sha2("body", 256).alias("sha"), F.octet_length("body").alias("n_bytes"), "keep_id", "copies")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha"))
    owned = entries.repartitionByRange("bucket", "key").withColumn("chain", chain).sortWithinPartitions("bucket", "key", "chain")
    entries = materialize(owned, "extendible-index")
    return Index(entries, directory, entries.agg(F.sum("copies").alias("n")).first().n or 0)


def look_up(rows: DataFrame, index: Index) -> DataFrame:
    """rows (id, key, body and others) without body, with keep_id, copies and sha of the entry that holds their bytes."""
    names = [c for c in rows.columns if c not in ("key", "body")]
    routed = index.directory.route(rows)
    chained = index.entries.filter("chain > 1").select("bucket", "key").distinct()
    one = index.entries.select("bucket", "key", "keep_id", "copies", "sha")
    collide = not chained.isEmpty()
    if collide:
        one = one.join(chained, ["bucket", "key"], "left_anti")
    hot = F.col("copies") * HOT > index.rows
    marked = routed.drop("body").join(F.broadcast(one.filter(hot)), ["bucket", "key"], "left")  # fewer than HOT entries
    cold = marked.filter("copies IS NULL").drop("keep_id", "copies", "sha").join(one.filter(~hot), ["bucket", "key"])
    found = marked.filter("copies IS NOT NULL").select(*names, "keep_id", "copies", "sha").union(cold.select(*names, "keep_id", "copies", "sha"))
    if collide:  # several texts under one key: the chain's bytes decide
        theirs = routed.join(chained, ["bucket", "key"], "left_semi")
        chain = theirs.groupBy("bucket", "key", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
        found = found.union(theirs.join(chain, ["bucket", "key", "body"]).select(*names, "keep_id", "copies", F.sha2("body", 256).alias("sha")))
    return found


def class_of(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = key_of) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, key, text, capacity, hashed)
    body = text_or_empty(F.col(text))
    found = look_up(docs.select(F.col(key).alias("id"), hashed(body).alias("key"), body.alias("body")), index)
    return found.select("id", "keep_id", F.col("copies").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = key_of) -> DataFrame:
    """The rows of docs that stay, all columns as they were; of rows equal in id and text one stays."""
    index = build_index(docs, key, text, capacity, hashed)
    body = text_or_empty(F.col(text))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("id"), hashed(body).alias("key"), body.alias("body"))
    stay = look_up(rows, index).filter(F.col("id").eqNullSafe(F.col("keep_id")))
    # only rows that share an id can be equal in both
    return stay.groupBy("sha", F.to_json(F.struct("id")).alias("name")).agg(F.first("row").alias("row")).select("row.*")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = class_of(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id")


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
