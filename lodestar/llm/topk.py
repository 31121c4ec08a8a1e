"""Exact top-k search by inner product, with MaxScore.

A query's terms are its dimensions. Within a shard of candidates every dimension has a least and a largest
contribution to the query's score; counted from the least, contributions are non-negative and a dimension's
bound is the spread between the two. With a threshold that some k candidates are known to reach, the
dimensions of smallest bound are non-essential as long as their bounds together can't reach it. The essential
dimensions' postings are traversed for all candidates of the shard; the others are probed, in order of falling
bound, only for candidates that can still reach the threshold, which rises as scores complete. Shards give
their k best and are merged by (score descending, id ascending).

Queries and candidates meet in blocks of bounded size: shards of about BLOCK candidates and blocks of
about QUERIES queries (both dealt by hash), so memory does not depend on the table or on repeated vectors.

Defined results: vectors that are null or hold null or non-finite components take no part, as queries or
candidates; scaled components beyond 2**26 either way count as that, so that every score fits 64 bits; of vectors of unequal length the missing components count as zero; a candidate with the query's
id is the query's own row; rows repeated exactly are one query but several candidates; a row with null id is no
query, and as a candidate it comes after others of its score; with fewer candidates than k all are returned;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import read_table

BLOCK = 8192
QUERIES = 1024
CHUNK = 8
MOST = 2.0**26
NO_ID = np.iinfo(np.int64).max


def quantized(rows: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """id and v (little-endian 64-bit integers) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    x = np.clip(np.floor(scale * x), -MOST, MOST)
                    ids.append(i.as_py())
                    out.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])

    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "id long, v binary")


def matrix(values, width: int) -> np.ndarray:
    out = np.zeros((len(values), width), dtype=np.int64)
    for i, v in enumerate(values):
        row = np.frombuffer(v, dtype="<i8")
        out[i, : len(row)] = row
    return out


class Shard:
    """Candidates, laid out by dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.low, self.high = ids[order], vectors.min(axis=0), vectors.max(axis=0)
        self.largest = int(np.abs(vectors).max(initial=0))
        self.postings = np.ascontiguousarray(vectors[order].T)
        self.floats = self.postings.astype(np.float64)

    def _partial(self, query: np.ndarray, dims: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        """Contributions of some dimensions, exact: in doubles where they hold every sum."""
        if self.largest * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 2**52:
            part = self.floats[dims] if rows is None else self.floats[np.ix_(dims, rows)]
            return (query[dims].astype(np.float64) @ part).astype(np.int64)
        part = self.postings[dims] if rows is None else self.postings[np.ix_(dims, rows)]
        return query[dims] @ part

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, by score and then id."""
        n = len(self.ids)
        mine = np.flatnonzero(self.ids == own)
        ends = np.stack([query * self.low, query * self.high])
        least, spread = ends.min(axis=0), np.abs(ends[1] - ends[0])
        dims = np.argsort(-spread, kind="stable")
        rest = np.concatenate((np.cumsum(spread[dims][::-1])[::-1], [0]))  # bound of the dimensions from here on
        below = np.concatenate((np.cumsum(least[dims][::-1])[::-1], [0]))
        # a first threshold, from rows spread over the shard
        seeds = np.unique(np.linspace(0, n - 1, min(n, 4 * k)).astype(int))
        seeds = seeds[~np.isin(seeds, mine)]
        floor = None
        if len(seeds) >= k:
            first = self._partial(query, dims, seeds)
            floor = int(np.partition(first, len(first) - k)[len(first) - k])
        # non-essential: the smallest bounds that cannot reach the threshold without the others
        split = len(dims)
        if floor is not None:
            split = int(np.searchsorted(-rest, -(floor - int(least.sum())), side="left"))
            split = min(len(dims), max(split, 1))
        alive = None
        score = self._partial(query, dims[:split], None)
        at = split
        if len(mine):
            alive = np.delete(np.arange(n), mine)
            score = score[alive]
        while True:
            reach = score + (rest[at] + below[at])
            if len(score) > k:
                # those with the best partial sums are completed: k of them reach the new threshold
                top = np.argpartition(reach, len(reach) - k)[-k:]
                rows = top if alive is None else alive[top]
                done = score[top] + (self._partial(query, dims[at:], rows) if at < len(dims) else 0)
                floor = int(done.min()) if floor is None else max(floor, int(done.min()))
                keep = np.flatnonzero(reach >= floor)
                if len(keep) < len(score):
                    score = score[keep]
                    alive = keep if alive is None else alive[keep]
            if at >= len(dims):
                break
            now = dims[at : at + CHUNK]
            score = score + self._partial(query, now, alive)
            at += len(now)
        rows = np.arange(n) if alive is None else alive
        order = np.lexsort((rows, -score))[:k]  # rows stand in order of their ids
        return self.ids[rows[order]], score[order]


def search(rows: DataFrame, key: str, vector: str, is_query, k: int = 20, scale: int = 64, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that is_query (a Column) selects."""
    asked = rows.filter(is_query & F.col(key).isNotNull())
    counts = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(asked.agg(F.count(F.lit(1)).alias("q"))).first()
    shards, blocks = max(1, -(-counts.n // block)), max(1, -(-counts.q // queries))
    cells = shards * blocks
    # of rows repeated exactly no more than k can be in a result
    some = quantized(rows, key, vector, scale).groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("c"))
    cand = some.select("id", "v", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("copy")).drop("copy").withColumn("s", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ask = quantized(asked, key, vector, scale).distinct().withColumn("b", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(max(map(len, left.v)), max(map(len, right.v))) // 8
            asks = matrix(right.v, width)
            ids = right.id.to_numpy()
            shard = Shard(left.id.astype("Int64").fillna(NO_ID).to_numpy(dtype=np.int64), matrix(left.v, width))
            for i in range(len(asks)):
                found, score = shard.best(int(ids[i]), asks[i], k)
                out.append(pd.DataFrame({"query_id": [int(ids[i])] * len(found), "v": [right.v.iloc[i]] * len(found), "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "v": [], "vec_id": [], "score": []})

    met = cand.repartition(cells, "s", "b").groupBy("s", "b").cogroup(ask.groupBy("s", "b")).applyInPandas(meet, "query_id long, v binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != F.lit(int(NO_ID)), F.col("vec_id")).alias("vec_id"), "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return search(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 20
"""
