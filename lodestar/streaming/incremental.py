"""Incremental forms: snapshots as a file stream merged batch by batch, process-once caches, stateful replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.sinks import tables


def merge_stream(spark: SparkSession, folder: str, schema: str, table: str, key: str, checkpoint: str, buckets: int = 64):
    """New Parquet files of a folder merged into a bucketed table by key; runs over what is there, then stops.

    The newest `ord` wins, of equal ones the row that is largest as JSON. A batch rewrites the buckets its keys fall into
    and no others; `tables.load_buckets` reads the table, whose number of buckets never changes. The checkpoint makes
    it resume where it stopped, and a repeated batch changes nothing."""

    def batch(df: DataFrame, epoch: int) -> None:
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
        touched = [r.b for r in df.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` rows
        if touched:
            others = [c for c in df.columns if c != key]
            newest = F.struct("ord", F.to_json(F.struct(*others)))
            both = tables.load_buckets(spark, table, df.schema, touched).unionByName(df)
            merged = both.groupBy(key).agg(F.max_by(F.struct(*others), newest).alias("r")).select(key, "r.*").select(df.columns)
            tables.swap_buckets(merged, bucket, table)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(df: DataFrame, key: list[str], at: str, keep: str = "7 days") -> DataFrame:
    """Each key once within the time kept: on a stream by state, on a table by the first row."""
    return df.withWatermark(at, keep).dropDuplicatesWithinWatermark(key) if df.isStreaming else df.dropDuplicates(key)


OUT = "claim string, status string, left boolean, events long"
LEAVES = frozenset(("withdrawn", "terminated_settlement"))


def replay(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One claim's state as its events come: an exit blocks what follows, an addition brings the claim back."""
    status, left, n = state.get if state.exists else (None, False, 0)
    for batch in batches:
        for action in batch.sort_values(["at", "id"]).action:
            n += 1
            if action == "added":
                status, left = "instituted", False
            elif not left:
                status, left = action, action in LEAVES
    state.update((status, left, n))
    yield pd.DataFrame({"claim": [key[0]], "status": [status], "left": [left], "events": [n]})


def replay_stream(events: DataFrame) -> DataFrame:
    """events: claim, id, at, action -> each claim's latest state."""
    return events.groupBy("claim").applyInPandasWithState(replay, OUT, "status string, left boolean, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and type; late ones beyond the watermark are left out. An extra, for streams of filings."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
