"""Dated snapshots of the feed: storing, listing, reading, daily sync and retention.

A snapshot is one gz JSON text {date, count, data: [row]}; its name carries the UTC stamp. Folders are reached
through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import gzip
import json
import re
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"^snapshot-(\d{4}-\d{2}-\d{2})T(\d{6})Z\.json\.gz$")
WAITS = (10, 30)


class BadSnapshot(RuntimeError):
    pass


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def names(spark: SparkSession, folder: str) -> list[str]:
    """Snapshot names, oldest first; other files are no snapshots."""
    fs, path = _fs(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in found if NAME.match(n))


def latest(spark: SparkSession, folder: str, day: str | None = None) -> str | None:
    return max((n for n in names(spark, folder) if day is None or NAME.match(n)[1] == day), default=None)


def valid(raw: bytes) -> dict:
    try:
        payload = json.loads(raw)
    except ValueError as e:
        raise BadSnapshot("no JSON") from e
    if not isinstance(payload, dict) or not isinstance(payload.get("data"), list):
        raise BadSnapshot("no list of rows")
    return payload


def store(spark: SparkSession, folder: str, raw: bytes, now: datetime | None = None) -> str:
    """Check and write a snapshot: to a temporary name, then renamed, so no reader sees a part."""
    valid(raw)
    name = f"snapshot-{(now or datetime.now(timezone.utc)):%Y-%m-%dT%H%M%S}Z.json.gz"
    fs, path = _fs(spark, folder)
    fs.mkdirs(path)
    part, done = (spark._jvm.org.apache.hadoop.fs.Path(path, n) for n in (f".{name}.part", name))
    out = fs.create(part, True)
    out.write(bytearray(gzip.compress(raw)))
    out.close()
    if not fs.rename(part, done):
        raise BadSnapshot(f"{name} is there already")
    return name


def rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The snapshot's rows as JSON texts (column row); what is no object goes. A broken file fails, never reads empty."""
    whole = spark.read.text(f"{folder}/{name}", wholetext=True)
    parsed = whole.select(F.parse_json("value").alias("v"))
    each = parsed.select(F.explode(F.variant_get("v", "$.data", "array<variant>")).alias("r"))
    return each.filter(F.schema_of_variant("r").startswith("OBJECT")).select(F.to_json("r").alias("row"))


def in_category(flat: DataFrame, category: str, prefix: str) -> DataFrame:
    """Flattened rows of a category, or without categories those whose number has the prefix."""
    listed = F.col("lists")["investigation_categories"]
    return flat.filter(F.when(listed.isNotNull(), F.exists(listed, lambda c: c["name"] == category)).otherwise(F.startswith("number", F.lit(prefix))))


def fetch(download: Callable[[], bytes], wait: Callable[[float], None] = time.sleep) -> bytes:
    """Download with retries after network errors and invalid JSON."""
    for pause in (*WAITS, None):
        try:
            raw = download()
            valid(raw)
            return raw
        except (OSError, BadSnapshot):
            if pause is None:
                raise
            wait(pause)
    raise AssertionError


def sync(spark: SparkSession, folder: str, download: Callable[[], bytes], force: bool = False, keep: int = 0, now: datetime | None = None, wait: Callable[[float], None] = time.sleep) -> tuple[str, bool]:
    """(name, downloaded): today's snapshot, downloaded unless it is there; then old days go."""
    now = now or datetime.now(timezone.utc)
    have = latest(spark, folder, f"{now:%Y-%m-%d}")
    if have and not force:
        return have, False
    name = store(spark, folder, fetch(download, wait), now)
    prune(spark, folder, keep)
    return name, True


def prune(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Keep the newest days (not files); 0 or less keeps all."""
    have = names(spark, folder)
    days = sorted({NAME.match(n)[1] for n in have}, reverse=True)
    gone = [n for n in have if keep > 0 and NAME.match(n)[1] not in days[:keep]]
    fs, path = _fs(spark, folder)
    for n in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, n), False)
    return gone
