"""Docket listings: a paged reader behind a Python data source, case files, and logs."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = ("id", "documentType", "documentTitle", "securityLevel", "filedBy", "onBehalfOf", "firmOrganization", "documentDate", "officialReceivedDate")
MOST_PAGES = 1000
LOG = "started string, mode string, snapshot string, rows long, cases long, added long, removed long, changed long, seconds double, error string"


def text_of(element) -> str | None:
    """Trimmed text of an XML element, unescaped once more; blank is null."""
    return html.unescape((element.text or "").strip()) or None


def xml_rows(page: str, tag: str = "document") -> list[dict]:
    return [{child.tag: text_of(child) for child in row} for row in ElementTree.fromstring(page).iter(tag)]


def pages(get: Callable[[str, int], str], number: str, known: frozenset[str] = frozenset(), most: int = MOST_PAGES) -> Iterator[dict]:
    """Rows newest first, until a page is empty or, with known ids, all known."""
    for i in range(1, most + 1):
        rows = xml_rows(get(number, i))
        if not rows:
            return
        yield from rows
        if known and all(r.get("id") in known for r in rows):
            return


def spellings(number: str) -> list[str]:
    """Spellings of a number to try, in order."""
    serial = re.sub(r"^.*-", "", number)
    return list(dict.fromkeys([number, f"337-TA-{serial}", serial]))


class DocketSource(DataSource):
    """spark.read.format('docket').options(numbers='a,b', pages='<folder of number/page.xml>')

    One partition a case, so cases are read in parallel and a lost executor repeats its own. The pages come from a
    folder here; a networked client subclasses get()."""

    @classmethod
    def name(cls) -> str:
        return "docket"

    def schema(self) -> str:
        return "number string, " + ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema) -> DataSourceReader:
        return DocketReader(self.options)


class DocketReader(DataSourceReader):
    def __init__(self, options):
        self.numbers = [n for n in options["numbers"].split(",") if n]
        self.folder, self.known = options["pages"], frozenset(filter(None, options.get("known", "").split(",")))

    def partitions(self):
        return [InputPartition(n) for n in self.numbers]

    def get(self, number: str, page: int) -> str:
        from pathlib import Path

        at = Path(self.folder) / number / f"{page}.xml"
        return at.read_text() if at.exists() else "<documents/>"

    def read(self, partition):
        for spelling in spellings(partition.value):
            found = False
            for row in pages(self.get, spelling, self.known):
                found = True
                yield (partition.value, *(row.get(c) for c in COLUMNS))
            if found:
                return


def case_files(spark: SparkSession, folder: str) -> DataFrame:
    """key and documents of per-case JSON files; unreadable files are skipped. The key is the file's name."""
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("key"), F.try_parse_json("value").alias("v"))
    return raw.filter("v IS NOT NULL").select("key", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("d")).select("key", F.try_variant_get("d", "$.id", "string").alias("id"), F.to_json("d").alias("document"))


def merged(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """New rows, and the earlier ones that they don't replace (by key and id)."""
    return fresh.unionByName(previous.join(fresh.select("key", "id"), ["key", "id"], "left_anti"), allowMissingColumns=True)


def run_log(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    df = spark.read.csv(path, header=True, schema=LOG)
    return df.orderBy(F.desc("started")).limit(last) if last else df


def load_json(path: str, default):
    """A driver-side JSON file, or the default if it is missing or broken."""
    try:
        with open(path) as f:
            return json.load(f)
    except (OSError, ValueError):
        return default
