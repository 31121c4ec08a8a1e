"""python -m lodestar COMMAND: a thin driver over the library.

queries                          names of the registered queries
run NAME SF_DIR [OUT]            run a query over a folder of tables; show it, or write it as Parquet
explain NAME SF_DIR              its plan
sync FOLDER FILE                 store today's snapshot of the feed from a file, unless it is there
parse FOLDER OUT                 fold the latest snapshot into cases, with the guard on removals, and swap them in
prune FOLDER DAYS                keep the newest days' snapshots
fields CASES                     fields of the cases, and the share of cases that have them
status CASES                     cases by status
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.operators import cases, fields
from lodestar.operators.flatten import flatten
from lodestar.plans.registry import QUERIES
from lodestar.session import ship
from lodestar.sinks.tables import append_log, load, swap
from lodestar.sources import snapshots


def parse(spark: SparkSession, folder: str, out: str, allow: bool = False) -> dict:
    """The latest snapshot as cases under OUT/cases: withdrawn ones carried, a run logged even if it is refused."""
    name = snapshots.latest(spark, folder)
    if name is None:
        raise SystemExit("no snapshot stored")
    ship(spark)
    new = cases.fold(flatten(snapshots.rows(spark, folder, name)), snapshots.NAME.match(name)[1])
    report = {"snapshot": name, "removed": 0, "error": None}
    try:
        old = load(spark, f"{out}/cases", new.schema)
        if old is not None:
            report["removed"] = cases.check_removals(old, new, allow)[0]
            new = cases.carry_withdrawn(old, new)
        swap(new, f"{out}/cases")
    except cases.SuspectSnapshot as e:
        report["error"] = str(e)
        raise
    finally:
        append_log(spark.createDataFrame([tuple(report.values())], "snapshot string, removed long, error string"), f"{out}/log")
    return report


def main(argv: list[str]) -> int:
    if not argv or argv[0] in ("-h", "--help"):
        print(__doc__)
        return 0
    command, *args = argv
    if command == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    if command in ("run", "explain"):
        df = QUERIES[args[0]](spark, args[1])
        if command == "explain":
            df.explain("formatted")
        elif len(args) > 2:
            df.write.parquet(args[2])
        else:
            df.show(50, truncate=False)
    elif command == "sync":
        print(*snapshots.sync(spark, args[0], Path(args[1]).read_bytes))
    elif command == "parse":
        print(parse(spark, *args[:2], allow="--allow-removals" in args))
    elif command == "prune":
        print(*snapshots.prune(spark, args[0], int(args[1])), sep="\n")
    elif command == "fields":
        fields.sources(spark.read.parquet(args[0])).orderBy(F.desc("cases"), "source").show(500, truncate=60)
    elif command == "status":
        spark.read.parquet(args[0]).groupBy("status", "withdrawn").count().orderBy(F.desc("count")).show()
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
