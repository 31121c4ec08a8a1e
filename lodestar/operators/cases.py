"""Stage rows folded into cases, differences between snapshots, and what happens to cases that the feed drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIMARY = "Violation"


def stages(flat: DataFrame) -> DataFrame:
    """number, stage struct (ordered by start, then id), from flattened rows."""
    f = lambda name: F.col("fields")[name]
    order = F.struct(F.coalesce(f("start_date"), F.lit("")).alias("start"), F.coalesce(f("investigation_id").try_cast("bigint"), F.lit(0)).alias("id"))
    return flat.select("number", F.struct(order.alias("ord"), f("investigation_id").alias("stage_id"), f("investigation_phase").alias("phase"), f("phase_number").alias("phase_number"), f("investigation_status").alias("status"), f("start_date").alias("start_date"), f("investigation_end_date").alias("end_date"), F.col("fields"), F.col("lists")).alias("stage"))


def _title(stage: Column) -> Column:
    full = F.trim(stage["fields"]["full_title"])
    cut = F.trim(F.substring_index(F.substring_index(full, "; Inv. No.", 1), ", Inv. No.", 1))
    return F.coalesce(F.nullif(stage["fields"]["topic"], F.lit("")), F.nullif(cut, F.lit("")), F.nullif(full, F.lit("")))


def fold(flat: DataFrame, snapshot_day: str | None = None) -> DataFrame:
    """One row a case. Stages are few a case; they are gathered in their order by the aggregate."""
    s = stages(flat)
    # equal starts and ids are ordered by content, so that the fold does not depend on the order of rows
    s = s.withColumn("stage", F.col("stage").withField("ord", F.struct(F.col("stage.ord.start"), F.col("stage.ord.id"), F.xxhash64(F.map_values(F.col("stage")["fields"])).alias("h"))))
    earlier = lambda x, y: F.when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0)
    grouped = s.groupBy("number").agg(F.array_sort(F.collect_list("stage"), earlier).alias("stages"))
    primary = F.coalesce(F.get(F.filter("stages", lambda x: x["phase"] == PRIMARY), 0), F.get("stages", 0))
    case = grouped.withColumn("p", primary).withColumn("c", F.element_at("stages", -1))
    starts = F.array_min(F.filter(F.transform("stages", lambda x: x["start_date"]), lambda d: d.isNotNull()))
    return case.select(
        "number", F.coalesce(_title(F.col("p")), _title(F.col("c")), F.col("number")).alias("title"), F.coalesce(F.col("p")["fields"]["docket_number"], F.col("c")["fields"]["docket_number"]).alias("docket_number"),
        F.col("p")["fields"]["official_investigation_number"].alias("official_number"), F.coalesce(F.col("c.status"), F.col("p.status")).alias("status"), F.col("c.phase").alias("phase"),
        F.coalesce(F.col("p.start_date"), F.substring(starts, 1, 10), F.col("p")["fields"]["initiating_document_received_date"]).alias("date_initiated"), F.col("c.end_date").alias("date_ended"),
        F.filter(F.transform("stages", lambda x: x["phase"]), lambda x: x.isNotNull()).alias("phases"), F.size("stages").alias("stage_count"), F.col("p.stage_id").alias("primary_stage"), F.col("c.stage_id").alias("current_stage"),
        F.lit(snapshot_day).alias("snapshot"), F.lit(False).alias("withdrawn"), "stages",
    )


def _content(cases: DataFrame, ignore: tuple[str, ...]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in cases.columns if c not in ignore])))


def diff(before: DataFrame, after: DataFrame, ignore: tuple[str, ...] = ("snapshot", "withdrawn")) -> DataFrame:
    """number, change (added, removed, status, changed) by comparing two tables of cases."""
    side = lambda df, x: df.select("number", F.col("status").alias(f"{x}_status"), _content(df, ignore).alias(f"{x}_hash"), F.lit(True).alias(x))
    both = side(before, "b").join(side(after, "a"), "number", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("b_status").eqNullSafe(F.col("a_status")), "status").when(F.col("b_hash") != F.col("a_hash"), "changed")
    return both.select("number", change.alias("change"), "b_status", "a_status").filter("change IS NOT NULL")


class SuspectSnapshot(RuntimeError):
    """Too many cases are gone from the feed at once."""


def check_removals(before: DataFrame, after: DataFrame, allow: bool = False, least: int = 10, share: float = 0.02) -> tuple[int, int]:
    """(removed, listed); raises if more than `least` and more than `share` of the listed cases are gone."""
    gone = before.join(after, "number", "left_anti")
    listed = before.filter(~F.coalesce("withdrawn", F.lit(False))).agg(F.count(F.lit(1)).alias("n")).first().n
    removed = gone.filter(~F.coalesce("withdrawn", F.lit(False))).agg(F.count(F.lit(1)).alias("n")).first().n
    if not allow and removed > least and removed > share * listed:
        raise SuspectSnapshot(f"{removed} of {listed} cases are gone")
    return removed, listed


def carry_withdrawn(before: DataFrame, after: DataFrame) -> DataFrame:
    """The new cases, and those the feed no longer lists, with their last content and a flag."""
    return after.unionByName(before.join(after.select("number"), "number", "left_anti").withColumn("withdrawn", F.lit(True)))


def migrate_dockets(documents: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents listed under a docket number move to the case the docket became: '337-' + docket -> its number, if
    the docket's key is gone from the feed and the new number was not there before."""
    new = after.join(before.select("number"), "number", "left_anti").filter("docket_number IS NOT NULL")
    moves = new.select(F.concat(F.lit("337-"), "docket_number").alias("key"), F.col("number").alias("to")).join(after.select(F.col("number").alias("key")), "key", "left_anti")
    return documents.join(moves, "key", "left").withColumn("key", F.coalesce("to", "key")).drop("to")


def participants(cases: DataFrame) -> DataFrame:
    """number, name, role, first (place of the first mention): distinct parties of a case, first wins."""
    each = cases.select("number", F.posexplode("stages").alias("s", "stage")).select("number", "s", F.posexplode(F.col("stage")["lists"]["participants"]).alias("i", "p"))
    key = [F.lower(F.trim(F.coalesce(F.col("p")[k], F.lit("")))).alias(k) for k in ("name", "role")]
    return each.groupBy("number", *[k.alias(f"k_{n}") for k, n in zip(key, ("name", "role"))]).agg(F.min(F.struct("s", "i")).alias("first"), F.min_by(F.col("p")["name"], F.struct("s", "i")).alias("name"), F.min_by(F.col("p")["role"], F.struct("s", "i")).alias("role")).drop("k_name", "k_role")
