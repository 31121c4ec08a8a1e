"""Star-schema export with positions for ids, and the report on merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(entities: DataFrame) -> DataFrame:
    """entities (id, name, cases) with ix: place by cases, most first, then lower-case name, then id; from 0.

    The order is total over a dimension, so it is numbered in two steps: places within each number of cases, and the
    count of entities with more cases, which is one row a number."""
    by = Window.partitionBy("cases").orderBy(F.lower("name"), "id")
    sizes = entities.groupBy("cases").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("cases")).rowsBetween(Window.unboundedPreceding, -1))).select("cases", F.coalesce("before", F.lit(0)).alias("before"))
    return entities.withColumn("r", F.row_number().over(by)).join(before, "cases").select(*entities.columns, (F.col("before") + F.col("r") - 1).alias("ix"))


def case_positions(numbers: DataFrame) -> DataFrame:
    """number, ix: case numbers in the order of their numeric parts."""
    parts = F.transform(F.regexp_extract_all("number", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint"))
    return numbers.select("number").distinct().withColumn("ix", F.row_number().over(Window.orderBy(parts, "number")) - 1)


def facts(reps: DataFrame, firms: DataFrame, companies: DataFrame, cases: DataFrame) -> DataFrame:
    """reps (case, firm, companies array, side) by positions: unknown firms -1, unknown companies and cases dropped."""
    f = firms.select(F.col("id").alias("firm"), F.col("ix").alias("firm_ix"))
    c = companies.select(F.col("id").alias("company"), F.col("ix").alias("company_ix"))
    k = cases.select(F.col("number").alias("case"), F.col("ix").alias("case_ix"))
    base = reps.withColumn("rep", F.xxhash64("case", "firm", "side"))
    held = base.select("rep", F.explode("companies").alias("company")).join(c, "company").groupBy("rep").agg(F.array_sort(F.collect_set("company_ix")).alias("companies"))
    return base.drop("companies").join(k, "case").join(f, "firm", "left").join(held, "rep", "left").select("case_ix", F.coalesce("firm_ix", F.lit(-1)).alias("firm_ix"), "side", F.coalesce("companies", F.array().cast("array<bigint>")).alias("companies"))


def merges_by_rule(merges: DataFrame, samples: int = 8) -> DataFrame:
    """merges (a, b, rule, detail): how many by rule, with the first samples."""
    first = merges.withColumn("n", F.row_number().over(Window.partitionBy("rule").orderBy("a", "b"))).filter(F.col("n") <= samples)
    shown = first.groupBy("rule").agg(F.array_sort(F.collect_list(F.concat_ws(" = ", "a", "b"))).alias("samples"))
    return merges.groupBy("rule").agg(F.count(F.lit(1)).alias("merges")).join(shown, "rule")


def markdown(counts: DataFrame, merges: DataFrame, built: str) -> str:
    """The match-quality report: counts (kind, names, entities) and merges by rule; both a few rows."""
    lines = [f"# Match quality, {built}", "", "| kind | names | entities |", "| --- | --- | --- |"]
    lines += [f"| {r.kind} | {r.names} | {r.entities} |" for r in counts.orderBy("kind").collect()]
    for r in merges.orderBy(F.desc("merges"), "rule").collect():
        lines += ["", f"## {r.rule}: {r.merges}", *(f"- {s}" for s in r.samples)]
    return "\n".join(lines) + "\n"
