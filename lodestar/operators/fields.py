"""Declarative field specs over cases, compiled to column expressions.

A spec names a source; it is looked for on the case, then in a stage's fields, then in a stage's lists. From a list
items are filtered (where), projected (item), deduplicated in order, cut (limit) and joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a spec's type and stage may be.
TYPES = ("text", "date", "list", "link", "badge", "number", "boolean", "parties", "people", "money", "longtext")
STAGES = ("primary", "current", "all")


@dataclass(frozen=True)
class Field:
    source: str
    label: str = ""
    type: str = "text"
    stage: str = "primary"
    where: dict[str, tuple[str, ...]] = field(default_factory=dict)
    item: str = "label"
    join: str = ", "
    limit: int | None = None

    @staticmethod
    def from_dict(raw: dict) -> Field:
        """A validated spec; ValueError says what is wrong."""
        unknown = set(raw) - set(Field.__dataclass_fields__)
        if unknown or not str(raw.get("source") or "").strip():
            raise ValueError(f"field without source, or unknown keys {sorted(unknown)}")
        where = {k: tuple(str(x) for x in (v if isinstance(v, (list, tuple)) else [v])) for k, v in (raw.get("where") or {}).items()}
        made = Field(**{**raw, "where": where, "label": raw.get("label") or raw["source"].replace("_", " ").capitalize()})
        if made.type not in TYPES or made.stage not in STAGES or (made.limit is not None and made.limit < 1):
            raise ValueError(f"field {made.source}: bad type, stage or limit")
        return made


def _one_of(name: str, allowed: list[str]):
    return lambda x: F.lower(x[name]).isin(allowed)


def _from_items(spec: Field, items: Column) -> Column:
    kept = items
    for name, allowed in spec.where.items():
        kept = F.filter(kept, _one_of(name, [a.lower() for a in allowed]))
    values = F.array_distinct(F.filter(F.transform(kept, lambda x: x[spec.item]), lambda v: v.isNotNull() & (v != "")))
    return F.nullif(F.array_join(F.slice(values, 1, spec.limit) if spec.limit else values, spec.join), F.lit(""))


def resolve(spec: Field, cases: DataFrame) -> Column:
    """The spec's value for a row of cases."""
    if spec.source in cases.columns and spec.source != "stages":
        value = F.col(spec.source)
        return F.array_join(value, spec.join) if cases.schema[spec.source].dataType.typeName() == "array" else value.cast("string")
    if spec.stage == "all":
        some = F.col("stages")
    else:
        of = F.col("primary_stage" if spec.stage == "primary" else "current_stage")
        same = F.filter("stages", lambda s: s["stage_id"].eqNullSafe(of))
        some = F.when(F.size(same) > 0, same).otherwise(F.slice("stages", 1 if spec.stage == "primary" else -1, 1))
    scalar = F.array_join(F.array_distinct(F.filter(F.transform(some, lambda s: s["fields"][spec.source]), lambda v: v.isNotNull())), spec.join)
    items = F.flatten(F.filter(F.transform(some, lambda s: s["lists"][spec.source]), lambda v: v.isNotNull()))
    return F.coalesce(F.nullif(scalar, F.lit("")), _from_items(spec, items))


def project(cases: DataFrame, specs: list[Field], keep: tuple[str, ...] = ()) -> DataFrame:
    """number, the columns to keep, and a column for each spec."""
    return cases.select("number", *keep, *[resolve(s, cases).alias(f"f{i}_{s.source}") for i, s in enumerate(specs)])


def sources(cases: DataFrame) -> DataFrame:
    """source, cases, share, sample: every field and list the cases have."""
    each = cases.select("number", F.explode("stages").alias("s"))
    fields = each.select("number", F.explode(F.col("s")["fields"]).alias("source", "sample"))
    lists = each.select("number", F.explode(F.map_keys(F.col("s")["lists"])).alias("source"), F.lit(None).cast("string").alias("sample"))
    total = cases.agg(F.count(F.lit(1)).alias("total"))  # one row
    found = fields.union(lists).groupBy("source").agg(F.count_distinct("number").alias("cases"), F.min("sample").alias("sample"))
    return found.crossJoin(F.broadcast(total)).select("source", "cases", (F.col("cases") / F.col("total")).alias("share"), "sample")


def unresolved(cases: DataFrame, specs: list[Field]) -> list[str]:
    """Sources that no case has."""
    known = {r.source for r in sources(cases).select("source").collect()} | set(cases.columns)  # bounded by the feed's labels
    return [s.source for s in specs if s.source not in known]
