"""Registered queries and their DuckDB oracles.

Most plans are one SQL text for both engines. Where the dialects part, the text has a macro: @name(args).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.session import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: macro -> (Spark, DuckDB); {0} {1} ... are the arguments.
MACROS = {
    "set": ("array_join(array_sort(collect_set(CAST({0} AS STRING))), ',')", "string_agg(DISTINCT CAST({0} AS STRING), ',' ORDER BY CAST({0} AS STRING))"),
    "rows": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
    "each": ("explode({0})", "unnest({0})"),
    "days": ("CAST(datediff({1}, {0}) AS INT)", "CAST(date_diff('day', CAST({0} AS DATE), CAST({1} AS DATE)) AS INT)"),
    "plus": ("date_add({0}, CAST({1} AS INT))", "CAST(CAST({0} AS DATE) + CAST({1} AS INT) AS DATE)"),
    "matches": ("{0} RLIKE {1}", "regexp_matches({0}, {1})"),
    "replace_all": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "group": ("nullif(regexp_extract({0}, {1}, {2}), '')", "nullif(regexp_extract({0}, {1}, {2}), '')"),
    "all_matches": ("regexp_extract_all({0}, {1}, 0)", "regexp_extract_all({0}, {1})"),
    "int": ("try_cast({0} AS INT)", "try_cast({0} AS INT)"),
    "iso": ("date_format({0}, 'yyyy-MM-dd')", "strftime({0}, '%Y-%m-%d')"),
    "day_of": ("CAST(weekday({0}) AS INT)", "CAST((isodow({0}) - 1) AS INT)"),
    "list": ("array({*})", "[{*}]"),
    "json": ("get_json_object({0}, {1})", "json_extract_string({0}, {1})"),
    "max_by": ("max_by({0}, struct({1}))", "arg_max({0}, ({1}))"),
    "starts": ("startswith({0}, {1})", "starts_with({0}, {1})"),
    "sha1": ("sha1({0})", "sha1({0})"),
}
_CALL = re.compile(r"@(\w+)\(")


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of a call whose parenthesis opens before `at`, and where it ends."""
    out, depth, start, quoted = [], 0, at, False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]" and depth:
            depth -= 1
        elif c == ")":
            return [*out, text[start:i].strip()], i + 1
        elif c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError("a macro call does not end")


def expand(text: str, engine: int) -> str:
    """The text in one dialect: 0 for Spark, 1 for DuckDB."""
    while m := _CALL.search(text):
        args, end = _arguments(text, m.end())
        form = MACROS[m[1]][engine]
        made = form.replace("{*}", ", ".join(args))
        for i, a in enumerate(args):
            made = made.replace(f"{{{i}}}", a)
        text = text[: m.start()] + made + text[end:]
    return text


def sql_query(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    """Register a SQL plan; the oracle is the same text in DuckDB's dialect unless given."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    spark_text = expand(text, 0)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables.split())
        return spark.sql(spark_text)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or expand(text, 1)


def frame_query(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    """Register a DataFrame plan, with an oracle where SQL can express it."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = expand(oracle, 1)


from lodestar.plans import boards, domain, ingest, ordered, scalars  # noqa: E402,F401
