"""Dates of the feed, as column expressions.

Two shapes are read: year first (documents) and US month first (the feed). The shape decides, never the value;
only a month past 12 beside a day that can be a month swaps the two. What is no date stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two shapes, and what sets off a note after a date.
YEAR_FIRST = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?:[ T]([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?))?"
MONTH_FIRST = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2,4})(?:[ T]([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?))?"
SWAPPED = r"^(1[3-9]|[2-9][0-9])[-/](0?[1-9]|1[0-2])[-/]([0-9]{2,4})(?:[ T]([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?))?"
NOTE = "  ("


def strip_note(value: Column) -> Column:
    return F.nullif(F.trim(F.substring_index(value.cast("string"), NOTE, 1)), F.lit(""))


def note_of(value: Column) -> Column:
    text = value.cast("string")
    note = F.trim(F.regexp_replace(F.substring_index(text, NOTE, -1), r"\)*\s*$", ""))
    return F.when(text.contains(NOTE), F.nullif(note, F.lit("")))


def parse(value: Column) -> Column:
    """The instant, as TIMESTAMP_NTZ; null for what is no date.

    Either shape is written anew as year, month, day and clock; what then is no such stamp is no date."""
    text = F.regexp_replace(strip_note(value), f"{SWAPPED}.*$", "$3-$2-$1 $4")
    text = F.regexp_replace(F.regexp_replace(text, f"{MONTH_FIRST}.*$", "$3-$1-$2 $4"), f"{YEAR_FIRST}.*$", "$1-$2-$3 $4")
    stamp = F.trim(F.regexp_replace(text, "^([0-9]{2})-", "20$1-"))
    return F.try_to_timestamp(stamp, F.lit("yyyy-M-d[ H:m[:s]]")).cast("timestamp_ntz")


def to_iso(value: Column) -> Column:
    """ISO 8601, with the time if there is one; other text comes back unchanged."""
    at = F.date_format(parse(value), "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(F.regexp_replace(at, "T00:00:00$", ""), strip_note(value))


def sort_key(value: Column) -> Column:
    """Missing dates sort first."""
    return F.coalesce(to_iso(value), F.lit(""))


def display(value: Column, fallback: str = "Unknown") -> Column:
    return F.coalesce(F.date_format(parse(value), "dd MMM yyyy"), strip_note(value), F.lit(fallback))


def normalized(df, *columns: str):
    """(rows with the columns in ISO form, one row of counts: changed and unparsed values by column)."""
    done = df.select("*", *[to_iso(F.col(c)).alias(f"{c}__iso") for c in columns])
    counts = done.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"{c}__iso"))).alias(f"{c}_changed") for c in columns], *[F.count_if(F.col(c).isNotNull() & parse(F.col(c)).isNull()).alias(f"{c}_unparsed") for c in columns])
    out = done.select(*[F.col(f"{c}__iso").alias(c) if c in columns else F.col(c) for c in df.columns])
    return out, counts


def jwt_expiry(token: Column) -> Column:
    """Expiry (epoch seconds) in a token's payload; null if there is none."""
    body = F.translate(F.get(F.split(token, r"\."), 1), "-_", "+/")
    padded = F.rpad(body, F.length(body) + (4 - F.length(body) % 4) % 4, "=")
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.exp").try_cast("bigint")
