"""Business days as a dimension table, and the periods that rules count in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Holidays on a date (month, day, first year), and on the n-th weekday of a month (Monday is 0; -1 is the last).
FIXED = ((1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0))
FLOATING = ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4))


def is_holiday(day: Column) -> Column:
    """Federal holidays, those on a weekend on the weekday they are observed."""
    out = F.lit(False)
    for month, dom, since in FIXED:
        for shift, weekdays in ((0, (0, 1, 2, 3, 4)), (1, (4,)), (-1, (0,))):  # itself; the Friday before a Saturday; the Monday after a Sunday
            real = F.date_add(day, shift)
            out = out | ((F.month(real) == month) & (F.dayofmonth(real) == dom) & (F.year(real) >= since) & F.weekday(day).isin(*weekdays))
    for month, weekday, n in FLOATING:
        nth = F.floor((F.dayofmonth(day) - 1) / 7) + 1 == n if n > 0 else F.dayofmonth(day) > F.dayofmonth(F.last_day(day)) - 7
        out = out | ((F.month(day) == month) & (F.weekday(day) == weekday) & nth)
    return out


def business_days(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """day, open, n (number of open days up to it), next_open and previous_open (itself if open)."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first_year}-01-01', DATE '{last_year}-12-31')) AS day")
    days = days.withColumn("open", (F.weekday("day") < 5) & ~is_holiday(F.col("day")))
    on = F.when(F.col("open"), F.col("day"))
    back = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    return days.select("day", "open", F.sum(F.col("open").cast("int")).over(back).alias("n"), F.min(on).over(ahead).alias("next_open"), F.max(on).over(back).alias("previous_open"))


def period_end(df: DataFrame, calendar: DataFrame, event: str, days: str, out: str = "period_end") -> DataFrame:
    """The last day of a period after an event. It starts on the first business day after the event; under seven
    days only business days count; a longer one that ends on a closed day rolls on. The calendar has one row a day,
    a few thousand for any span of years, so it is broadcast."""
    cal = F.broadcast(calendar)
    starts = cal.select(F.date_sub("day", 1).alias("_event"), F.col("next_open").alias("_start"))
    opens = cal.filter("open").select(F.col("day").alias("_day"), F.col("n").alias("_n"))
    named = df.join(starts, F.col(event).cast("date") == F.col("_event"), "left")
    short = named.join(opens.select(F.col("_day").alias("_d0"), F.col("_n").alias("_n0")), F.col("_start") == F.col("_d0"), "left")
    short = short.join(opens.select(F.col("_day").alias("_short"), F.col("_n").alias("_n1")), F.col("_n1") == F.col("_n0") + F.col(days) - 1, "left")
    rolled = short.join(cal.select(F.col("day").alias("_day2"), F.col("next_open").alias("_long")), F.date_add("_start", F.col(days).cast("int") - 1) == F.col("_day2"), "left")
    return rolled.select(*[F.col(c) for c in df.columns], F.when(F.col(days) < 7, F.col("_short")).otherwise(F.col("_long")).alias(out))


def months_before(day: Column, months: int) -> Column:
    """The same day of an earlier month, or that month's last."""
    return F.add_months(day, -months)
