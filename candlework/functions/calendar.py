"""Exchange calendar as date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days with a 13:00 close and one-off closures.
EARLY_CLOSES = [
    "2022-11-25", "2023-07-03", "2023-11-24", "2024-07-03", "2024-11-29", "2024-12-24", "2025-07-03", "2025-11-28", "2025-12-24",
]
SPECIAL_CLOSURES = ["2025-01-09"]


def observed(day: Column) -> Column:
    """Saturday holidays move to Friday, Sunday ones to Monday."""
    return F.date_add(day, F.when(F.weekday(day) == 5, -1).when(F.weekday(day) == 6, 1).otherwise(0))


def nth_weekday(year: Column, month: int, weekday: int, nth: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))


def last_weekday(year: Column, month: int, weekday: int) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(end, F.pmod(F.weekday(end) - weekday, F.lit(7)))


def easter(year: Column) -> Column:
    """Western Easter Sunday by the Gregorian computus."""

    def div(a, b):
        return F.floor(a / b)

    golden = year % 19
    century = div(year, 100)
    epact = (century - div(century, 4) - div(8 * century + 13, 25) + 19 * golden + 15) % 30
    moon = epact - div(epact, 28) * (1 - div(epact, 28) * div(F.lit(29), epact + 1) * div(21 - golden, 11))
    weekday = (year + div(year, 4) + moon + 2 - century + div(century, 4)) % 7
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), (moon - weekday).cast("int"))


def holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """One row per closure day of every year in ``years``."""
    y = F.col(year)

    def fixed(month: int, day: int) -> Column:
        return observed(F.make_date(y, F.lit(month), F.lit(day)))

    rules = [
        fixed(1, 1), nth_weekday(y, 1, 0, 3), nth_weekday(y, 2, 0, 3), F.date_sub(easter(y), 2), last_weekday(y, 5, 0),
        fixed(6, 19), fixed(7, 4), nth_weekday(y, 9, 0, 1), nth_weekday(y, 11, 3, 4), fixed(12, 25),
    ]
    special = [F.when(F.year(F.lit(d).cast("date")) == y, F.lit(d).cast("date")) for d in SPECIAL_CLOSURES]
    days = years.select(F.explode(F.array(*rules, *special)).alias("day"))
    return days.where(F.col("day").isNotNull()).distinct()


def trading_calendar(bounds: DataFrame, *, first: str = "first_day", last: str = "last_day") -> DataFrame:
    """Day dimension between two dates (one-row frame ``bounds``).

    Its size is the number of days, whatever the size of the fact tables.
    """
    days = bounds.select(F.explode(F.sequence(F.col(first).cast("date"), F.col(last).cast("date"))).alias("day"))
    years = bounds.select(F.explode(F.sequence(F.year(first), F.year(last))).alias("year"))
    closed = holidays(years).withColumn("holiday", F.lit(1))
    eve = closed.select(F.explode(F.array(*[F.date_sub("day", k) for k in (1, 2, 3)])).alias("day")).distinct().withColumn("eve", F.lit(1))
    flags = days.join(closed, "day", "left").join(eve, "day", "left")
    open_day = ((F.weekday("day") < 5) & F.col("holiday").isNull()).cast("int")
    flags = flags.withColumn("is_trading_day", open_day)
    traded = F.when(F.col("is_trading_day") == 1, F.col("day"))

    def edge(agg: Column, *parts: Column) -> Column:
        return F.coalesce((traded == agg.over(Window.partitionBy(*parts))).cast("int"), F.lit(0))

    y, q, m = F.year("day"), F.quarter("day"), F.month("day")
    return flags.select(
        "day",
        "is_trading_day",
        F.coalesce("holiday", F.lit(0)).alias("holiday"),
        F.col("day").isin([F.lit(d).cast("date") for d in EARLY_CLOSES]).cast("int").alias("early_close"),
        (F.col("is_trading_day") * F.coalesce("eve", F.lit(0))).alias("day_before_holiday"),
        edge(F.min(traded), y, m).alias("first_trading_day"),
        edge(F.max(traded), y, m).alias("last_trading_day"),
        edge(F.max(traded), y, m).alias("month_end"),
        edge(F.max(traded), y, q).alias("quarter_end"),
        edge(F.max(traded), y).alias("year_end"),
    )
