"""Calendar, Easter and month columns, and buckets of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EASTER_CAP


def whole(x: Column, by: int) -> Column:
    """Floor division, also of negative numbers."""
    return F.floor(x / by).cast("int")


def calendar_parts(df: DataFrame) -> DataFrame:
    """Calendar year, month, day and ISO week (a last week of December may be week 1)."""
    return df.withColumns({"year": F.year("Date"), "month": F.month("Date"), "day_of_month": F.dayofmonth("Date"), "weekofyear": F.weekofyear("Date")})


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter: the Sunday after the ecclesiastical full moon, counted from the 28th of March."""
    golden, century = F.pmod(year, F.lit(19)), whole(year, 100)
    epact = F.pmod(century - whole(century, 4) - whole(8 * century + 13, 25) + 19 * golden + 15, F.lit(30))
    moon = epact - F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    weekday = F.pmod(year + whole(year, 4) + moon + 2 - century + whole(century, 4), F.lit(7))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), (moon - weekday).cast("int"))


def days_to_easter(date: str = "Date", cap: int = EASTER_CAP) -> Column:
    """Days since this year's Easter, negative before it, cut at the cap."""
    away = F.date_diff(F.col(date), easter_sunday(F.year(date)))
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), away))


def month_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"month_start": (F.dayofmonth("Date") <= 5).cast("int"), "days_to_month_end": F.date_diff(F.last_day("Date"), F.col("Date"))})


def week(date: str = "Date") -> Column:
    """The Monday of the week."""
    return F.date_trunc("week", F.col(date)).cast("date")


def bucket(days: Column, size: int) -> Column:
    """The first day of the bucket of so many days."""
    return whole(days, size) * size


def carnival_gap(date: str = "Date") -> Column:
    """Days from the Monday 48 days before Easter."""
    return F.abs(F.date_diff(F.col(date), easter_sunday(F.year(date))) + 48)
