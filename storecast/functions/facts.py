"""Columns from store facts, prices and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ASSORTMENTS, FIRST_REAL_YEAR, HOLIDAYS, MONTHS, STORE_TYPES


def competition(df: DataFrame, median_distance: float | None) -> DataFrame:
    """Distance filled with the training rows' median; months since the competitor opened, 0 if unknown."""
    year, month = F.col("CompetitionOpenSinceYear"), F.col("CompetitionOpenSinceMonth")
    age = F.greatest((F.year("Date") - year) * 12 + F.month("Date") - month, F.lit(0))
    known = year.isNotNull() & month.isNotNull() & (year >= FIRST_REAL_YEAR)
    return df.withColumns({"CompetitionDistance": F.coalesce("CompetitionDistance", F.lit(median_distance).cast("double")), "competition_age_months": F.when(known, age).otherwise(0).cast("int")})


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")


def promo2(df: DataFrame) -> DataFrame:
    """promo2_active in the months of a running interval, weeks since it began, and the place in its cycle (-1: none)."""
    since, week = F.col("Promo2SinceYear"), F.col("Promo2SinceWeek")
    year, now = F.year("Date"), F.weekofyear("Date")
    running = F.coalesce((F.col("Promo2") == 1) & ((year > since) | ((year == since) & (now >= week))), F.lit(False))
    months = F.split(F.coalesce("PromoInterval", F.lit("")), ",")
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("Date"))
    weeks = (year - since) * 52 + (now - week)
    cycle = F.pmod(F.month("Date") - month_number(F.get(months, F.lit(0))) + 12, F.lit(3))
    begins = month_number(F.get(months, F.lit(0))) > 0
    return df.withColumns(
        {
            "promo2_active": (running & F.array_contains(months, name)).cast("int"),
            "promo2_tenure_weeks": F.when(running & weeks.isNotNull(), F.greatest(weeks, F.lit(0))).otherwise(0).cast("int"),
            "promo_cycle_pos": F.when(running & begins, cycle).otherwise(-1).cast("int"),
        }
    )


def dummies(df: DataFrame) -> DataFrame:
    """One 0/1 column per fixed level; null stays null."""
    levels = {"StoreType": STORE_TYPES, "Assortment": ASSORTMENTS, "StateHoliday": HOLIDAYS}
    return df.withColumns({f"{c}_{x}": (F.col(c) == x).cast("int") for c, xs in levels.items() for x in xs})


def log_target(sales: str = "Sales") -> Column:
    return F.log1p(F.col(sales))


def from_log(raw: str) -> Column:
    """Back to units, never negative."""
    return F.greatest(F.expm1(F.col(raw)), F.lit(0.0))


def squared_error(actual: str = "Sales", predicted: str = "prediction") -> Column:
    return F.pow((F.col(actual) - F.col(predicted)) / F.col(actual), 2)


def relative_error(actual: str = "Sales", predicted: str = "prediction") -> Column:
    return (F.col(predicted) - F.col(actual)) / F.col(actual)


def closure_flags() -> dict[str, Column]:
    """Flags that may overlap, for rows with closure columns: closed next to it, a holiday within a day, any of these."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    after, before = flag(F.col("open_yesterday") == 0), flag(F.col("open_tomorrow") == 0)
    near = flag((F.col("days_to_next_holiday") <= 1) | (F.col("days_since_last_holiday") <= 1))
    return {"after_closed": after, "before_closed": before, "near_holiday": near, "any_flag": after | before | near}


def closure_label() -> Column:
    """What a closed neighbour explains; the day before wins over the day after."""
    return F.when(F.col("open_yesterday") == 0, "after a closed day").when(F.col("open_tomorrow") == 0, "before a closed day").otherwise("a normal day")
