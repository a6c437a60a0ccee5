"""How each store behaves: ratios of conditional means, one row per store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIOS = ["promo_uplift", "school_uplift", "weekend_ratio", "season_amp", "dec_lift", "basket", "momentum"]
RECENT_DAYS, YEAR_DAYS = 90, 365
BINS = {"mean_sales": 4, "promo_uplift": 3, "season_amp": 3}


def profiles(train: DataFrame, fill: bool = True) -> DataFrame:
    """mean_sales, days and the seven ratios; a ratio without a denominator is the median over stores, unless ``fill`` is off."""
    last = F.lit(train.agg(F.max("Date")).first()[0])
    mean = lambda where: F.avg(F.when(where, F.col("Sales")))
    ratio = lambda a, b: F.try_divide(mean(a), mean(b))
    recent = F.col("Date") > F.date_sub(last, RECENT_DAYS)
    before = (F.col("Date") > F.date_sub(last, RECENT_DAYS + YEAR_DAYS)) & (F.col("Date") <= F.date_sub(last, YEAR_DAYS))
    plain = train.groupBy("Store").agg(
        F.avg("Sales").alias("mean_sales"), F.count("*").alias("days"),
        ratio(F.col("Promo") == 1, F.col("Promo") == 0).alias("promo_uplift"),
        ratio(F.col("SchoolHoliday") == 1, F.col("SchoolHoliday") == 0).alias("school_uplift"),
        ratio(F.col("DayOfWeek") >= 5, F.col("DayOfWeek") < 5).alias("weekend_ratio"),
        F.try_divide(F.sum("Sales"), F.sum("Customers")).alias("basket"), ratio(recent, before).alias("momentum"),
    )
    months = train.groupBy("Store", F.month("Date").alias("month")).agg(F.avg("Sales").alias("m"))
    season = months.groupBy("Store").agg(F.try_divide(F.max("m"), F.min("m")).alias("season_amp"), F.try_divide(F.max(F.when(F.col("month") == 12, F.col("m"))), F.avg("m")).alias("dec_lift"))
    out = plain.join(season, "Store").select("Store", "mean_sales", "days", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in RATIOS))
    if not fill:
        return out
    medians = out.agg(*(F.median(c).alias(c) for c in RATIOS)).first()
    return out.select("Store", "mean_sales", "days", *(F.coalesce(c, F.lit(medians[c]).cast("double")).alias(c) for c in RATIOS))


def long_history(prof: DataFrame, min_days: int) -> DataFrame:
    return prof.filter(F.col("days") >= min_days)


def moments(prof: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every ratio; a deviation of zero counts as one."""
    row = prof.agg(*(f(c).alias(f"{n}_{c}") for c in RATIOS for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in RATIOS}


def standardised(prof: DataFrame, by: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    by = by or moments(prof)
    return prof.select("Store", "mean_sales", "days", F.col("promo_uplift").alias("raw_uplift"), *((F.col(c) - m).__truediv__(s).alias(f"z_{c}") for c, (m, s) in by.items()))


def cells(prof: DataFrame) -> DataFrame:
    """Store and the cell of its size, uplift and season; a store on an edge is in the upper bin."""
    edges = prof.agg(*(F.percentile(c, F.array(*(F.lit(k / n) for k in range(1, n)))).alias(c) for c, n in BINS.items())).first()
    place = F.lit(0)
    for c, n in BINS.items():
        place = place * n + sum(((F.col(c) >= e).cast("int") for e in edges[c]), F.lit(0))
    return prof.select("Store", place.alias("cell"))
