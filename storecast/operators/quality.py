"""Checks of the data and first looks at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.dates import week
from ..sources.tables import dropped, written

ROW_CHECKS = {
    "store below 1": "Store < 1", "weekday out of range": "DayOfWeek not between 1 and 7", "weekday differs from date": "DayOfWeek <> weekday(Date) + 1", "negative sales": "Sales < 0",
    "negative customers": "Customers < 0", "open not 0 or 1": "Open not in (0, 1)", "promo not 0 or 1": "Promo not in (0, 1)", "unknown holiday": "StateHoliday not in ('0', 'a', 'b', 'c')",
    "closed with sales": "Open = 0 and Sales > 0", "closed with customers": "Open = 0 and Customers > 0", "open without sales": "Open = 1 and Sales = 0", "sales without customers": "Sales > 0 and Customers = 0",
    "customers without sales": "Customers > 0 and Sales = 0", "no store facts": "StoreType is null",
}
STORE_CHECKS = {
    "no distance": "CompetitionDistance is null", "no competitor date": "CompetitionOpenSinceYear is null", "placeholder year": "CompetitionOpenSinceYear < 1950", "unknown type": "StoreType not in ('a', 'b', 'c', 'd')",
    "promo2 without start": "Promo2 = 1 and Promo2SinceYear is null", "start without promo2": "Promo2 = 0 and Promo2SinceYear is not null", "promo2 without months": "Promo2 = 1 and PromoInterval is null",
}


def _counts(checks: dict[str, str]) -> list[Column]:
    return [F.count_if(F.expr(x)).alias(n) for n, x in checks.items()]


def report(rows: DataFrame, stores: DataFrame) -> DataFrame:
    """Name and number of bad rows of every check.

    The rows are read once: the checks are counted while they are stored, and
    repeated keys from the two stored key columns. Empty tables have no bad rows.
    """
    seen, facts = Observation(), Observation()
    keys = written(rows.observe(seen, *_counts(ROW_CHECKS)).select("Store", "Date"), "keys")
    kept = written(stores.observe(facts, *_counts(STORE_CHECKS)).select("Store"), "stores")
    repeated = keys.groupBy("Store", "Date").count().filter("count > 1").count()
    found = {**seen.get, **facts.get, "repeated key": repeated}
    for table in (keys, kept):
        dropped(table)
    return rows.sparkSession.createDataFrame(list(found.items()), "check string, bad long")


def silent_stores(rows: DataFrame, start, end) -> DataFrame:
    """Stores that have rows, but none in the period."""
    return rows.select("Store").distinct().join(rows.filter(F.col("Date").between(F.lit(start), F.lit(end))).select("Store"), "Store", "left_anti")


def weekly(rows: DataFrame) -> DataFrame:
    """Mean sales and the stores that report, by week from Monday."""
    return rows.groupBy(week().alias("week")).agg(F.avg("Sales").alias("mean_sales"), F.count_distinct("Store").alias("stores"))


def means_by(open_days: DataFrame, dims: dict[str, object]) -> DataFrame:
    """Mean sales and rows by each of the dimensions, one below the other, in one pass over the rows."""
    tagged = open_days.select("Sales", F.explode(F.array(*(F.struct(F.lit(n).alias("dim"), c.cast("string").alias("level")) for n, c in dims.items()))).alias("x"))
    return tagged.groupBy("x.dim", "x.level").agg(F.avg("Sales").alias("mean_sales"), F.count("*").alias("rows"))


def store_means_with_facts(open_days: DataFrame) -> DataFrame:
    """A store's mean sales with its distance and type; stores without a distance are left out."""
    return open_days.groupBy("Store").agg(F.avg("Sales").alias("mean_sales"), F.max("CompetitionDistance").alias("distance"), F.max("StoreType").alias("type")).dropna()


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of the MD5 of their key: the same rows each time."""
    key = F.concat_ws(":", F.lit(seed), F.col("Store"), F.col("Date"))
    return df.orderBy(F.md5(key.cast("binary")), "Store", "Date").limit(n)


def compared_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many stores are only in the one, only in the other, and in both."""
    tagged = a.select("Store").distinct().withColumn("a", F.lit(1)).join(b.select("Store").distinct().withColumn("b", F.lit(1)), "Store", "full_outer")
    return tagged.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
