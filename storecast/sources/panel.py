"""A store and day panel from order lines: store = supplier, day = ship date, closed = only returned lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dealt


def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = read.select(
        F.col("l_suppkey").cast("int").alias("Store"), F.col("l_shipdate").cast("date").alias("Date"), "l_orderkey",
        (F.col("l_returnflag") != "R").alias("ok"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long").alias("amount"),
        (F.col("l_discount") > 0.045).cast("int").alias("promo"),
    )
    # Dealt as they are: a store's day has few lines, so summing them before would only hold a task's whole part in memory.
    lines = dealt(lines, "Store", read.count())
    month, day = F.month("Date"), F.dayofmonth("Date")
    return lines.groupBy("Store", "Date").agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("amount"))), F.lit(0)).alias("Sales"),
        F.count_distinct(F.when(F.col("ok"), F.col("l_orderkey"))).alias("Customers"),
        F.max(F.col("ok").cast("int")).alias("Open"), F.max("promo").alias("Promo"),
    ).withColumns({
        "StateHoliday": F.when((month == 12) & day.isin(25, 26), "c").when((month == 4) & (day == 15), "b")
        .when(((month == 1) & (day == 1)) | ((month == 5) & (day == 1)) | ((month == 10) & (day == 3)), "a").otherwise("0"),
        "SchoolHoliday": month.isin(7, 8).cast("int"),
        "DayOfWeek": F.weekday("Date") + 1,
    })


def store_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    promo2, no_date = s % 2 == 0, s % 5 == 0
    months = F.array(F.lit("Jan,Apr,Jul,Oct"), F.lit("Feb,May,Aug,Nov"), F.lit("Mar,Jun,Sept,Dec"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        s.cast("int").alias("Store"),
        F.substring(F.lit("abcd"), (s % 4 + 1).cast("int"), F.lit(1)).alias("StoreType"),
        F.substring(F.lit("abc"), (n % 3 + 1).cast("int"), F.lit(1)).alias("Assortment"),
        F.when(s % 17 != 3, (100 + s * 37 % 20000).cast("double")).alias("CompetitionDistance"),
        F.when(~no_date, s % 12 + 1).cast("int").alias("CompetitionOpenSinceMonth"),
        F.when(~no_date, F.when(s % 23 == 1, 1900).otherwise(1985 + s % 14)).cast("int").alias("CompetitionOpenSinceYear"),
        promo2.cast("int").alias("Promo2"),
        F.when(promo2, 1 + s * 7 % 50).cast("int").alias("Promo2SinceWeek"),
        F.when(promo2, 1994 + s % 6).cast("int").alias("Promo2SinceYear"),
        F.when(promo2, F.get(months, (s % 3).cast("int"))).alias("PromoInterval"),
    )


def panel(spark: SparkSession, sf_dir: str, drop_closed: bool = False) -> DataFrame:
    from .files import clean_panel

    return clean_panel(daily_rows(spark, sf_dir), store_facts(spark, sf_dir), drop_closed)
