"""Exact quantiles of few groups with very many values, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group of ``by``: the quantile of each named share, interpolated as ``percentile`` does.

    Equal values are counted first. The distinct values of all groups are then
    dealt by range, so a group is spread over as many tasks as its size asks
    for; the ranges' totals (one row per range and group) give each value its
    place. Null values do not count; a group of nothing but nulls, or an empty
    table, has no row. Groups of a null key are groups. The dealt table stays
    in the shared folder, since the result reads it.
    """
    counted = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    dealt = written(counted.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*by, "_range").agg(F.sum("_n").alias("_total"))
    group = W.partitionBy(*by)
    totals = totals.withColumns({"_all": F.sum("_total").over(group), "_before": F.sum("_total").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))})
    # The keys by another name, so that null ones meet too.
    totals = totals.select("_all", F.coalesce("_before", F.lit(0)).alias("_before"), F.col("_range").alias("_of"), *(F.col(c).alias(f"_of_{c}") for c in by))
    same = F.col("_range") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*by, "_range").orderBy("_v"))
    placed = dealt.join(totals, same).withColumn("_upto", upto)
    here = lambda place: F.max(F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col("_v")))
    aggs = []
    for name, share in shares.items():
        at = (F.col("_all") - 1) * F.lit(float(share))
        low, part = here(F.floor(at)), F.max(at - F.floor(at))
        aggs.append((low + part * (here(F.ceil(at)) - low)).alias(name))
    return placed.groupBy(*by).agg(*aggs)
