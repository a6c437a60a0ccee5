"""Running sums and places over a whole table in its order, without a task that holds the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], place: str | None = None, ties: bool = False) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over all rows up to and with this one in ``order``; ``place`` counts the rows.

    The rows are dealt by range and stored; a range's total (one row per range,
    so as many as there are partitions) is what the ranges before it add to its
    own running sums. With ``ties`` rows that are equal by ``order`` share the
    sum up to the last of them; without, ``order`` should tell all rows apart,
    or equal rows come in any order. Null terms count as zero. Equal rows stand
    in one range, so an order that few rows tell apart gives few ranges. The
    dealt table stays in the shared folder, since the result reads it.
    """
    own = {name: F.coalesce(value, F.lit(0)) for name, value in sums.items()} | ({place: F.lit(1)} if place else {})
    terms = {f"_term_{k}": value for k, value in enumerate(own.values())}
    dealt = written(df.withColumns(terms).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*(F.sum(t).alias(t) for t in terms))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("_range").alias("_of"), *(F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"_before{t}") for t in terms))
    w = W.partitionBy("_range").orderBy(*order)
    w = w.rangeBetween(W.unboundedPreceding, 0) if ties else w.rowsBetween(W.unboundedPreceding, 0)
    # A row for each partition: it is sent to all tasks whatever the table's size.
    both = dealt.join(F.broadcast(before), F.col("_range") == F.col("_of"))
    return both.select(*df.columns, *((F.col(f"_before{t}") + F.sum(t).over(w)).alias(name) for name, t in zip(own, terms, strict=True)))
