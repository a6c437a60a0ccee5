"""Distinct counts that merge: a sketch a week, united over any range of weeks, with a stated error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import week

#: Two to the power of this many registers: a sketch has 8 KB at most, whatever it counts.
LG_K = 12


def error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """How far an estimate may be off, as a share of the count: 1.04 over the root of the registers is one deviation; three hold in 99.7 % of cases."""
    return deviations * 1.04 / math.sqrt(2**lg_k)


def weekly_sketches(rows: DataFrame, columns: list[str], date: str = "Date", lg_k: int = LG_K) -> DataFrame:
    """week (from Monday) and a sketch of the distinct values of each column. A table of such rows is added to, not counted again."""
    return rows.groupBy(week(date).alias("week")).agg(*(F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(c) for c in columns))


def united(sketches: DataFrame, columns: list[str], *by: Column) -> DataFrame:
    """One row per group of weeks with its first and last week, their number, and the estimated distinct values of each column."""
    out = sketches.groupBy(*by).agg(
        F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.count("*").alias("weeks"), *(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns)
    )
    return out


def between(sketches: DataFrame, columns: list[str], first, last) -> DataFrame:
    """The estimates of the weeks that begin in the given span, whatever it is; one row, null where no week does."""
    return united(sketches.filter(F.col("week").between(F.lit(first), F.lit(last))), columns)
