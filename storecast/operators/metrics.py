"""RMSPE, overall and by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.facts import squared_error


def rmspe_of(actual: str = "Sales", predicted: str = "prediction") -> Column:
    """An aggregate: root of the mean squared relative error over rows with sales; null without any."""
    return F.sqrt(F.avg(F.when(F.col(actual) != 0, squared_error(actual, predicted))))


def given(predicted: str = "prediction") -> Column:
    """The prediction; a missing one is an error when the row is computed."""
    bad = F.col(predicted).isNull() | F.isnan(F.col(predicted).cast("double"))
    return F.when(bad, F.raise_error(F.lit("a row with sales has no prediction")).cast("double")).otherwise(F.col(predicted))


def rmspe(df: DataFrame, actual: str = "Sales", predicted: str = "prediction") -> float:
    """The score as a number; a missing prediction or a table without sales is an error."""
    sold = F.col(actual) != 0
    bad = F.count_if(sold & (F.col(predicted).isNull() | F.isnan(F.col(predicted).cast("double"))))
    score, missing = df.agg(rmspe_of(actual, predicted), bad).first()
    if missing:
        raise ValueError(f"{missing} rows have no prediction")
    if score is None:
        raise ValueError("no row has sales")
    return score


def rmspe_by(df: DataFrame, *cols: str, actual: str = "Sales", predicted: str = "prediction") -> DataFrame:
    """rmspe, rows and mean_sales of each group; sort worst first with :func:`worst_first`."""
    rows = df.filter((F.col(actual) != 0) & F.col(predicted).isNotNull())
    return rows.groupBy(*cols).agg(rmspe_of(actual, predicted).alias("rmspe"), F.count("*").alias("rows"), F.avg(actual).alias("mean_sales"))


def worst_first(groups: DataFrame, *cols: str) -> DataFrame:
    return groups.orderBy(F.desc("rmspe"), *cols)
