"""Sales as they arrive against a stored forecast: the score of every week, once it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.facts import squared_error


def weekly_scores(actuals: DataFrame, predictions: DataFrame, threshold: float, late: str = "14 days") -> DataFrame:
    """From a stream of (Store, ts, Sales): week, rows, rmspe, above_threshold.

    Weeks begin on Monday. Rows later than ``late`` are not counted; a week is
    given out when the watermark has passed its end.
    """
    rows = actuals.withWatermark("ts", late).filter("Sales > 0").withColumn("Date", F.to_date("ts"))
    scored = rows.join(predictions.select("Store", "Date", "prediction"), ["Store", "Date"])
    # The epoch was a Thursday: four days on is a Monday.
    weeks = scored.groupBy(F.window("ts", "7 days", startTime="4 days")).agg(F.count("*").alias("rows"), F.sqrt(F.avg(squared_error())).alias("rmspe"))
    return weeks.select(F.to_date("window.start").alias("week"), "rows", "rmspe", (F.round("rmspe", 4) > threshold).alias("above_threshold"))
