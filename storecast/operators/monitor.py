"""Forecasts against what was sold: weekly scores, intervals, alarms, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import week
from ..functions.facts import squared_error
from .metrics import given, rmspe_of
from .quantiles import quantiles


def evaluate(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows and score of every week and of 'all'; coverage where there is an interval; whether the rounded score is above the threshold.

    A row with sales but no prediction is an error when the report is computed. Without any row with sales the report is empty.
    """
    rows = scored.filter("Sales > 0").withColumns({"week": week(), "prediction": given()})
    aggs = [F.count("*").alias("rows"), F.round(rmspe_of(), 4).alias("rmspe")]
    if {"low", "high"} <= set(scored.columns):
        aggs.append(F.round(F.avg(F.col("Sales").between(F.col("low"), F.col("high")).cast("int")), 4).alias("coverage"))
    out = rows.rollup("week").agg(F.grouping("week").alias("total"), *aggs).withColumn("week", F.when(F.col("total") == 1, "all").otherwise(F.col("week").cast("string"))).drop("total")
    return out if threshold is None else out.withColumn("above_threshold", F.col("rmspe") > threshold)


def alarms(report: DataFrame) -> DataFrame:
    """A week above the threshold is a warning, the second in a row an alarm. One row per week, so one window."""
    before = F.lag("above_threshold").over(W.orderBy("week"))
    state = F.when(F.col("above_threshold") & before, "alarm").when(F.col("above_threshold"), "warning").otherwise("fine")
    return report.filter("week <> 'all'").withColumn("state", state)


def sales_ratios(scored: DataFrame) -> DataFrame:
    """Sales over prediction by segment, a row each."""
    return scored.filter("Sales > 0 and prediction > 0").select("segment", (F.col("Sales") / F.col("prediction")).alias("ratio"))


def interval_quantiles(ratios: DataFrame, tail: float = 0.1) -> DataFrame:
    """By segment the quantiles of sales over prediction."""
    return quantiles(ratios, ["segment"], "ratio", {"q_low": tail, "q_high": 1 - tail})


def interval_ratios(scored: DataFrame, tail: float = 0.1) -> DataFrame:
    return interval_quantiles(sales_ratios(scored), tail)


def with_interval(scored: DataFrame, ratios: DataFrame) -> DataFrame:
    """Bounds from the segment's quantiles; zero on closed days."""
    bound = lambda q: F.when(F.col("Open") == 0, 0.0).otherwise(F.col("prediction") * F.col(q))
    return scored.join(ratios, "segment", "left").withColumns({"low": bound("q_low"), "high": bound("q_high")}).drop("q_low", "q_high")


def interval_quality(scored: DataFrame, *cols: str) -> DataFrame:
    width = (F.col("high") - F.col("low")) / F.col("prediction")
    inside = F.avg(F.col("Sales").between(F.col("low"), F.col("high")).cast("int"))
    return scored.filter("Sales > 0").groupBy(*cols).agg(inside.alias("coverage"), F.avg(width).alias("width"), F.min(width).alias("width_min"), F.max(width).alias("width_max"))


def shape(forecast: DataFrame) -> DataFrame:
    """One row: counts and the checks a forecast must pass."""
    return forecast.agg(
        F.count("*").alias("rows"), F.count_distinct("Store").alias("stores"), F.count_distinct("Date").alias("days"), F.count_if(F.col("prediction").isNull()).alias("missing"),
        F.count_if(F.col("Open") == 0).alias("closed"), F.count_if((F.col("Open") == 0) & (F.col("prediction") != 0)).alias("closed_not_zero"),
    )


def level_ratios(forecast: DataFrame, history: DataFrame, days: int = 42) -> DataFrame:
    """One row: quantiles over stores of the forecast's level over that of the last days of history."""
    start = F.date_sub(F.lit(history.agg(F.max("Date")).first()[0]), days)
    recent = history.filter(F.col("Date") > start).groupBy("Store").agg(F.avg("Sales").alias("was"))
    ratio = forecast.filter("Open = 1").groupBy("Store").agg(F.avg("prediction").alias("is")).join(recent, "Store").select(F.try_divide("is", "was").alias("ratio"))
    q = F.percentile("ratio", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return ratio.agg(q[0].alias("ratio_5"), q[1].alias("ratio_50"), q[2].alias("ratio_95"))


def daily_totals(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("Date").agg(F.sum("prediction").alias("total"), F.count_if(F.col("Open") == 1).alias("open_stores"))


def weekday_levels(forecast: DataFrame, history: DataFrame, days: int = 42) -> DataFrame:
    """Mean forecast of each weekday next to the last days' mean sales of the same stores."""
    start = F.date_sub(F.lit(history.agg(F.max("Date")).first()[0]), days)
    recent = history.filter(F.col("Date") > start).join(forecast.select("Store").distinct(), "Store", "left_semi")
    now = forecast.filter("Open = 1").groupBy("DayOfWeek").agg(F.avg("prediction").alias("forecast"))
    return now.join(recent.groupBy("DayOfWeek").agg(F.avg("Sales").alias("recent")), "DayOfWeek", "full_outer")


def best_factor(rows: DataFrame, *cols: str) -> DataFrame:
    """The factor on predictions that makes the squared relative error smallest, by group."""
    r = F.col("prediction") / F.col("Sales")
    return rows.filter("Sales > 0").groupBy(*cols).agg(F.try_divide(F.sum(r), F.sum(r * r)).alias("factor"))


def recalibrated(rows: DataFrame, factors: DataFrame, *cols: str) -> DataFrame:
    out = rows.join(factors, list(cols), "left")
    return out.withColumn("prediction", F.col("prediction") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def corrections(rows: DataFrame, inner: DataFrame, by: str = "segment", keys: tuple[str, ...] = ("fold",), seed: str = "seed") -> DataFrame:
    """What a factor on predictions would have done to each window: ``keys``, factor, ceiling_factor, and the scores before, one_factor, by_group, ceiling.

    ``rows`` are the scored rows of the windows, ``inner`` those of each window's
    inner cut, scored by a model that has not seen them; both have ``keys``,
    ``seed``, ``by``, Sales and prediction. one_factor is learnt on the inner cut
    of all seeds, by_group on that of each group, ceiling on the window itself,
    which nobody could have known. Scores are means over the seeds.

    With the factor g a group's squared errors add up to n - 2g * sum(r) + g^2 *
    sum(r^2), r being prediction over sales. So each table is read once, and all
    else is done on one row per window, seed and group. A row with sales but no
    prediction is an error when the table is computed; a group or window without
    an inner cut keeps its predictions. Null groups are one group.
    """
    r = given() / F.col("Sales")
    tag = lambda df, new: df.filter("Sales > 0").select(*keys, seed, by, r.alias("r"), F.lit(new).alias("new"))
    sums = tag(rows, True).unionByName(tag(inner, False)).groupBy(*keys, seed, by, "new").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("rr"))

    def factor(new: bool, *cols: str):
        of = lambda c: F.sum(F.when(F.col("new") == new, F.col(c))).over(W.partitionBy(*cols))
        return F.try_divide(of("r"), of("rr"))

    known = sums.withColumns({"one_factor": factor(False, *keys), "by_group": factor(False, *keys, by), "ceiling": factor(True, *keys)}).filter("new")
    squares = lambda g: F.col("n") - 2 * g * F.col("r") + g * g * F.col("rr")
    score = lambda g: F.sqrt(F.greatest(F.sum(squares(g)) / F.sum("n"), F.lit(0.0)))
    kept = {"before": F.lit(1.0)} | {c: F.coalesce(c, F.lit(1.0)) for c in ("one_factor", "by_group", "ceiling")}
    by_seed = known.groupBy(*keys, seed).agg(F.max("one_factor").alias("factor"), F.max("ceiling").alias("ceiling_factor"), *(score(g).alias(name) for name, g in kept.items()))
    return by_seed.groupBy(*keys).agg(F.max("factor").alias("factor"), F.max("ceiling_factor").alias("ceiling_factor"), *(F.avg(name).alias(name) for name in kept))


def correction_scores(corrected: DataFrame, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """``keys``, arm and rmspe, an arm for each way to correct: what :func:`~.experiment.accepted` takes, with ``before`` as its base."""
    arms = ["before", "one_factor", "by_group", "ceiling"]
    return corrected.unpivot([*keys], arms, "arm", "rmspe").withColumn("seed", F.lit(0))


def promote(champion: DataFrame, challenger: DataFrame, noise: float) -> DataFrame:
    """One row: both scores on the same window; the challenger is promoted unless worse by more than the noise."""
    tag = lambda df, n: df.select("Sales", "prediction", F.lit(n).alias("model"))
    both = tag(champion, "old").unionByName(tag(challenger, "new"))
    score = lambda n: F.sqrt(F.avg(F.when((F.col("model") == n) & (F.col("Sales") != 0), squared_error())))
    return both.agg(score("old").alias("champion"), score("new").alias("challenger")).withColumn("promoted", F.col("challenger") <= F.col("champion") + noise)
