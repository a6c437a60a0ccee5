"""Where the error lies: groups, days, stores, and two models side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.facts import relative_error, squared_error
from ..sources.tables import written
from .metrics import rmspe_of
from .quantiles import quantiles
from .running import running


def seed_scores(frame: DataFrame, *cols: str, predicted: str = "prediction") -> DataFrame:
    """Scored per seed, then mean, deviation and rows over the seeds."""
    each = frame.groupBy(*cols, "seed").agg(rmspe_of(predicted=predicted).alias("score"), F.count("*").alias("n"))
    return each.groupBy(*cols).agg(F.avg("score").alias("rmspe"), F.stddev_pop("score").alias("noise"), F.avg("n").cast("int").alias("rows"))


def side_by_side(frame: DataFrame, *cols: str, a: str = "pred_a", b: str = "pred_b") -> DataFrame:
    """Two models' scores by group in one pass, with the gain of the second."""
    out = frame.groupBy(*cols).agg(rmspe_of(predicted=a).alias("rmspe_a"), rmspe_of(predicted=b).alias("rmspe_b"), F.count("*").alias("rows"))
    return out.withColumn("delta", F.col("rmspe_b") - F.col("rmspe_a"))


def concentration(frame: DataFrame, key: str) -> DataFrame:
    """Squared error by key with its running share, worst first; of equal ones the smaller key first. No task holds all keys."""
    groups = written(frame.filter("Sales <> 0").groupBy(key).agg(F.sum(squared_error()).alias("total"), F.count("*").alias("rows")), "groups")
    ranked = running(groups, [F.desc("total"), F.asc(key)], {"upto": F.col("total")}, place="place")
    every = groups.agg(F.sum("total").alias("every"))  # one row
    return ranked.crossJoin(F.broadcast(every)).select(key, "total", "rows", F.try_divide("upto", "every").alias("running_share"), F.col("place").cast("int").alias("place"))


def shares(frame: DataFrame, *cols: str) -> DataFrame:
    """Each group's share of the rows and of the squared error."""
    groups = frame.filter("Sales <> 0").groupBy(*cols).agg(F.count("*").alias("rows"), F.sum(squared_error()).alias("total"))
    every = W.partitionBy()
    return groups.select(*cols, "rows", (F.col("rows") / F.sum("rows").over(every)).alias("row_share"), (F.col("total") / F.sum("total").over(every)).alias("error_share"))


def last_rows(rows: DataFrame, n: int, *keys: str, order: str = "Date") -> DataFrame:
    """The newest n rows of each group, numbered from the newest."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def fold_summary(scores: DataFrame) -> DataFrame:
    """One row from the scores by fold: mean, deviation, and the hardest fold over the easiest."""
    return scores.agg(F.avg("rmspe").alias("mean"), F.stddev_pop("rmspe").alias("deviation"), F.try_divide(F.max("rmspe"), F.min("rmspe")).alias("hardest_to_easiest"))


def worst_days(frame: DataFrame, k: int = 4) -> DataFrame:
    """The k days of each fold with the most squared error, and their share of the fold's."""
    days = frame.filter("Sales <> 0").groupBy("fold", "Date").agg(F.sum(squared_error()).alias("total"))
    place = F.row_number().over(W.partitionBy("fold").orderBy(F.desc("total"), "Date"))
    share = F.col("total") / F.sum("total").over(W.partitionBy("fold"))
    return days.select("fold", "Date", "total", share.alias("share"), place.alias("place")).filter(F.col("place") <= k)


def without_worst_days(frame: DataFrame, k: int = 2) -> DataFrame:
    """Each fold's score without its k worst days."""
    return frame.join(worst_days(frame, k).select("fold", "Date"), ["fold", "Date"], "left_anti").groupBy("fold").agg(rmspe_of().alias("rmspe"))


def on_worst_days(frame: DataFrame, arms: list[str], base: str, k: int = 8) -> DataFrame:
    """Every arm's score on the k worst days of the base arm, one column each."""
    days = frame.filter((F.col("arm") == base) & (F.col("Sales") != 0)).groupBy("Date").agg(F.sum(squared_error()).alias("total")).orderBy(F.desc("total"), "Date").limit(k).select("Date")
    return frame.join(days, "Date", "left_semi").groupBy("Date").pivot("arm", arms).agg(rmspe_of())


def pivoted(frame: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Scores with one column per given value."""
    return frame.groupBy(row).pivot(column, values).agg(rmspe_of())


def business(frame: DataFrame) -> DataFrame:
    """Misses in units and shares, and how often and by how much the forecast is high or low."""
    miss, rel = F.abs(F.col("prediction") - F.col("Sales")), relative_error()
    sold = frame.filter("Sales <> 0")
    each = F.array(*(F.struct(F.lit(n).alias("of"), v.cast("double").alias("value")) for n, v in (("sales", F.col("Sales")), ("miss", miss), ("share", F.abs(rel)))))
    cuts = quantiles(sold.select(F.inline(each)), ["of"], "value", {"half": 0.5, "nine_tenths": 0.9})
    cut = lambda of, share: F.max(F.when(F.col("of") == of, F.col(share)))
    cuts = cuts.agg(
        cut("sales", "half").alias("median_sales"), cut("miss", "half").alias("miss_median"), cut("miss", "nine_tenths").alias("miss_90"),
        cut("share", "half").alias("share_median"), cut("share", "nine_tenths").alias("share_90"),
    )
    rest = sold.agg(F.avg((rel > 0).cast("int")).alias("too_high"), F.avg((rel < 0).cast("int")).alias("too_low"), (F.sum("prediction") / F.sum("Sales") - 1).alias("bias"))
    return cuts.join(F.broadcast(rest))


def bias(frame: DataFrame, *cols: str) -> DataFrame:
    """Mean and median relative error by group; the groups may be few and large."""
    sold = frame.filter("Sales <> 0").select(*cols, relative_error().alias("rel"))
    means = sold.groupBy(*cols).agg(F.avg("rel").alias("mean_error"))
    return means.join(quantiles(sold, list(cols), "rel", {"median_error": 0.5}), list(cols), "left")


def size_quartiles(train: DataFrame) -> DataFrame:
    """Store and its quartile by mean sales of the training rows; a cut itself belongs to the upper one."""
    means = train.groupBy("Store").agg(F.avg("Sales").alias("mean_sales"))
    q1, q2, q3 = means.agg(F.percentile("mean_sales", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    m = F.col("mean_sales")
    return means.select("Store", F.when(m < q1, "Q1 small").when(m < q2, "Q2").when(m < q3, "Q3").otherwise("Q4 large").alias("size"))


def mean_of_seeds(frame: DataFrame) -> DataFrame:
    return frame.groupBy("Store", "Date").agg(F.max("Sales").alias("Sales"), F.avg("prediction").alias("prediction"))


def fold_correlation(frame: DataFrame, a: int, b: int) -> DataFrame:
    """One row: how a store's score in one fold goes with that in another, over stores that have both."""
    by_store = frame.groupBy("Store").pivot("fold", [a, b]).agg(rmspe_of())
    return by_store.agg(F.corr(str(a), str(b)).alias("correlation"), F.count_if(F.col(str(a)).isNotNull() & F.col(str(b)).isNotNull()).alias("stores"))


def fold_correlations(frame: DataFrame) -> DataFrame:
    """fold_a, fold_b, stores, correlation: how a store's score in one fold goes with that in another, for every pair of folds.

    A pair counts the stores that have both. A store's scores are one array, and
    all pairs are summed in one pass; a store has as many pairs as folds allow.
    """
    by_fold = frame.groupBy("Store", "fold").agg(rmspe_of().alias("score")).filter("score is not null")
    scores = by_fold.groupBy("Store").agg(F.sort_array(F.collect_list(F.struct("fold", "score"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y["fold"] > x["fold"]), lambda y: F.struct(x["fold"].alias("fold_a"), y["fold"].alias("fold_b"), x["score"].alias("x"), y["score"].alias("y")))))
    return scores.select(F.inline(pairs)).groupBy("fold_a", "fold_b").agg(F.count("*").alias("stores"), F.corr("x", "y").alias("correlation"))
