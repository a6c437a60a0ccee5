"""Several approaches over several folds and seeds, and which to accept."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import given, rmspe_of
from .validation import RollingOrigin


def cv_results(scored: DataFrame, splitter: RollingOrigin, rows: DataFrame) -> DataFrame:
    """Dates, rows and score of each fold. A row with sales but no prediction is an error when the table is computed."""
    folds = splitter.folds(rows).select("fold", "valid_start", "valid_end")
    scored = scored.withColumn("prediction", F.when(F.col("Sales") != 0, given()).otherwise(F.col("prediction")))
    return scored.groupBy("fold").agg(F.count("*").alias("rows"), rmspe_of().alias("rmspe")).join(F.broadcast(folds), "fold").select("fold", "valid_start", "valid_end", "rows", "rmspe")


def run_cv(open_days: DataFrame, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], splitter: RollingOrigin | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and scored rows of a function of training and validation rows, one call per fold."""
    splitter = splitter or RollingOrigin()
    parts = []
    for f in splitter.folds(open_days).collect():  # a handful of rows
        out = fit_predict(open_days.filter(F.col("Date") <= F.lit(f.train_end)), open_days.filter(F.col("Date").between(F.lit(f.valid_start), F.lit(f.valid_end))))
        if "prediction" not in out.columns:
            raise ValueError("fit_predict must return a prediction column")
        parts.append(out.withColumn("fold", F.lit(f.fold)))
    scored = reduce(DataFrame.unionByName, parts)
    return cv_results(scored, splitter, open_days), scored


def compare(named: dict[str, DataFrame]) -> DataFrame:
    """The approaches' scores by fold side by side, and their means as the fold 'mean'."""
    if not named:
        raise ValueError("nothing to compare")
    rows = reduce(DataFrame.unionByName, [r.select(F.col("fold").cast("string").alias("fold"), "rmspe", F.lit(n).alias("name")) for n, r in named.items()])
    both = rows.unionByName(rows.withColumn("fold", F.lit("mean")))
    return both.groupBy("fold").pivot("name", list(named)).agg(F.avg("rmspe"))


def grid(scored: DataFrame) -> DataFrame:
    """rmspe by arm, seed and fold."""
    return scored.groupBy("arm", "seed", "fold").agg(rmspe_of().alias("rmspe"))


def arm_summary(scores: DataFrame) -> DataFrame:
    """Mean of each arm and its seed noise: the deviation of the seeds' means."""
    by_seed = scores.groupBy("arm", "seed").agg(F.avg("rmspe").alias("m"))
    return by_seed.groupBy("arm").agg(F.avg("m").alias("rmspe"), F.stddev_pop("m").alias("noise"))


def accepted(scores: DataFrame, base: str) -> DataFrame:
    """Per arm: the folds it is better on, and whether it beats the base on every one by more than the base's seed noise."""
    by_fold = scores.groupBy("arm", "fold").agg(F.avg("rmspe").alias("rmspe"))
    own = by_fold.filter(F.col("arm") == base).select("fold", F.col("rmspe").alias("base"))
    own = own.join(F.broadcast(arm_summary(scores).filter(F.col("arm") == base).select("noise")))
    delta = F.col("rmspe") - F.col("base")
    return by_fold.filter(F.col("arm") != base).join(F.broadcast(own), "fold").groupBy("arm").agg(F.count_if(delta < 0).alias("better_on"), F.count("*").alias("folds"), F.bool_and(delta < -F.col("noise")).alias("accepted"))
