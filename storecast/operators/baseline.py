"""Median and year-ago baselines, all folds in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt
from .folds import fold_medians
from .validation import RollingOrigin

KEYS = ["Store", "DayOfWeek", "Promo"]


def median_rule(train: DataFrame, rows: DataFrame, by: list[str] | None = None, store_level: bool = True) -> DataFrame:
    """``rows`` with the median sales of their store, weekday and promotion; then of the store; then of all.

    ``by`` are keys, such as the fold, that stand on both sides.
    """
    by = by or []
    median = lambda keys, name: train.groupBy(*keys).agg(F.median("Sales").alias(name))
    out = rows.join(median([*by, *KEYS], "m_key"), [*by, *KEYS], "left")
    levels = ["m_key"]
    if store_level:
        out, levels = out.join(median([*by, "Store"], "m_store"), [*by, "Store"], "left"), [*levels, "m_store"]
    # Sales are whole numbers, so the task of a fold holds a count per distinct number, not its rows.
    if by:
        out = out.join(median(by, "m_all"), by, "left").withColumn("prediction", F.coalesce(*levels, "m_all"))
    else:
        out = out.withColumn("prediction", F.coalesce(*levels, F.lit(train.agg(F.median("Sales")).first()[0])))
    return out.drop("m_key", "m_store", "m_all")


def scored_folds(open_days: DataFrame, splitter: RollingOrigin | None = None, fixed_train: bool = False) -> DataFrame:
    """The validation rows of all folds with the median rule's prediction; ``fixed_train``: fold 1's training rows for all.

    All folds learn from one pass (:mod:`.folds`); only validation rows are
    matched with folds, as often as their windows overlap.
    """
    splitter = splitter or RollingOrigin()
    folds = splitter.folds(open_days).orderBy("fold").collect()  # a row a fold
    rows = open_days.count()
    learned = fold_medians(open_days, folds, rows)
    valid = splitter.assigned(open_days, "valid", folds).drop("role", "train_end", "valid_end")
    # By store like the statistics, so that the join moves nothing more.
    return learned.with_medians(dealt(valid, "Store", rows), F.lit(1) if fixed_train else F.col("fold"))


def year_ago(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Sales of the same weekday 364 days before; else the median rule without its store level. ``filled`` marks the latter."""
    shifted = history.select("Store", F.date_add("Date", 364).alias("Date"), F.col("Sales").alias("ago"))
    out = median_rule(history, rows, store_level=False).join(shifted, ["Store", "Date"], "left")
    return out.withColumns({"filled": F.col("ago").isNull(), "prediction": F.coalesce(F.col("ago").cast("double"), "prediction")}).drop("ago")
