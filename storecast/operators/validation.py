"""Rolling-origin folds: a few dates, joined to the rows by range."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FOLDS, HORIZON, MIN_TRAIN_DAYS


@dataclass(frozen=True)
class RollingOrigin:
    n_splits: int = FOLDS
    horizon_days: int = HORIZON
    step_days: int | None = None
    min_train_days: int = MIN_TRAIN_DAYS

    def __post_init__(self):
        if self.n_splits < 1 or self.horizon_days < 1 or (self.step_days or 1) < 1:
            raise ValueError("splits, horizon and step must be positive")

    def dates(self, first: date, last: date) -> list[tuple[int, date, date, date]]:
        """(fold, train_end, valid_start, valid_end), oldest first."""
        out = []
        for back in range(self.n_splits - 1, -1, -1):
            end = last - timedelta(back * (self.step_days or self.horizon_days))
            start = end - timedelta(self.horizon_days - 1)
            out.append((self.n_splits - back, start - timedelta(1), start, end))
        if (out[0][1] - first).days + 1 < self.min_train_days:
            raise ValueError(f"fold 1 has {(out[0][1] - first).days + 1} days of training, fewer than {self.min_train_days}")
        return out

    def folds(self, df: DataFrame) -> DataFrame:
        """One row per fold."""
        return df.sparkSession.createDataFrame(self.dates(*self._span(df)), "fold int, train_end date, valid_start date, valid_end date")

    @staticmethod
    def _span(df: DataFrame) -> tuple[date, date]:
        first, last = df.agg(F.min("Date"), F.max("Date")).first()
        if first is None:
            raise ValueError("no rows to split")
        return first, last

    def assigned(self, df: DataFrame, role: str | None = None, known: list | None = None) -> DataFrame:
        """The rows of every fold with fold and role ('train' or 'valid'); a row trains several folds.

        The folds are at most ``n_splits`` rows, so they are sent to all tasks.
        ``known`` are the rows of :meth:`folds`, where the caller has them.
        """
        folds = self.folds(df) if known is None else df.sparkSession.createDataFrame(known, "fold int, train_end date, valid_start date, valid_end date")
        folds = F.broadcast(folds.select("fold", "train_end", "valid_start", "valid_end"))
        train, valid = F.col("Date") <= F.col("train_end"), F.col("Date").between(F.col("valid_start"), F.col("valid_end"))
        out = df.join(folds, {None: train | valid, "train": train, "valid": valid}[role])
        return out.withColumn("role", F.when(F.col("Date") <= F.col("train_end"), "train").otherwise("valid"))

    def describe(self, df: DataFrame) -> DataFrame:
        counts = self.assigned(df.select("Date")).groupBy("fold", "train_end", "valid_start", "valid_end").agg(
            F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "valid").alias("valid_rows")
        )
        return counts


def check_windows(described: DataFrame) -> None:
    if described.filter("train_rows = 0 or valid_rows = 0").count():
        raise ValueError("a window has no rows")
