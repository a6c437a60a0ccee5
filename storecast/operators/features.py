"""Learned statistics and the full feature frame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar_parts, days_to_easter, month_columns
from ..functions.facts import competition, dummies, promo2
from ..schema import FAMILIES, MIN_REOPENED_ROWS, feature_names
from ..sources.tables import written
from .calendar import around, own_calendar, reopening


def store_means(train: DataFrame) -> DataFrame:
    return train.groupBy("Store").agg(F.avg("Sales").alias("store_mean_sales"))


def weekday_means(train: DataFrame) -> DataFrame:
    return train.groupBy("Store", "DayOfWeek").agg(F.avg("Sales").alias("store_dow_mean_sales"))


def promo_uplift(train: DataFrame) -> DataFrame:
    """Mean sales with promotion over mean sales without; null where a store lacks one side."""
    return train.groupBy("Store").agg(F.try_divide(F.avg(F.when(F.col("Promo") == 1, F.col("Sales"))), F.avg(F.when(F.col("Promo") == 0, F.col("Sales")))).alias("store_promo_uplift"))


def scalars(train: DataFrame) -> DataFrame:
    """One row: mean sales, mean uplift and median competition distance of the training rows."""
    uplift = F.try_divide(F.avg(F.when(F.col("Promo") == 1, F.col("Sales"))), F.avg(F.when(F.col("Promo") == 0, F.col("Sales"))))
    return train.agg(F.avg("Sales").alias("global_mean"), uplift.alias("global_uplift"), F.median("CompetitionDistance").alias("comp_dist_median"))


def since_reopening(train: DataFrame, calendar: DataFrame, least: int = MIN_REOPENED_ROWS) -> DataFrame:
    """The training rows since a store's newest reopening, where these are enough; all rows of other stores."""
    end = train.agg(F.max("Date")).first()[0]
    newest = reopening(calendar).filter((F.col("days_since_reopening") == 0) & (F.col("Date") <= F.lit(end))).groupBy("Store").agg(F.max("Date").alias("back"))
    # Stored, a row a store: the calendar's windows are computed once.
    after = train.select("Store", "Date").join(written(newest, "reopened"), "Store").filter("Date >= back")
    enough = written(after.groupBy("Store").agg(F.count("*").alias("n"), F.max("back").alias("back")).filter(F.col("n") >= least).select("Store", "back"), "reopened-enough")
    return train.join(enough, "Store", "left").filter("back is null or Date >= back").drop("back")


@dataclass
class Statistics:
    """What is learnt from training rows; never more than seven rows a store."""

    by_store: DataFrame
    by_weekday: DataFrame
    uplift: DataFrame
    global_mean: float
    global_uplift: float
    comp_dist_median: float | None
    #: One row per store with all three, where they were learnt together: Store, store_mean_sales, store_promo_uplift, weekday_means (a map).
    whole: DataFrame | None = None

    def join(self, df: DataFrame) -> DataFrame:
        """Left joins with the chain of fallbacks: weekday, store, all."""
        if self.whole is not None:
            rows = df.join(self.whole, "Store", "left").withColumn("store_dow_mean_sales", F.try_element_at("weekday_means", F.col("DayOfWeek").cast("int"))).drop("weekday_means")
        else:
            rows = df.join(self.by_store, "Store", "left").join(self.by_weekday, ["Store", "DayOfWeek"], "left").join(self.uplift, "Store", "left")
        rows = rows.withColumn("store_mean_sales", F.coalesce("store_mean_sales", F.lit(self.global_mean)))
        return rows.withColumns({"store_dow_mean_sales": F.coalesce("store_dow_mean_sales", "store_mean_sales"), "store_promo_uplift": F.coalesce("store_promo_uplift", F.lit(self.global_uplift))})

    def rounded(self, digits: int) -> Statistics:
        """What :meth:`join` gives rounded: a few numbers a store, in place of every row's."""
        r = lambda c: F.round(c, digits)
        scalar = ("global_mean", "global_uplift", "comp_dist_median")
        one = self.whole.sparkSession.range(1).select(*(r(F.lit(getattr(self, n)).cast("double")).alias(n) for n in scalar)).first()
        by_day = F.transform_values("weekday_means", lambda _, v: r(v))
        whole = self.whole.select("Store", *(r(c).alias(c) for c in ("store_mean_sales", "store_promo_uplift")), by_day.alias("weekday_means"))
        return replace(self, whole=whole, **{n: one[n] for n in scalar})


def statistics(train: DataFrame, calendar: DataFrame | None = None, facts: DataFrame | None = None) -> Statistics:
    """Means and uplifts; with a calendar, from the rows since a reopening. The scalars always use all rows.
    ``facts``: those of the stores, where the rows are without them.

    What is learnt of a store comes from one grouping of its weekdays and
    promotions, so a table in buckets by store is not moved.
    """
    one = scalars(train if facts is None else train.join(facts, "Store", "left")).first()
    own = since_reopening(train, calendar) if calendar is not None else train
    cells = own.groupBy("Store", "DayOfWeek", "Promo").agg(F.sum("Sales").alias("s"), F.count("Sales").alias("n"))
    total = lambda c, when=None: F.sum(F.col(c) if when is None else F.when(when, F.col(c)))
    days = cells.groupBy("Store", "DayOfWeek").agg(*(total(c, w).alias(f"{c}{k}") for c in "sn" for k, w in enumerate((None, F.col("Promo") == 1, F.col("Promo") == 0))))
    entry = F.when(F.col("DayOfWeek").isNotNull() & (F.col("n0") > 0), F.struct(F.col("DayOfWeek").cast("int").alias("key"), (F.col("s0") / F.col("n0")).alias("value")))
    ratio = lambda k: F.try_divide(F.sum(f"s{k}"), F.sum(f"n{k}"))
    whole = days.groupBy("Store").agg(ratio(0).alias("store_mean_sales"), F.try_divide(ratio(1), ratio(2)).alias("store_promo_uplift"), F.map_from_entries(F.collect_list(entry)).alias("weekday_means"))
    by_weekday = whole.select("Store", F.explode("weekday_means").alias("DayOfWeek", "store_dow_mean_sales"))
    return Statistics(whole.select("Store", "store_mean_sales"), by_weekday, whole.select("Store", "store_promo_uplift"), one.global_mean, one.global_uplift, one.comp_dist_median, whole)


@dataclass
class Features:
    """The feature frame for given statistics and a calendar with its closed days."""

    learned: Statistics
    calendar: DataFrame | None = None
    easter: bool = True
    with_reopening: bool = False
    month: bool = False
    promo2: bool = False
    customers: bool = False
    closure: bool | str = True

    def __post_init__(self):
        if self.with_reopening and self.calendar is None:
            raise ValueError("days since a reopening need a calendar")

    @classmethod
    def of(cls, learned: Statistics, calendar: DataFrame | None, families: dict) -> Features:
        """By the names of :data:`FAMILIES`."""
        if unknown := set(families) - set(FAMILIES):
            raise ValueError(f"no such feature family: {', '.join(sorted(unknown))}")
        own = {("with_reopening" if k == "reopening" else k): v for k, v in families.items()}
        return cls(learned, calendar, **own)

    @property
    def names(self) -> list[str]:
        return feature_names(closure=self.calendar is not None and self.closure, easter=self.easter, reopening=self.with_reopening, month=self.month, promo2=self.promo2, customers=self.customers)

    def transform(self, df: DataFrame, validate: bool = False) -> DataFrame:
        """The columns of ``df`` and the features; ``validate`` counts rows that the calendar lacks, which costs a job."""
        rows = dummies(promo2(competition(calendar_parts(df), self.learned.comp_dist_median)))
        rows = self.learned.join(rows)
        if self.calendar is not None:
            if validate and (n := df.select("Store", "Date").join(self.calendar.select("Store", "Date"), ["Store", "Date"], "left_anti").count()):
                raise ValueError(f"{n} rows are not in the calendar")
            rows = rows.join(around(self.calendar, self.with_reopening), ["Store", "Date"], "left")
        if self.easter:
            rows = rows.withColumn("days_to_easter", days_to_easter())
        return month_columns(rows) if self.month else rows

    def of_panel(self, panel: DataFrame, first: int, last: int, facts: DataFrame | None = None) -> DataFrame:
        """The open days of a panel that is its own calendar, with the features: windows in place of the join.

        ``panel`` and the ends as :func:`~.calendar.own_calendar` has them; all rows are covered, so there is nothing to validate.
        ``facts``: those of the stores, where the panel is without them; the windows then hold the days' columns alone.
        """
        rows = own_calendar(panel, first, last, bool(self.closure), self.with_reopening).filter("Open = 1")
        rows = rows if facts is None else rows.join(facts, "Store", "left")
        rows = self.learned.join(dummies(promo2(competition(calendar_parts(rows), self.learned.comp_dist_median))))
        if self.easter:
            rows = rows.withColumn("days_to_easter", days_to_easter())
        return month_columns(rows) if self.month else rows

    def check(self, df: DataFrame) -> None:
        if missing := [n for n in self.names if n not in df.columns]:
            raise ValueError(f"missing features: {', '.join(missing)}")


def mean_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """How far the store means move when learnt from other rows; stores that do not move are left out."""
    both = before.select("Store", F.col("store_mean_sales").alias("old")).join(after.select("Store", F.col("store_mean_sales").alias("new")), "Store")
    return both.select("Store", (F.col("new") / F.col("old") - 1).alias("shift")).filter(F.abs("shift") > 1e-6)
