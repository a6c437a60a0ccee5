"""Statistics of all folds' training rows in one pass over the panel.

The folds' training ends cut the days into blocks: block 0 is what all folds
train on, block k what folds k + 1 and later have besides. Rows are counted
once, by block (:func:`counted`); such counts add up, so a table of them can be
kept and extended. A fold's statistics are those of the blocks before it: one
running sum over the blocks of a key, an array with an entry a fold, in place
of a copy of the rows for every fold that trains on them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt
from .features import Statistics
from .validation import RollingOrigin

KEYS = ["Store", "DayOfWeek", "Promo"]


def block_of(ends: list, date: str = "Date") -> Column:
    """The number of training ends before the day: 0 for days that all folds train on, ``len(ends)`` for days that none does."""
    return sum(((F.col(date) > F.lit(e)).cast("int") for e in ends), F.lit(0))


def counted(rows: DataFrame, ends: list, *keys: str, value: str = "Sales") -> DataFrame:
    """``keys``, block, the value and how many training rows have them: sums, counts and medians follow from it.

    Two such tables with the same ends are put together by adding up ``n``.
    """
    own = rows.select(*keys, value, block_of(ends).cast("int").alias("block")).filter(F.col("block") < len(ends))
    return own.groupBy(*keys, "block", value).agg(F.count("*").alias("n"))


def by_fold(partials: DataFrame, n_folds: int, *keys: str, value: str = "Sales") -> DataFrame:
    """``keys``, the value and ``n``: an array with the number of training rows of each fold that have it."""
    upto = F.array(*(F.sum(F.when(F.col("block") < f, F.col("n")).otherwise(0)) for f in range(1, n_folds + 1)))
    return partials.groupBy(*keys, value).agg(upto.alias("n"))


def _per_fold(n_folds: int, of) -> Column:
    """An aggregate for each fold, from the number of times that a row counts in it, as an array."""
    return F.array(*(of(F.get("n", F.lit(f))) for f in range(n_folds)))


def mean_of(when: Column | None = None):
    """The mean of Sales over rows that count ``n`` times; null without any."""
    known = F.col("Sales").isNotNull() if when is None else F.col("Sales").isNotNull() & when
    return lambda n: F.try_divide(F.sum(F.when(known, F.col("Sales") * n)), F.sum(F.when(known, n)))


def median_of(n: Column, value: str = "Sales") -> Column:
    """The median over rows that count ``n`` times; null without any."""
    return F.percentile(value, 0.5, n)


@dataclass
class FoldStatistics:
    """What every fold has learnt: one row per store and one row for all stores. Arrays have an entry per fold.

    ``by_store``: Store, means, uplifts, medians (arrays), and the maps
    weekday_means (of DayOfWeek) and key_medians (of DayOfWeek and Promo), at
    most seven and a few dozen entries. ``overall``: means, uplifts, medians.
    ``distance``: medians of the competition distance, where rows have one.
    """

    folds: list
    by_store: DataFrame
    overall: DataFrame
    distance: DataFrame | None

    def of_fold(self, fold: int) -> Statistics:
        """The statistics that the features of one fold stand on."""
        at = F.lit(fold - 1)
        one = self.overall.select(F.get("means", at).alias("mean"), F.get("uplifts", at).alias("uplift")).first()
        far = self.distance.select(F.get("medians", at)).first()[0] if self.distance is not None else None
        own = lambda df, c, name: df.withColumn(name, F.get(c, at)).filter(F.col(name).isNotNull())
        days = self.by_store.select("Store", F.explode("weekday_means").alias("DayOfWeek", "x"))
        return Statistics(
            own(self.by_store, "means", "store_mean_sales").select("Store", "store_mean_sales"), own(days, "x", "store_dow_mean_sales").select("Store", "DayOfWeek", "store_dow_mean_sales"),
            own(self.by_store, "uplifts", "store_promo_uplift").select("Store", "store_promo_uplift"), one["mean"], one["uplift"], far,
        )

    def with_medians(self, valid: DataFrame, fold: Column) -> DataFrame:
        """Rows with a fold and the prediction of the median rule: of store, weekday and promotion, then of the store, then of all."""
        key = F.when(F.col("DayOfWeek").isNotNull() & F.col("Promo").isNotNull(), _weekday_and_promo())
        at = fold - 1
        own = self.by_store.select("Store", F.col("medians").alias("_store"), F.col("key_medians").alias("_keys"))
        # One row: it is sent to all tasks whatever the size of the panel.
        rows = valid.join(own, "Store", "left").crossJoin(F.broadcast(self.overall.select(F.col("medians").alias("_all"))))
        found = F.when(key.isNotNull(), F.try_element_at("_keys", key))
        return rows.withColumn("prediction", F.coalesce(F.get(found, at), F.get("_store", at), F.get("_all", at))).drop("_store", "_keys", "_all")


def _weekday_and_promo() -> Column:
    return F.struct(F.col("DayOfWeek").cast("int").alias("DayOfWeek"), F.col("Promo").cast("int").alias("Promo"))


def _medians(rows: Column, n_folds: int) -> Column:
    """The median of each fold from sorted rows of (Sales, block), as an array; null without any."""
    upto = lambda f: F.filter(rows, lambda x: x["block"] <= f)
    sales = F.array(*(F.transform(upto(f), lambda x: x["Sales"]) for f in range(n_folds)))
    at = lambda x, place: F.get(x, F.floor(place).cast("int"))
    return F.transform(sales, lambda x: 0.5 * at(x, (F.size(x) - 1) / 2) + 0.5 * at(x, F.size(x) / 2))


def fold_medians(open_days: DataFrame, folds: list, rows: int) -> FoldStatistics:
    """The medians alone: what the median rule stands on. ``rows`` is the number of open days.

    The rows are dealt by store once; those of a store, one a day, are an array
    by weekday and promotion, sorted, and then one of the whole store. All folds
    take their middle rows from it. No task holds more than its share of stores.
    """
    n, ends = len(folds), [f.train_end for f in folds]
    train = open_days.select(*KEYS, "Sales", block_of(ends).cast("int").alias("block")).filter((F.col("block") < n) & F.col("Sales").isNotNull())
    keys = dealt(train, "Store", rows).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("Sales", "block"))).alias("rows"))
    known = F.col("DayOfWeek").isNotNull() & F.col("Promo").isNotNull()
    entry = F.when(known, F.struct(_weekday_and_promo().alias("key"), _medians(F.col("rows"), n).alias("x")))
    by_store = keys.groupBy("Store").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"), F.map_from_entries(F.collect_list(entry)).alias("key_medians"))
    by_store = by_store.select("Store", _medians(F.col("rows"), n).alias("medians"), "key_medians")
    # Over all stores: a row per distinct number, summed before it is sent.
    whole = by_fold(counted(open_days.filter(F.col("Sales").isNotNull()), ends), n)
    return FoldStatistics(folds, by_store, whole.agg(_per_fold(n, median_of).alias("medians")), None)


def fold_means(open_days: DataFrame, folds: list) -> FoldStatistics:
    """Means, uplifts and the distances' medians alone: what the model's features stand on. Without the medians of sales.

    Sales are summed by store, weekday, promotion and block, a few dozen rows a store, in place of a row for every number sold.
    """
    n, ends = len(folds), [f.train_end for f in folds]
    own = open_days.select(*KEYS, "Sales", block_of(ends).cast("int").alias("block")).filter(F.col("block") < n)
    cells = own.groupBy(*KEYS, "block").agg(F.sum("Sales").alias("s"), F.count("Sales").alias("n"))

    def mean(f: int, *when: Column) -> Column:
        upto = reduce(Column.__and__, when, F.col("block") <= f)
        return F.try_divide(F.sum(F.when(upto, F.col("s"))), F.sum(F.when(upto, F.col("n"))))

    promo, base = F.col("Promo") == 1, F.col("Promo") == 0
    means = F.array(*(mean(f) for f in range(n)))
    levels = [means.alias("means"), F.array(*(F.try_divide(mean(f, promo), mean(f, base)) for f in range(n))).alias("uplifts")]
    entry = F.when(F.col("DayOfWeek").isNotNull(), F.struct(F.col("DayOfWeek").cast("int").alias("key"), "x"))
    days = cells.groupBy("Store", "DayOfWeek").agg(means.alias("x")).groupBy("Store").agg(F.map_from_entries(F.collect_list(entry)).alias("weekday_means"))
    far = None
    if (at := "CompetitionDistance") in open_days.columns:
        far = by_fold(counted(open_days, ends, value=at), n, value=at).agg(_per_fold(n, lambda k: median_of(k, at)).alias("medians"))
    return FoldStatistics(folds, cells.groupBy("Store").agg(*levels).join(days, "Store", "left"), cells.agg(*levels), far)


def fold_statistics(open_days: DataFrame, splitter: RollingOrigin | None = None, folds: list | None = None) -> FoldStatistics:
    """From the open days of all folds; ``folds`` are the splitter's, if they are known already.

    The training rows are read and dealt by store once. Null weekdays and
    promotions have no mean or median of their own; null sales count nowhere.
    """
    folds = folds or (splitter or RollingOrigin()).folds(open_days).orderBy("fold").collect()  # a row a fold
    n, ends = len(folds), [f.train_end for f in folds]
    # Dealt by store before rows are counted, so that all up to the row of a store stays where it is.
    numbers = by_fold(counted(open_days.repartition("Store"), ends, *KEYS), n, *KEYS)
    promo, base = F.col("Promo") == 1, F.col("Promo") == 0
    uplift = lambda k: F.try_divide(mean_of(promo)(k), mean_of(base)(k))
    levels = [_per_fold(n, mean_of()).alias("means"), _per_fold(n, uplift).alias("uplifts"), _per_fold(n, median_of).alias("medians")]

    def mapped(name: str, known: Column, key: Column, keys: list[str], of) -> DataFrame:
        # Null keys are left out here and not before, so that all levels read the same exchange.
        each = numbers.groupBy("Store", *keys).agg(_per_fold(n, of).alias("x"))
        return each.groupBy("Store").agg(F.map_from_entries(F.collect_list(F.when(known, F.struct(key.alias("key"), "x")))).alias(name))

    days = mapped("weekday_means", F.col("DayOfWeek").isNotNull(), F.col("DayOfWeek").cast("int"), ["DayOfWeek"], mean_of())
    keys = mapped("key_medians", F.col("DayOfWeek").isNotNull() & F.col("Promo").isNotNull(), _weekday_and_promo(), ["DayOfWeek", "Promo"], median_of)
    by_store = numbers.groupBy("Store").agg(*levels).join(days, "Store", "left").join(keys, "Store", "left")
    # Over all stores: a row per distinct number and promotion, summed before it is sent.
    whole = numbers.groupBy("Promo", "Sales").agg(F.array(*(F.sum(F.get("n", F.lit(f))) for f in range(n))).alias("n"))
    far = None
    if "CompetitionDistance" in open_days.columns:
        at = "CompetitionDistance"
        far = by_fold(counted(open_days, ends, value=at), n, value=at).agg(_per_fold(n, lambda k: median_of(k, at)).alias("medians"))
    return FoldStatistics(folds, by_store, whole.agg(*levels), far)
