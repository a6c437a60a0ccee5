"""Closed days, holidays and reopenings around each day of a store.

All frames of a function stand on one window by store and integer day, so
there is one exchange and one sort. A missing day is a closed day: range
frames over the day number give that without filling the axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..schema import CALENDAR, HOLIDAY_CAP, LONG_CLOSURE, REOPENING_CAP
from ..sources.tables import dealt, is_stored, written


def compact(df: DataFrame) -> DataFrame:
    return df.select(F.col("Store").cast("int").alias("Store"), "Date", F.col("Open").cast("int").alias("Open"), "StateHoliday")


def distinct_days(calendar: DataFrame) -> DataFrame:
    """One row per store and day, dealt by store: of repeated ones, open if any is, with the largest holiday letter.

    The exchange by store serves the windows that follow as well; a table in
    buckets by store needs none. A stored table is dealt by its number of rows.
    """
    if getattr(calendar, "_table", None):
        rows = calendar
    else:
        rows = dealt(calendar, "Store", calendar.count()) if is_stored(calendar) else calendar.repartition("Store")
    return rows.groupBy("Store", "Date").agg(F.max("Open").alias("Open"), F.max("StateHoliday").alias("StateHoliday"))


def last_per_key(df: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """Of several rows of a key the one with the highest priority."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(priority)))
    return df.withColumn("_place", first).filter("_place = 1").drop("_place")


def bounds(calendar: DataFrame) -> tuple[int, int]:
    """First and last day of the whole calendar, as day numbers."""
    return tuple(calendar.agg(F.min(F.unix_date("Date")), F.max(F.unix_date("Date"))).first())


def closure(calendar: DataFrame) -> DataFrame:
    """Store, Date and six columns: neighbours open, closed days within a week, days to holidays.

    At the edge of the whole calendar, where days are not known, a column is -1.
    A null StateHoliday is no holiday. One row per store and day, also where the calendar repeats one.
    """
    return around(calendar, with_reopening=False)


def around(calendar: DataFrame, with_reopening: bool = True, closed_days: int = LONG_CLOSURE, cap: int = REOPENING_CAP) -> DataFrame:
    """The columns of :func:`closure` and :func:`reopening` from one exchange and one sort.

    The days are stored first, unless ``calendar`` is a stored table: its ends
    and its number of rows are needed before the rows.
    """
    if not is_stored(calendar):
        calendar = written(calendar.select(*CALENDAR), "days")
    days = distinct_days(calendar)
    first, last = bounds(calendar)
    rows = days.select(*CALENDAR, F.unix_date("Date").alias("day"))
    newest = []
    if with_reopening:
        rows = rows.withColumns(reopened(F.lit(first - 1), closed_days))
        back = F.max("back").over(up_to_here())
        newest = [since_back(back, cap).alias("days_since_reopening")]
    return rows.select("Store", "Date", *neighbours(first, last), *newest)


def by_day() -> WindowSpec:
    return W.partitionBy("Store").orderBy("day")


def up_to_here() -> WindowSpec:
    return by_day().rowsBetween(W.unboundedPreceding, 0)


def neighbours(first: int, last: int) -> list[Column]:
    """The six columns of :func:`closure` for rows with ``day``, in a calendar of the days ``first`` to ``last``."""
    day, w = F.col("day"), by_day()
    open_days = lambda a, b: F.coalesce(F.sum("Open").over(w.rangeBetween(a, b)), F.lit(0))
    holiday = F.when(F.col("StateHoliday") != "0", day)
    to_next = F.min(holiday).over(w.rangeBetween(0, HOLIDAY_CAP)) - day
    since_last = day - F.max(holiday).over(w.rangeBetween(-HOLIDAY_CAP, 0))
    unless = lambda edge, x: F.when(edge, -1).otherwise(x).cast("int")
    return [
        unless(day == first, open_days(-1, -1)).alias("open_yesterday"), unless(day == last, open_days(1, 1)).alias("open_tomorrow"),
        unless(day + 7 > last, 7 - open_days(1, 7)).alias("closed_days_next_7"), unless(day - 7 < first, 7 - open_days(-7, -1)).alias("closed_days_last_7"),
        F.coalesce(to_next, F.lit(HOLIDAY_CAP)).cast("int").alias("days_to_next_holiday"), F.coalesce(since_last, F.lit(HOLIDAY_CAP)).cast("int").alias("days_since_last_holiday"),
    ]


def own_calendar(panel: DataFrame, first: int, last: int, closure: bool = True, with_reopening: bool = True) -> DataFrame:
    """A panel that is its own calendar with the columns of :func:`around`, and no join.

    ``panel`` holds every store's days, closed ones too, each once. In buckets
    by store it needs no exchange either. ``first`` and ``last`` are :func:`bounds`.
    """
    rows = panel.withColumn("day", F.unix_date("Date"))
    more = []
    if with_reopening:
        rows = rows.withColumns(reopened(F.lit(first - 1)))
        more = [since_back(F.max("back").over(up_to_here())).alias("days_since_reopening")]
    return rows.select(*panel.columns, *(neighbours(first, last) if closure else []), *more)


def reopened(open_before: Column, closed_days: int = LONG_CLOSURE) -> dict[str, Column]:
    """``back``: the day, where it ends a long closed stretch. ``open_before``: the last open day before the rows at hand."""
    day, is_open = F.col("day"), F.col("Open") == 1
    gap = day - F.coalesce(F.max(F.when(is_open, day)).over(by_day().rowsBetween(W.unboundedPreceding, -1)), open_before) - 1
    return {"back": F.when(is_open & (gap >= closed_days), day)}


def since_back(back: Column, cap: int = REOPENING_CAP) -> Column:
    return F.coalesce(F.least(F.col("day") - back, F.lit(cap)), F.lit(cap)).cast("int")


def reopening(calendar: DataFrame, closed_days: int = LONG_CLOSURE, cap: int = REOPENING_CAP) -> DataFrame:
    """Days since a store's newest closed stretch of at least ``closed_days`` ended, cut at the cap (also without any).

    A stretch from the calendar's start counts; one up to its end has not ended. Repeated days count once.
    """
    return around(calendar, True, closed_days, cap).select("Store", "Date", "days_since_reopening")


def neighbouring_rows(calendar: DataFrame) -> DataFrame:
    """Open of the store's previous and next row, which may be more than a day away."""
    w = W.partitionBy("Store").orderBy("Date")
    return calendar.select("Store", "Date", "Open", F.lag("Open").over(w).alias("open_before"), F.lead("Open").over(w).alias("open_after"))


def promo_block(rows: DataFrame) -> DataFrame:
    """The place of a row in its run of equal Promo, over the rows as they are."""
    w = W.partitionBy("Store").orderBy("Date")
    change = F.when(F.lag("Promo").over(w).eqNullSafe(F.col("Promo")), 0).otherwise(1)
    runs = rows.select("Store", "Date", "Promo", change.alias("change")).withColumn("run", F.sum("change").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.select("Store", "Date", "Promo", "run", F.row_number().over(W.partitionBy("Store", "run").orderBy("Date")).alias("place"))


def nearest_holiday(calendar: DataFrame, none: int = 99) -> DataFrame:
    """Days to the store's closest holiday, before or after; ``none`` without any."""
    w = W.partitionBy("Store").orderBy("day")
    holiday = F.when(F.col("StateHoliday") != "0", F.col("day"))
    past = F.col("day") - F.max(holiday).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.min(holiday).over(w.rowsBetween(0, W.unboundedFollowing)) - F.col("day")
    return calendar.select(*CALENDAR, F.unix_date("Date").alias("day")).select("Store", "Date", F.coalesce(F.least(past, ahead), F.lit(none)).cast("int").alias("holiday_gap"))


def extended(known: DataFrame, plan: DataFrame, context_days: int = HOLIDAY_CAP, request: DataFrame | None = None) -> DataFrame:
    """The plan with what is known of the request's stores from ``context_days`` before the first day of either on; the plan wins.

    Without a request the plan is one. One row per store and day, as :func:`distinct_days` has it.
    """
    asked = plan.select("Store", "Date") if request is None else request.select("Store", "Date")
    first = asked.select("Date").unionByName(plan.select("Date")).agg(F.min("Date")).first()[0]
    own = compact(known).filter(F.col("Date") >= F.date_sub(F.lit(first), context_days)).join(asked.select("Store").distinct(), "Store", "left_semi")
    rows = own.withColumn("_planned", F.lit(0)).unionByName(compact(plan).withColumn("_planned", F.lit(1)))
    best = rows.groupBy("Store", "Date").agg(F.max(F.struct("_planned", "Open", "StateHoliday")).alias("x"))
    return best.select("Store", "Date", "x.Open", "x.StateHoliday")


def without_day_before(rows: DataFrame, calendar: DataFrame, train_end) -> DataFrame:
    """Rows after the end of training whose previous day the calendar lacks."""
    later = rows.filter(F.col("Date") > F.lit(train_end)).select("Store", "Date")
    day_after = calendar.select("Store", F.date_add("Date", 1).alias("Date"))
    return later.join(day_after, ["Store", "Date"], "left_anti")


def check_neighbours(rows: DataFrame, calendar: DataFrame, train_end) -> None:
    n = without_day_before(rows, calendar, train_end).count()
    if n:
        raise ValueError(f"{n} rows have no previous day in the calendar; give a plan of the days between")
