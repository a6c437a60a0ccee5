"""A calendar that is kept up to date: new days are added to months on disk, nothing is built anew.

Days stand in folders by month with all their columns. A new week changes what
lies ahead of the last days before it, and no other old column: only the months
of these days are read and written again. What the columns need of the far past
is carried as one row per store: its last open day and its newest reopening.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import bounds, compact, distinct_days, neighbours, reopened, since_back, up_to_here
from ..schema import HOLIDAY_CAP, REOPENING_CAP
from ..sources import versions
from ..sources.tables import dropped, written

DAYS = "Store int, Date date, Open int, StateHoliday string, open_yesterday int, open_tomorrow int, closed_days_next_7 int, closed_days_last_7 int, days_to_next_holiday int, days_since_last_holiday int, days_since_reopening int"
STATE = "Store int, last_open int, back int"
EPOCH = date(1970, 1, 1)
#: Columns look so many days ahead and back at most.
REACH = HOLIDAY_CAP


def _month() -> Column:
    return F.date_format("Date", "yyyy-MM").alias("month")


@dataclass
class CalendarStore:
    """Months under ``path``/months, versions of the carried state under ``path``."""

    spark: SparkSession
    path: str

    def manifest(self) -> dict | None:
        """first and last day number and the state's folder, as of the newest whole update."""
        return versions.latest(self.spark, self.path)

    def days(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """The days from ``start`` to ``end``, with the columns of :func:`~..operators.calendar.around`. Months outside are not read.

        An update replaces files: a table asked for before it must be asked for again.
        """
        known = self.manifest()
        if known is None:
            return self.spark.createDataFrame([], DAYS)
        last = EPOCH + timedelta(known["last"])
        end = min(end or last, last)
        rows = self.spark.read.schema(f"{DAYS}, month string").parquet(f"{self.path}/months").filter(F.col("month") <= F.lit(f"{end:%Y-%m}"))
        if start:
            rows = rows.filter((F.col("month") >= F.lit(f"{start:%Y-%m}")) & (F.col("Date") >= F.lit(start)))
        # Days after the last are those of an update that did not end.
        return rows.filter(F.col("Date") <= F.lit(end)).drop("month")

    def state(self) -> DataFrame:
        """By store the last open day and the newest reopening, as day numbers."""
        known = self.manifest()
        return self.spark.read.schema(STATE).parquet(f"{known['folder']}/state") if known else self.spark.createDataFrame([], STATE)

    def _write_months(self, rows: DataFrame) -> None:
        """Replace the months of ``rows`` by them, dealt by month and store so that no task holds a month."""
        month = rows.select("*", _month()).repartition("month", F.pmod(F.xxhash64("Store"), F.lit(64)))
        month.sortWithinPartitions("month", "Store", "Date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{self.path}/months")

    def add(self, new: DataFrame) -> int:
        """Add days after the last one known (all days, where none is); the number of rows added.

        ``new`` has Store, Date, Open and StateHoliday; rows that repeat a day
        count as :func:`~..operators.calendar.distinct_days` has it. Days that
        are known already are an error: build another store for a corrected
        past. An update that ended early changes nothing that :meth:`days`
        gives but the columns that look ahead, and is put right when it is run
        again. No rows: nothing changes.
        """
        new = written(distinct_days(compact(new)), "new-days")
        low, high = bounds(new)
        if low is None:
            dropped(new)
            return 0
        known = self.manifest()
        if known and low <= known["last"]:
            raise ValueError(f"days up to {EPOCH + timedelta(known['last'])} are known already")
        first = known["first"] if known else low
        carried = self.state().select("Store", F.col("last_open").alias("_open"), F.col("back").alias("_back"))
        # What is old and new side by side: for the columns that look ahead and back.
        since = EPOCH + timedelta((known["last"] if known else low) - 2 * REACH)
        tag = lambda df, is_new: df.select("Store", "Date", "Open", "StateHoliday", F.unix_date("Date").alias("day"), F.lit(is_new).alias("_new"))
        both = tag(self.days(since), False).unionByName(tag(new, True)).repartition("Store")
        ahead = both.select("*", *neighbours(first, high)).filter(F.col("_new") | (F.col("day") > (known["last"] if known else low) - REACH))
        # Reopenings look back only, so old days keep theirs; new ones go on from the store's row.
        fresh = new.withColumn("day", F.unix_date("Date")).join(carried, "Store", "left").repartition("Store")
        fresh = fresh.withColumns(reopened(F.coalesce("_open", F.lit(first - 1))))
        fresh = written(fresh.withColumn("_newest", F.coalesce(F.max("back").over(up_to_here()), "_back")), "reopened")
        newest = fresh.select("Store", "Date", since_back(F.col("_newest"), REOPENING_CAP).alias("days_since_reopening"))
        edge = since + timedelta(REACH)
        month_start = edge.replace(day=1) if known else None
        old = self.days(month_start)
        kept = old.filter(F.col("Date") <= F.lit(edge))
        changed = ahead.filter("not _new").drop("day", "_new").join(old.select("Store", "Date", "days_since_reopening"), ["Store", "Date"])
        added = ahead.filter("_new").drop("day", "_new").join(newest, ["Store", "Date"])
        order = [c.split()[0] for c in DAYS.split(", ")]
        # Stored first: the months that are read here are the ones written over.
        rows = written(kept.select(order).unionByName(changed.select(order)).unionByName(added.select(order)), "months")
        self._write_months(rows)
        folder = versions.new_folder(self.path)
        now = fresh.groupBy("Store").agg(F.max(F.when(F.col("Open") == 1, F.col("day"))).alias("_o"), F.max("back").alias("_b"))
        state = self.state().join(now, "Store", "full_outer").select("Store", F.coalesce("_o", "last_open").alias("last_open"), F.coalesce("_b", "back").alias("back"))
        state.write.parquet(f"{folder}/state")
        versions.commit(self.spark, self.path, folder, {"first": first, "last": high})
        added = new.count()
        for table in (new, fresh, rows):
            dropped(table)
        return added
