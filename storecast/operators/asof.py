"""As-of join: every row with the newest event of its key before it, or the next one after it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written


def _number(df: DataFrame, name: str) -> Column:
    """A date as days, a timestamp as microseconds, a number as it is."""
    kind = dict(df.dtypes)[name]
    return {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, lambda c: c)(F.col(name))


def asof(
    rows: DataFrame, events: DataFrame, by: list[str], at: str, columns: list[str], *, direction: str = "backward", tolerance: float | timedelta | None = None,
    strict: bool = False, prefix: str = "event_",
) -> DataFrame:
    """``rows`` with the time and the ``columns`` of one event each, named with ``prefix``; nulls where there is none.

    ``direction`` "backward" takes the newest event at or before the row,
    "forward" the first at or after it; ``strict`` leaves events at the row's
    own time out. Of events at the same time the one with the largest columns
    counts. An event further than ``tolerance`` (days, a timedelta, or the unit
    of a number) counts as none. Rows whose key or time is null match nothing
    and stay; such events do not count. Both tables have ``by`` and ``at``.

    Rows and events are dealt together by ranges of key and time, so a key with
    very many rows, or a moment with very many, is spread over tasks; only
    rows that repeat each other in every column stay together. What a range
    needs of those before it is one event for the key that goes on across its
    border: a table of two rows a range, sent to all tasks. The dealt table
    stays in the shared folder, since the result reads it.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    sign = 1 if direction == "backward" else -1
    keys = [f"_k{i}" for i in range(len(by))]
    own = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    event = F.struct(*(F.col(c).alias(f"{prefix}{c}") for c in [at, *columns]))
    left = rows.select(*own, (sign * _number(rows, at)).alias("_t"), F.lit(int(not strict)).alias("_tag"), F.struct(*rows.columns).alias("_row"), F.xxhash64(*rows.columns).alias("_salt"))
    known = events.filter(" and ".join(f"`{c}` is not null" for c in [*by, at]))
    right = known.select(*own, (sign * _number(events, at)).alias("_t"), F.lit(int(strict)).alias("_tag"), event.alias("_event"), F.lit(0).cast("long").alias("_salt"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = ["_t", "_tag", "_event", "_salt"]
    dealt = written(both.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "asof")

    # The keys that a range begins or ends with, and the newest event of each in each range.
    ends = dealt.groupBy("_range").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"))
    border = ends.select(F.explode(F.array("low", "high")).alias("k")).select("k.*").dropna().distinct()
    newest = F.max(F.when(F.col("_event").isNotNull(), F.struct("_t", "_tag", "_event")))
    each = dealt.join(F.broadcast(border), keys, "left_semi").groupBy(*keys, "_range").agg(newest.alias("_newest"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = each.select(*(F.col(k).alias(f"_of{k}") for k in keys), F.col("_range").alias("_of"), F.last("_newest", ignorenulls=True).over(earlier)["_event"].alias("_carried")).filter("_carried is not null")
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same &= F.col(k) == F.col(f"_of{k}")

    here = W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = dealt.withColumn("_found", F.last("_event", ignorenulls=True).over(here)).filter("_row is not null").join(F.broadcast(carried), same, "left")
    found = found.select("_row", "_t", F.coalesce("_found", "_carried").alias("_event"))
    if tolerance is not None:
        event_at = f"{prefix}{at}"
        unpacked = found.select("_row", "_t", "_event", F.col(f"_event.{event_at}").alias(event_at))
        if isinstance(tolerance, timedelta):
            tolerance = tolerance / timedelta(microseconds=1) if dict(events.dtypes)[at] == "timestamp" else tolerance / timedelta(days=1)
        near = F.abs(F.col("_t") - sign * _number(unpacked, event_at)) <= tolerance
        found = unpacked.withColumn("_event", F.when(near, F.col("_event")))
    return found.select("_row.*", *(F.col(f"_event.{prefix}{c}").alias(f"{prefix}{c}") for c in [at, *columns]))
