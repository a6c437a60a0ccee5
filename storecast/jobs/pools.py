"""Spark jobs side by side from one driver."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def in_pools(spark: SparkSession, calls: dict[str, Callable[[], Any]], at_once: int) -> dict[str, Any]:
    """Every call's result, ``at_once`` of them at a time, each in the scheduler pool of its name.

    With spark.scheduler.mode=FAIR the pools share the executors; without it
    jobs queue in the order they are sent. The first error is raised once the
    calls under way have ended; those not begun then are not begun.
    """
    failed: list[BaseException] = []

    def one(item: tuple[str, Callable[[], Any]]) -> Any:
        if failed:
            return None
        sc = spark.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", item[0])
        try:
            return item[1]()
        except BaseException as error:
            failed.append(error)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    if not calls:
        return {}
    with ThreadPool(max(1, min(at_once, len(calls)))) as pool:
        found = pool.map(inheritable_thread_target(spark)(one), list(calls.items()), chunksize=1)
    if failed:
        raise failed[0]
    return dict(zip(calls, found, strict=True))


def side_by_side(spark: SparkSession, at_once: int, tasks: int) -> int:
    """How many fits of so many tasks each are run at a time: ``at_once``, unless together they had more than eight tasks a core.

    Each fit holds its rows in memory, and their parts are read again for every
    level of a tree: beyond the memory they would come from disk each time.
    Fits of fewer tasks leave cores idle between levels, which others use.
    """
    return max(1, min(at_once, 8 * spark.sparkContext.defaultParallelism // max(1, tasks)))
