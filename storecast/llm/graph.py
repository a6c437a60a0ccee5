"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node but the roots; root is the smallest node of the component.

    Alternates large-star and small-star steps: every node points its larger
    neighbours, then all its neighbours, at the smallest one, until nothing
    changes. A step sends each link a bounded number of times, whatever the
    size of the component, and no neighbourhood is collected.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "star-centres").withColumnRenamed("u", "c")

    def summary(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    step = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "links")
    before = summary(step)
    while before[0]:
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = smallest(both)
        large = written(both.filter("v > u").join(centre, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large-star")
        centre2 = smallest(large)
        small = large.join(centre2, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        after = written(small.select("x.u", "x.v").filter("u != v").distinct(), "small-star")
        for old in (step, centre, large, centre2):
            dropped(old)
        step, now = after, summary(after)
        if now == before:
            break
        before = now
    return step.select(F.col("u").alias("node"), F.col("v").alias("root"))
