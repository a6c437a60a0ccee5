"""Groups of stores that behave alike: small cells merged, cells clustered, groups numbered by uplift.

Stores are summed by cell in Spark; what reaches the driver is one row per
cell, 36 at most by construction (4 x 3 x 3 bins), whatever the number of stores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .profiles import RATIOS, cells, long_history, moments, profiles, standardised


def merged_cells(count: dict[int, int], total: dict[int, np.ndarray], least: int, keep: int) -> dict[int, int]:
    """The cell each small cell goes to: the smallest first, to the nearest centre, until all have ``least`` stores or ``keep`` are left."""
    count, total, to = dict(count), {k: v.copy() for k, v in total.items()}, {k: k for k in count}
    while len(count) > keep:
        small = min(count, key=lambda k: (count[k], k))
        if count[small] >= least:
            break
        centre = total[small] / count[small]
        near = min((k for k in count if k != small), key=lambda k: (float(((total[k] / count[k] - centre) ** 2).sum()), k))
        count[near] += count.pop(small)
        total[near] += total.pop(small)
        to = {k: near if v == small else v for k, v in to.items()}
    return to


def ward(points: np.ndarray, groups: int) -> list[int]:
    """Ward's agglomeration of a few points, each of weight one, into so many groups."""
    members = {k: [k] for k in range(len(points))}
    cost = {(i, j): float(((points[i] - points[j]) ** 2).sum()) for i in members for j in members if i < j}
    while len(members) > groups:
        i, j = min(cost, key=lambda p: (cost[p], p))
        between = cost.pop((i, j))
        ni, nj = len(members[i]), len(members[j])
        for k in members:
            if k not in (i, j):
                nk = len(members[k])
                a, b = cost.pop((min(i, k), max(i, k))), cost.pop((min(j, k), max(j, k)))
                cost[min(i, k), max(i, k)] = ((ni + nk) * a + (nj + nk) * b - nk * between) / (ni + nj + nk)
        members[i] += members.pop(j)
    out = [0] * len(points)
    for g, (_, own) in enumerate(sorted(members.items())):
        for p in own:
            out[p] = g
    return out


@dataclass
class Segmenter:
    assignment: DataFrame
    default: int

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with their store's segment; an unknown store gets the largest."""
        return df.join(self.assignment, "Store", "left").withColumn("segment", F.coalesce("segment", F.lit(self.default)))


def segmenter(train: DataFrame, n_segments: int = 4, min_days: int = 365, min_cell_stores: int = 15) -> Segmenter:
    prof = profiles(train).persist()
    full = long_history(prof, min_days)
    if full.count() < n_segments * min_cell_stores:
        raise ValueError(f"fewer than {n_segments * min_cell_stores} stores have {min_days} days")
    by = moments(full)
    z = [f"z_{c}" for c in RATIOS]
    stores = standardised(full, by).join(cells(full), "Store")
    rows = stores.groupBy("cell").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in z)).collect()
    count, total = {r.cell: r.n for r in rows}, {r.cell: np.array([r[c] for c in z]) for r in rows}
    to = merged_cells(count, total, min_cell_stores, n_segments)
    left = sorted(set(to.values()))
    centre = {k: sum(total[c] for c in to if to[c] == k) / sum(count[c] for c in to if to[c] == k) for k in left}
    group = dict(zip(left, ward(np.array([centre[k] for k in left]), n_segments), strict=True))
    cell_group = train.sparkSession.createDataFrame([(c, group[k]) for c, k in to.items()], "cell int, grp int")
    grouped = stores.join(F.broadcast(cell_group), "cell")
    summary = grouped.groupBy("grp").agg(F.avg("raw_uplift").alias("uplift"), *(F.avg(c).alias(c) for c in z)).collect()
    # Group numbers by falling uplift; at most n_segments rows.
    order = sorted(summary, key=lambda r: (-r.uplift, r.grp))
    number = {r.grp: k + 1 for k, r in enumerate(order)}
    own = grouped.select("Store", F.create_map(*[F.lit(x) for kv in number.items() for x in kv])[F.col("grp")].alias("segment"))
    short = standardised(prof.filter(F.col("days") < min_days), by)
    away = [sum(((F.col(c) - float(r[c])) * (F.col(c) - float(r[c])) for c in z), F.lit(0.0)) for r in order]
    nearest = F.array_position(F.array(*away), F.array_min(F.array(*away))).cast("int")
    assignment = own.unionByName(short.select("Store", nearest.alias("segment"))).persist()
    return Segmenter(assignment, largest(assignment))


def largest(assignment: DataFrame) -> int:
    return assignment.groupBy("segment").count().orderBy(F.desc("count"), "segment").first().segment


def sizes(assignment: DataFrame) -> DataFrame:
    """Stores of each segment, and which is the largest (the lower number of equals)."""
    first = F.row_number().over(W.orderBy(F.desc("stores"), "segment")) == 1
    return assignment.groupBy("segment").agg(F.count("*").alias("stores")).withColumn("is_default", first)


def summary(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Sales and stores of each segment, their shares, and the lift of the one over the other."""
    groups = rows.join(assignment, "Store").groupBy("segment").agg(F.sum("Sales").alias("sales"), F.count_distinct("Store").alias("stores"))
    every = W.partitionBy()
    out = groups.withColumns({"sales_share": F.col("sales") / F.sum("sales").over(every), "store_share": F.col("stores") / F.sum("stores").over(every)})
    return out.withColumn("lift", F.col("sales_share") / F.col("store_share"))


def described(prof: DataFrame, assignment: DataFrame) -> DataFrame:
    return prof.join(assignment, "Store").groupBy("segment").agg(F.count("*").alias("stores"), F.round(F.avg("mean_sales"), 0).alias("mean_sales"), *(F.round(F.avg(c), 3).alias(c) for c in RATIOS))


def type_counts(rows: DataFrame, assignment: DataFrame, types: list[str]) -> DataFrame:
    """Stores by segment and type, with zeros."""
    return rows.select("Store", "StoreType").distinct().join(assignment, "Store").groupBy("segment").pivot("StoreType", types).count().fillna(0)


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labelings of the same stores."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    cell = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cell.agg(pairs("n").alias("both"), F.sum("n").alias("all"))
    rows = cell.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("in_a"))
    cols = cell.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("in_b"))
    one = both.join(F.broadcast(rows)).join(F.broadcast(cols))
    expected = F.col("in_a") * F.col("in_b") / (F.col("all") * (F.col("all") - 1) / 2)
    top, bottom = F.col("both") - expected, (F.col("in_a") + F.col("in_b")) / 2 - expected
    return one.select(F.coalesce(F.try_divide(top, bottom), F.lit(1.0)).alias("ari"))


def one_hot(df: DataFrame, n_segments: int) -> DataFrame:
    """The segment as 0/1 columns, for a global model that knows it."""
    return df.withColumns({f"segment_{k}": (F.col("segment") == k).cast("int") for k in range(1, n_segments + 1)})


def stable_share(labels: DataFrame) -> DataFrame:
    """One row: of the stores with a label in every fold, how many always have the same, and their share."""
    folds = F.lit(labels.agg(F.count_distinct("fold")).first()[0])
    own = labels.groupBy("Store").agg(F.count_distinct("fold").alias("folds"), F.count_distinct("segment").alias("labels")).filter(F.col("folds") == folds)
    return own.agg(F.count("*").alias("stores"), F.count_if(F.col("labels") == 1).alias("stable"), F.avg((F.col("labels") == 1).cast("int")).alias("share"))
