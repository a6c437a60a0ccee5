"""Exact nearest vectors by vector-approximation files.

Vectors stand in blocks. A block has, for every component, a grid of 256
cells over the block's own range, and each vector's cells as bytes. A scan of
the cells gives bounds of every score; per query, the largest of the tasks'
kth lower bounds rules out every row whose upper bound is less, in a second
scan. Exact vectors are rows of their own, read for what is left only, in the
order of the bounds: first each query's 2k best bounds, whose kth exact score
is the new floor, then those others whose bound reaches it, after which the
kth result is certain. Queries go in blocks against all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written

SCALE, BLOCK, QUERY_BLOCK = 1024, 2048, 256
#: Query blocks whose best bounds a task holds before it gives them out.
HELD = 512


def scaled(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and floor(1024 x) of the vectors that are not null and hold finite numbers only."""
    column = batch.column(1)
    by_size: dict[int, list[int]] = {}
    lengths = column.value_lengths().to_pylist()
    for row, (n, doc) in enumerate(zip(lengths, batch.column(0).to_pylist(), strict=True)):
        if n and doc is not None:
            by_size.setdefault(n, []).append(row)
    out = {}
    for n, rows in by_size.items():
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        x = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).reshape(-1, n))
        fine = np.isfinite(x).all(axis=1)  # a null is NaN here
        if fine.any():
            out[n] = (batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)[fine], x[fine])
    return out


def _needed(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows, equal vectors together, that can be among the k best of any query.

    Of equal vectors those are the rows of the k + 1 smallest distinct ids, one
    of which may be the query's own; of equal vectors under one id k rows do.
    """
    order = np.lexsort((ids, np.unique(x, axis=0, return_inverse=True)[1].ravel()))
    ids, x = ids[order], x[order]
    place = np.arange(len(x))
    new_vector = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
    new_id = new_vector | np.concatenate([[True], ids[1:] != ids[:-1]])
    first = lambda new: np.maximum.accumulate(np.where(new, place, 0))
    seen = np.cumsum(new_id)
    keep = (seen - seen[first(new_vector)] <= k) & (place - first(new_id) < k)
    return ids[keep], x[keep]


def _blocks(k: int):
    """Batches of (id, vector) to blocks with their cells and their exact vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, found in scaled(batch).items():
                ids, x = _needed(*found, k)
                for i in range(0, len(x), BLOCK):
                    part = x[i : i + BLOCK]
                    low = part.min(axis=0)
                    step = np.maximum(part.max(axis=0) - low, 1e-9) / 255
                    cells = np.minimum((part - low) / step, 255).astype(np.uint8)
                    yield pa.RecordBatch.from_pylist(
                        [{"dims": n, "ids": ids[i : i + BLOCK].tobytes(), "cells": cells.tobytes(), "low": low.tobytes(), "step": step.tobytes(), "exact": [v.tobytes() for v in part]}],
                        pa.schema([("dims", pa.int32()), *((c, pa.binary()) for c in ("ids", "cells", "low", "step")), ("exact", pa.list_(pa.binary()))]),
                    )

    return run


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, (ids, x) in scaled(batch).items():
            for i in range(0, len(x), QUERY_BLOCK):
                yield pa.RecordBatch.from_pylist([{"q_dims": n, "q_ids": ids[i : i + QUERY_BLOCK].tobytes(), "q_exact": x[i : i + QUERY_BLOCK].tobytes()}], pa.schema([("q_dims", pa.int32()), ("q_ids", pa.binary()), ("q_exact", pa.binary())]))


def _floats(row: dict, name: str, n: int) -> np.ndarray:
    return np.frombuffer(row[name], np.float64).reshape(-1, n)


def _scores_between(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a block, and the queries' lower and upper bounds on its rows; -inf for a query's own row."""
    n = row["dims"]
    ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
    cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, n).astype(np.float64)
    low, step, q = _floats(row, "low", n)[0], _floats(row, "step", n)[0], _floats(row, "q_exact", n)
    middle = (q * step) @ cells.T + (q @ (low + step / 2))[:, None]
    error = (np.abs(q) @ (step / 2))[:, None]
    error = error * (1 + 1e-6) + 1e-9 * np.abs(middle)
    lower, upper = middle - error, middle + error
    own = q_ids[:, None] == ids[None, :]
    lower[own] = upper[own] = -np.inf
    return ids, q_ids, lower, upper


def _floors(k: int):
    """Blocks and query blocks to each query's kth largest lower bound over rows of the task: one number a query and HELD query blocks."""

    def given(best: dict) -> Iterator[pa.RecordBatch]:
        for q_block, (q_ids, lower) in best.items():
            least = lower.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q_ids), q_block, np.int64)), pa.array(np.arange(len(q_ids), dtype=np.int32)), pa.array(least)], ["asked", "q_slot", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                _, q_ids, lower, _ = _scores_between(row)
                known = best.get(row["q_block"], (q_ids, np.full((len(q_ids), k), -np.inf)))[1]
                both = np.concatenate([known, lower], axis=1)
                best[row["q_block"]] = q_ids, np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                if len(best) > HELD:
                    yield from given(best)
                    best = {}
        yield from given(best)

    return run


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block and a query block with its floors to the rows whose upper bound reaches the query's floor."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, q_ids, _, upper = _scores_between(row)
            least = np.full(len(q_ids), -np.inf)
            for x in row["floors"]:
                least[x["q_slot"]] = x["least"]
            a, b = np.nonzero((upper >= least[:, None]) & (q_ids[:, None] != ids[None, :]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), row["block"], np.int64)), pa.array(b.astype(np.int32)), pa.array(q_ids[a]), pa.array(ids[b]), pa.array(upper[a, b])], ["block", "slot", "query_id", "vec_id", "upper"]
            )


@F.arrow_udf(T.BinaryType())
def packed(vector: pa.Array) -> pa.Array:
    """Vectors as the bytes of their components' floor(1024 x), in doubles."""
    return pa.array([np.floor(SCALE * x.values.cast(pa.float64()).to_numpy(zero_copy_only=False)).tobytes() for x in vector], pa.binary())


@F.arrow_udf(T.LongType())
def exact_scores(vector: pa.Array, query: pa.Array) -> pa.Array:
    """Inner products of whole numbers, in whole numbers where doubles do not hold them."""
    out = []
    for v, q in zip(vector, query, strict=True):
        x, y = np.frombuffer(v.as_buffer(), np.float64), np.frombuffer(q.as_buffer(), np.float64)
        small = np.abs(x).max() * np.abs(y).max() * len(x) < 2**53
        out.append(int(x @ y) if small else sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))
    return pa.array(out, pa.int64())


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score of the k rows of ``vectors`` with the largest inner product.

    Components are floor(1024 x). Ties go to the smaller id. A query's own id is
    no candidate. Vectors that are null or empty, or hold a null or a non-finite
    number, and rows without an id take no part; vectors compare with those of
    their own length. Rows that repeat an id are candidates each; queries that
    repeat one count once, with the least of their vectors that take part. A
    score beyond a long fails the task. Columns other than the two named, whatever
    their names, are not read. No rows left on either side: an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * SCALE < float("inf")))
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).filter(fine & (F.size("v") > 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = written(rows.mapInArrow(_blocks(k), "dims int, ids binary, cells binary, low binary, step binary, exact array<binary>").withColumn("block", F.monotonically_increasing_id()), "cells")
    q_blocks = written(asked.mapInArrow(_query_blocks, "q_dims int, q_ids binary, q_exact binary").withColumn("q_block", F.monotonically_increasing_id()), "query-blocks")
    # A query block goes once to each group of blocks, and the groups are many: a join on the group's number, not of rows with rows.
    # The planner sees the size of files, in which whole numbers take little room, and not that rows are repeated: it would
    # send such tables whole by way of the driver. So joins with vectors are merges, each side dealt by its key.
    groups = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.drop("exact").withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))

    def pairs(asked_blocks: DataFrame) -> DataFrame:
        sent = asked_blocks.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return dealt.join(sent.hint("merge"), (F.col("group") == F.col("to")) & (F.col("dims") == F.col("q_dims"))).drop("group", "to", "q_dims")

    # First the floors, a number per query and task; then, from a second scan of the cells, the rows that reach them.
    # The floors go to the query blocks before these are sent again, so that no pair of blocks is moved.
    floors = pairs(q_blocks).mapInArrow(_floors(k), "asked long, q_slot int, least double").groupBy("asked", "q_slot").agg(F.max("least").alias("least"))
    floors = floors.groupBy("asked").agg(F.collect_list(F.struct("q_slot", "least")).alias("floors"))
    reached = written(q_blocks.join(floors.hint("merge"), F.col("q_block") == F.col("asked")).drop("asked"), "floors")
    left = pairs(reached).mapInArrow(_reaching, "block long, slot int, query_id long, vec_id long, upper double")
    by_bound = W.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id", "block", "slot")
    left = written(left.withColumn("turn", F.row_number().over(by_bound)), "left")
    # Exact vectors go to the rows that are left by block and slot, and queries by their ids.
    vector = blocks.select(F.col("block").alias("of"), F.posexplode("exact").alias("at", "vector"))
    query = asked.select(F.col("vec_id").alias("asked_id"), packed("v").alias("query"))

    def scored(part: DataFrame) -> DataFrame:
        both = part.join(vector.hint("merge"), (F.col("block") == F.col("of")) & (F.col("slot") == F.col("at"))).join(query.hint("merge"), F.col("query_id") == F.col("asked_id"))
        return both.select("query_id", "vec_id", "block", "slot", exact_scores("vector", "query").alias("score"))

    first = written(scored(left.filter(F.col("turn") <= 2 * k)), "first")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "block", "slot")
    kth = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("of_query"), F.col("score").alias("floor"))
    rest = left.filter(F.col("turn") > 2 * k).join(kth.hint("merge"), F.col("query_id") == F.col("of_query"), "left").filter("floor is null or upper >= floor").select("block", "slot", "query_id", "vec_id", "upper", "turn")
    scores = first.unionByName(scored(rest))
    return scores.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
