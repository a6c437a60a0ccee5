"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Tokens are summed by cell, a combination of source, language and topic. The
cells' token weights are raked until their sums meet the target share of every
source, language and topic, under the bound that no cell gives more tokens
than it holds; a cell's weight over its tokens is the probability with which
its documents are drawn. The expected tokens are the wanted share of all, and
their shares by level the targets. Where a level holds too little for its
target it is taken whole, and the others of its dimension fill the gap.

Built-in functions only. Documents are shuffled as (id, cell, count); a cell
that holds a third of them is summed before the shuffle. Raking works on cells
alone: one partition while they are few, as many as Spark deals otherwise.
Only the levels of one dimension are ranked in one task, a row each.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import dropped, written

WORDS = r"[^\x20\x09-\x0D]+"
DIMS = ("source", "lang", "topic")
#: The targets of the query: a power of a level's tokens (0: equal shares, 1: as they are), or shares by level.
TARGETS: Mapping[str, float | Mapping[str, float]] = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.5}
ITERATIONS, EVERY, SHARE, SEED = 16, 4, 0.5, 17
FEW_CELLS = 20_000


def uniform(id_col: str | Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def level_sizes(cells: DataFrame, targets: Mapping) -> DataFrame:
    """dim, level, size (tokens) and share (wanted, not yet summing to one) of every level of every dimension; a level without tokens gets none."""
    each = F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("level")) for d in targets)))
    levels = cells.select("n", each).groupBy("dim", "level").agg(F.sum("n").cast("double").alias("size"))
    share = F.lit(0.0)
    for dim, want in targets.items():
        if isinstance(want, Mapping):
            given = F.create_map(*[F.lit(x) for kv in want.items() for x in (kv[0], float(kv[1]))]) if want else F.create_map()
            own = F.coalesce(F.element_at(given, F.col("level")), F.lit(0.0))
        else:
            own = F.pow("size", F.lit(float(want)))
        share = F.when(F.col("dim") == dim, own).otherwise(share)
    return levels.withColumn("share", F.when(F.col("size") > 0, share).otherwise(0.0))


def reachable(levels: DataFrame, wanted: float) -> DataFrame:
    """(dim, level, t): the levels' target shares of ``wanted`` tokens.

    A level that holds fewer tokens than its share asks for is taken whole, and
    the other levels of its dimension fill what it lacks in the proportion of
    their shares.
    """
    w = W.partitionBy("dim").orderBy(F.desc(F.col("share") / F.col("size")), "level")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    scale = (F.lit(wanted) - before) / F.sum("share").over(w.rowsBetween(0, W.unboundedFollowing))
    steps = levels.filter("share > 0").select("dim", "size", "share", F.row_number().over(w).alias("place"), scale.alias("scale"))
    found = {r.dim: r.scale for r in steps.filter(F.col("scale") * F.col("share") <= F.col("size") * (1 + 1e-12)).groupBy("dim").agg(F.min_by("scale", "place").alias("scale")).collect()}  # a row a dimension
    by = F.lit(None).cast("double")
    for dim, scale in found.items():
        by = F.when(F.col("dim") == dim, F.lit(float(scale))).otherwise(by)
    return levels.select("dim", "level", F.when(F.col("share") > 0, F.least("size", by * F.col("share")) / F.lit(wanted)).otherwise(0.0).alias("t"))


def with_targets(cells: DataFrame, targets: Mapping, share: float | None = None) -> tuple[DataFrame, float, float]:
    """The cells with the target share of each of their levels as t_<dim>, the tokens wanted, and all tokens.

    With ``share``, that part of all tokens, or fewer where the levels with a
    target hold fewer; targets are then what can be reached. Without it the
    shares only sum to one.
    """
    levels = written(level_sizes(cells, targets), "levels")
    sums = {r.dim: r for r in levels.groupBy("dim").agg(F.sum("size").alias("n"), F.sum(F.when(F.col("share") > 0, F.col("size"))).alias("size"), F.sum(F.when(F.col("share") > 0, F.col("share"))).alias("share")).collect()}  # a row a dimension
    n = max((float(r.n or 0) for r in sums.values()), default=0.0)
    wanted = min([n if share is None else share * n, *(float(sums[d].size or 0) if d in sums else 0.0 for d in targets)])
    if share is None or not wanted:
        every = F.lit(1.0)
        for dim, r in sums.items():
            every = F.when(F.col("dim") == dim, F.lit(float(r.share or 1.0))).otherwise(every)
        goals = levels.select("dim", "level", (F.col("share") / every).alias("t"))
    else:
        goals = reachable(levels, wanted)
    for dim in targets:
        cells = cells.join(goals.filter(F.col("dim") == dim).select("level", F.col("t").alias(f"t_{dim}")), F.col(dim) == F.col("level")).drop("level")
    return cells, wanted, n


def raked(cells: DataFrame, targets: Mapping = TARGETS, iterations: int = ITERATIONS, share: float | None = None) -> DataFrame:
    """The cells with their share of the weight, w: sums by level meet the targets as far as the cells allow.

    With ``share``, w are shares of so many of all tokens, and no cell's w is
    above cap, all of its tokens: a cell there is held while the others of its
    level are scaled up.
    """
    stored = written(cells, "cell-tokens")
    cells, wanted, n = with_targets(stored, targets, share)
    n = n or 1.0
    cap = F.lit(float("inf")) if share is None or not wanted else F.col("n") / F.lit(wanted)
    cells = written(cells.withColumns({"cap": cap, "w": F.col("n") / F.lit(n)}), "cells")
    dropped(stored)
    few = cells.count() <= FEW_CELLS
    for first in range(0, iterations, EVERY):
        # Some rounds in one statement: it is analysed once.
        rounds = "{cells}"
        for _ in range(first, min(first + EVERY, iterations)):
            for dim in targets:
                rounds = _fitted(dim, rounds, cells.columns)
        after = written(cells.sparkSession.sql(f"SELECT * FROM {rounds}", cells=cells.coalesce(1) if few else cells), "raked")
        dropped(cells)
        cells = after
    return cells


def _fitted(dim: str, rows: str, columns: list[str]) -> str:
    """SQL: the rows with w scaled so that the levels of one dimension meet their targets; cells at their cap are held."""
    at_cap = "w >= cap * (1 - 1e-9D)"
    sums = f"sum(w) OVER p AS total, sum(CASE WHEN {at_cap} THEN w ELSE 0D END) OVER p AS held, sum(CASE WHEN {at_cap} THEN 0D ELSE w END) OVER p AS free"
    up = f"CASE WHEN {at_cap} OR free <= 0 THEN w ELSE least(cap, w * (`t_{dim}` - held) / free) END"
    own = ", ".join(f"`{c}`" for c in columns if c != "w")
    return f"(SELECT {own}, CASE WHEN total <= 0 THEN 0D WHEN total >= `t_{dim}` THEN w * `t_{dim}` / total ELSE {up} END AS w FROM (SELECT *, {sums} FROM {rows} WINDOW p AS (PARTITION BY `{dim}`)))"


def achieved(cells: DataFrame, targets: Mapping = TARGETS) -> DataFrame:
    """What raked cells reach: dim, level, target (what can be reached), share, and whether it is within a hundredth of the target."""
    parts = [cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("level")).agg(F.max(f"t_{d}").alias("target"), F.sum("w").alias("share")) for d in targets]
    return reduce(DataFrame.unionByName, parts).withColumn("met", F.abs(F.col("share") - F.col("target")) <= 0.01 * F.col("target"))


def probabilities(cells: DataFrame) -> DataFrame:
    """Raked cells with the probability of their documents, w / cap."""
    return cells.withColumn("probability", F.when(F.col("n") > 0, F.round(F.least(F.lit(1.0), F.col("w") / F.col("cap")), 6)).otherwise(0.0))


def mixed_sample(docs: DataFrame, topics: DataFrame | None = None, *, targets: Mapping = TARGETS, share: float = SHARE, iterations: int = ITERATIONS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, topic, n_tokens, probability, kept.

    ``topics`` (doc_id, topic) may lack documents; these, and null sources and
    languages, are the level ''. Tokens are words between whitespace. A level
    that the targets leave out, and an empty document's cell if it holds no
    token at all, has probability zero. Rows that repeat an id are drawn
    together; a null id is drawn like any other. Texts of any length are
    counted whole. Empty table: empty result. :func:`achieved` says how near
    raked cells come to the targets. Other columns, whatever their names, are not
    read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long").alias("n_tokens")
    )
    if topics is None:
        rows = rows.withColumn("topic", F.lit(""))
    else:
        one = topics.select(F.col(topics.columns[0]).alias("of"), F.col(topics.columns[1]).cast("string").alias("topic")).groupBy("of").agg(F.min("topic").alias("topic"))
        rows = rows.join(one, F.col("doc_id") == F.col("of"), "left").drop("of").withColumn("topic", F.coalesce("topic", F.lit("")))
    rows = written(rows, "counted")
    cells = rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("n"))
    named = written(probabilities(raked(cells, targets, iterations, share)).select(*(F.col(c).alias(f"c_{c}") for c in DIMS), "probability"), "probabilities")
    same = [F.col(c) == F.col(f"c_{c}") for c in DIMS]
    return rows.join(named, same).select("doc_id", *DIMS, "n_tokens", "probability", (uniform("doc_id", seed) < F.col("probability")).alias("kept"))
