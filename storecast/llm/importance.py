"""Importance resampling: documents drawn by how much their words are those of a target.

A document's words become an array of buckets by higher-order functions. What
is counted is one number a bucket, so only these totals are shuffled; the
buckets' gains are one literal array, and a document's weight is the sum of
its own entries of it. Texts are read once: the bucket arrays are stored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from .store import written

BUCKETS, NGRAMS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: A-Z, a-z, 0-9 and all that is not ASCII stand in words, once A-Z is in lower case.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def runs(words: Column, most: int) -> Column:
    """All runs of 1 to ``most`` consecutive words, joined by one space."""

    def of(size: int) -> Column:
        each = F.transform(words, lambda _, i: F.when(i + size <= F.size(words), F.array_join(F.slice(words, i + 1, size), " ")))
        return F.filter(each, lambda x: x.isNotNull())

    return F.concat(words, *(of(k) for k in range(2, most + 1))) if most > 1 else words


def bucketed(docs: DataFrame, id_col: str, text_col: str, buckets: int, ngrams: int) -> DataFrame:
    """doc_id, n_words and the bucket of every feature."""
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    of = F.transform(runs(F.col("words"), ngrams), lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), of.alias("buckets"))


def totals(rows: DataFrame, buckets: int) -> list[int]:
    """How many features of all rows fall in each bucket: what the driver gets is one number a bucket at most."""
    counts = rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    out = [0] * buckets
    for r in counts:
        out[r.bucket] = r.n
    return out


def gains(own: list[int], target: list[int]) -> list[int]:
    """Per bucket the floor of 1000 times the log of how much more of the target than of the documents falls there, each count plus one."""
    n, every, wanted = len(own), float(sum(own)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (every + n) / ((s + 1.0) * (wanted + n)))) for s, t in zip(own, target, strict=True)]


def weight(buckets: Column, table: list[int]) -> Column:
    """The sum of the features' gains. The table is one constant of the plan."""
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))


def gumbel(doc_id: Column, seed: int) -> Column:
    """The floor of 1000 times a draw from the Gumbel distribution that depends on the id and the seed alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


def importance_sample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    buckets: int = BUCKETS, ngrams: int = NGRAMS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    ``target`` has a text column of the same name. Of the rows with at least
    ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn:
    those with the largest weight plus Gumbel noise, which is a sample without
    replacement in proportion to exp(weight / 1000). Ties go to the smaller id,
    then to fewer features; rows alike in all of these take any order.

    A null or empty text has no features and weight 0. A null id draws its
    noise as an empty id does and stands last among ties; rows that repeat an
    id have the same noise and each its own weight. Texts of any length are
    taken whole. Without documents the result is empty; without a target all
    its counts are zero. Other columns, whatever their names, are not read.
    """
    rows = written(bucketed(docs, id_col, text_col, buckets, ngrams), "buckets")
    wanted = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", buckets, ngrams)
    table = gains(totals(rows, buckets), totals(wanted, buckets))
    own = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(F.col("buckets"), table).alias("weight"), (F.col("n_words") >= least_words).alias("eligible"))
    scores = written(own.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    drawn = scores.filter("eligible").count() * percent // 100
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    placed = running(scores, order, {}, place="place")
    rank = F.when(F.col("eligible") & (F.col("place") <= drawn), F.col("place")).cast("long")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
