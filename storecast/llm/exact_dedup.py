"""Exact duplicates by recipes of content-defined chunks.

Each text is normalised and cut into chunks at places that its own content
sets. Distinct chunks get verified identifiers: a chunk's 64-bit hash, after
the distinct chunk texts of every hash were compared as strings; where two
texts share a hash, their rank tells them apart. Two documents are equal when
their ordered lists of identifiers are. So a long document is moved at most
once, as its chunks, and a chunk that many documents hold once per task; what
is grouped and joined afterwards is lists of numbers.

Built-in functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

MIN_CHARS, MAX_CHARS = 1024, 8192
# A cut falls behind a space between these characters, about one space in forty of prose.
CUT = r"(?<=[dnsre,.] )(?=[b-dmop])"
WHITESPACE = r"[\x20\x09-\x0D]+"


def normalised(text):
    """Runs of whitespace as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def chunks_of(norm, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS):
    """The text cut at the first CUT at least ``min_chars`` on, or after ``max_chars``; the pieces joined are the text."""
    pattern = rf"(?s).{{{min_chars},{max_chars}}}?(?:{CUT}|\z)|.{{1,{max_chars}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def hashed(chunk, bits: int = 64):
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, hash_bits: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest id of the rows whose normalised texts are equal.
    A null text is empty; an empty table gives an empty result. A null id
    counts as larger than any other; a group of nulls only keeps null. Of
    several rows with the smallest id, each is marked as kept: they are one
    document. Texts of any length are read whole. Other columns, whatever
    their names, are not read.
    ``hash_bits`` is for tests, which shorten the hash to make chunks collide.
    """
    norm = normalised(F.col("text"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = texts.select("doc_id", norm.alias("norm")).select("doc_id", "norm", chunks_of(F.col("norm"), min_chars, max_chars).alias("chunks"))
    lists = cut.select("doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), F.transform("chunks", lambda c: hashed(c, hash_bits)).alias("recipe"))

    chunk = cut.select(F.explode("chunks").alias("chunk")).select(hashed(F.col("chunk"), hash_bits).alias("h"), "chunk")
    shared = written(chunk.groupBy("h", "chunk").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared-hashes")
    if shared.isEmpty():
        lists = lists.withColumn("ranks", F.lit(None).cast("array<struct<pos:int,rank:int>>"))
    else:
        from pyspark.sql import Window as W

        several = chunk.join(shared, "h", "left_semi").distinct()
        ranks = written(several.select("h", "chunk", F.row_number().over(W.partitionBy("h").orderBy("chunk")).alias("rank")), "chunk-ranks")
        # A row number of the text, not the id, ties a row's ranks together: ids may repeat.
        row = F.sha2(F.col("norm"), 256)
        spots = cut.select(row.alias("text_sha256"), F.col("chunks"), F.transform("chunks", lambda c: hashed(c, hash_bits)).alias("recipe")).dropDuplicates(["text_sha256"])
        spots = spots.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk")).select("text_sha256", "pos", "chunk", hashed(F.col("chunk"), hash_bits).alias("h"))
        told = spots.join(ranks, ["h", "chunk"]).groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
        lists = lists.join(told, "text_sha256", "left")

    lists = written(lists, "recipes")
    key = ["recipe", "ranks"]
    groups = written(lists.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "equal-groups")
    same = (lists["recipe"] == groups["recipe"]) & lists["ranks"].eqNullSafe(groups["ranks"])
    out = lists.join(groups, same, "left")
    return out.select(
        lists["doc_id"],
        F.when(groups["group_size"].isNull(), lists["doc_id"]).otherwise(groups["keep_id"]).alias("keep_id"),
        F.coalesce(groups["group_size"], F.lit(1)).cast("long").alias("group_size"),
        F.when(groups["group_size"].isNull(), F.lit(True)).otherwise(lists["doc_id"].eqNullSafe(groups["keep_id"])).alias("kept"),
        lists["text_sha256"],
    )
