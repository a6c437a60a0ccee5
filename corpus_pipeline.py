"""From raw documents to packed training sequences: five stages, each a DataFrame of documents to the next.

Ids are expected to be distinct: rows that share one stay or go together.
A row without an id is never dropped as a copy of another.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from storecast.llm.exact_dedup import exact_groups
from storecast.llm.mixing import mixed_sample
from storecast.llm.packing import packed
from storecast.llm.queries import lengths, table, topics_of
from storecast.llm.simhash import near_duplicates
from storecast.llm.store import dropped, written
from storecast.llm.toxicity import fit, scores
from storecast.sources.tables import settled


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents but those with the given ids, which are few: the planner sends them to all tasks only if the table is small."""
    gone = written(ids.select("doc_id").filter("doc_id is not null").distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go."""
    score = scores(fit(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score("text").getField("score") < 0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return without(docs, exact_groups(docs).filter("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the one with the smallest id stays."""
    return without(docs, near_duplicates(docs).filter("doc_id <> component_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics."""
    kept = written(mixed_sample(docs, topics_of(spark, sf_dir)).filter("kept").select("doc_id").distinct(), "drawn")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every document."""
    return packed(lengths(docs))


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: SQL has no SimHash, so the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(spark, partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
