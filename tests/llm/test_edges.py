"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing names: every operator, one table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from storecast.llm.ctw import lm_scores
from storecast.llm.exact_dedup import exact_groups
from storecast.llm.license_scan import license_matches
from storecast.llm.line_dedup import common_lines_dropped
from storecast.llm.mixing import mixed_sample
from storecast.llm.packing import packed
from storecast.llm.queries import lengths
from storecast.llm.simhash import near_duplicates
from storecast.llm.suffix_dedup import repeats_removed
from storecast.llm.topk import top_k
from storecast.llm.toxicity import scored

CLASHES = "h chunk recipe fp root block bucket key count n of cell start end score kept keep_id group_size rank level w probability topic gone_id kept_id toxicity_of_text".split()


@pytest.fixture(scope="module")
def docs(spark):
    long = "wörd and more of it " * 15_000
    rows = [(k, t, l, s, n) for k, t, l, s, n in [(1, "a b c d", "en", "x", 7), (1, "a b c d", "en", "x", 7), (2, None, None, None, None), (None, "a b c d", "de", "y", 7), (None, None, None, None, None), (3, "", "fr", "z", 0), (4, long, "en", "x", len(long)), (5, long, "en", None, -1), (6, "\n\n \t", "xx", "x", 3), (2**62, "idiot", "en", "x", 5), (-7, "a b c d", "en", "x", 7)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES)).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 0, 1), (6, 0, 7), (9, 1, 1), (2**62, 0, 1), (2**62, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact": lambda d, _: exact_groups(d), "lines": lambda d, _: common_lines_dropped(d), "simhash": lambda d, _: near_duplicates(d), "ctw": lambda d, _: lm_scores(d), "license": lambda d, _: license_matches(d),
    "suffix": lambda d, _: repeats_removed(d), "mixing": lambda d, _: mixed_sample(d), "toxicity": lambda d, x: scored(d, x),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(docs, labels, name):
    out = OPERATORS[name](docs, labels)
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    assert len(set(out.columns)) == len(out.columns)
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_packing_has_every_row(docs):
    out = packed(lengths(docs)).toPandas()
    assert out.n_tokens.sum() == sum(len((r.text or "").split()) for r in docs.select("text").collect())
    assert packed(lengths(docs.limit(0))).count() == 0


def test_a_null_cluster_is_one_of_its_own_whatever_the_id(spark):
    rows = [(None, "a", None, 40, "x"), (None, "b", None, 40, "x"), (7, "c", None, 5, "x"), (7, "d", None, 5, "x"), (8, "e", 3, 2, "x"), (9, "f", 3, 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, cluster long, n_tokens long, shard string").withColumns({c: F.lit("clash") for c in ("piece", "bin", "start")})
    got = [(r.doc_id, r.bin) for r in packed(df, capacity=100).collect()]
    of = lambda d: [b for x, b in got if x == d]
    # All but one of the two rows of cluster 3 fit together; that one needs another bin.
    assert len(got) == 6 and len({*of(None), *of(7)}) == 1 and of(8) != of(9) and {*of(8), *of(9)} > {*of(7)}


def test_pipeline_stages_keep_the_columns(spark, docs, sf_dir):
    out = docs
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, out, sf_dir)
        assert out.columns == docs.columns
    assert pipeline.STAGES[-1][1](spark, out, sf_dir).count() >= 0
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_vectors_without_ids_take_no_part(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, None), (3, [3.0, 1.0], 2)], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in top_k(df, df, 5).collect())
    assert got == [(1, 1, 3), (3, 1, 1), (3, 2, 1)]


def test_lines_are_lost_by_row_not_by_id(spark):
    rows = [(None, "own 1\nshared\nown 2"), (None, "shared\nown 3\nown 4"), (None, "own 5"), (None, None), (7, "shared\nown 6"), (7, "own 7\nown 8\nshared"), (7, "twice"), (7, "twice"), (8, "own 9")]
    out = common_lines_dropped(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3)
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept) for r in out.collect())
    assert got == sorted([(0, 3, 1, "own 1\nown 2"), (0, 3, 1, "own 3\nown 4"), (0, 1, 0, "own 5"), (0, 1, 0, ""), (7, 2, 1, "own 6"), (7, 3, 1, "own 7\nown 8"), (7, 1, 0, "twice"), (7, 1, 0, "twice"), (8, 1, 0, "own 9")])
    many = spark.createDataFrame([(None, f"common\nown {k}") for k in range(10)], "doc_id long, text string")
    assert sorted(r.kept for r in common_lines_dropped(many).collect()) == [f"own {k}" for k in range(10)]
