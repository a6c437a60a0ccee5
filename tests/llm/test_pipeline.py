"""The pipeline's stages against brute force, each on what the one before kept."""

import re

from test_dedup import plain_components, plain_fingerprint

import corpus_pipeline as p
from storecast.llm.toxicity import scored


def test_stages_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stages = dict(p.STAGES)
    all_ids = {r.doc_id for r in docs.collect()}

    clean = stages["toxicity"](spark, docs, d).cache()
    assert clean.columns == columns
    rejected = {r.doc_id for r in scored(docs, spark.read.parquet(f"{d}/labels.parquet")).filter("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == all_ids - rejected and rejected

    single = stages["exact dedup"](spark, clean, d).cache()
    first = {}
    for r in sorted(clean.collect()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in single.collect()} == set(first.values()) and single.columns == columns

    unlike = stages["near dedup"](spark, single, d).cache()
    rows = sorted(single.collect())
    label = plain_components([plain_fingerprint(r.text) for r in rows])
    assert {r.doc_id for r in unlike.collect()} == {rows[k].doc_id for k in set(label)} and unlike.columns == columns

    drawn = stages["mixing"](spark, unlike, d).cache()
    assert drawn.columns == columns and 0 < drawn.count() < unlike.count()
    packed = stages["packing"](spark, drawn, d).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in drawn.collect()}
    assert (packed.groupby("bin").n_tokens.sum() <= 2048).all()


def test_run_is_the_stages_in_order(spark, sf_dir):
    assert [k for k, _ in p.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    assert p.run(spark, sf_dir).count() > 0


def test_run_leaves_the_last_stages_tables_alone(spark, sf_dir, monkeypatch):
    from storecast.sources import tables

    monkeypatch.setattr(tables, "_kept", {})
    out = p.run(spark, sf_dir)
    left = sorted(path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in tables._kept)
    assert left == ["lengths", "mixing"] and out.count() > 0
