"""Context-tree weighting against its definition, and base scores against counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from storecast.llm.ctw import lgamma, lm_scores, plain_log_probabilities

TEXTS = ["the cat sat", "The  CAT\nsat", None, "", "é è ê", "a" * 300, "abcabcabc " * 5, "the cat ate", "x", "\t \n"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 2, 10, 1000.5])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], atol=1e-10)


@pytest.mark.parametrize("block_bytes", [1 << 23, 64])
def test_scores_equal_the_definition(spark, block_bytes):
    rows = list(enumerate(TEXTS * 2))
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, train string, block long, bucket long")
    got = {r.doc_id: r for r in lm_scores(docs, block_bytes=block_bytes).collect()}
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    assert 0 < len(out) < len(rows)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for i, t in rows}
    counts = Counter(w for i, _ in rows if i not in out for w in words[i])
    total, distinct = sum(counts.values()), len(counts)
    plain = plain_log_probabilities([lower(t).encode() for i, t in rows if i not in out], [lower(t).encode() for _, t in rows])
    for (i, _), score in zip(rows, plain, strict=True):
        r = got[i]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, len(words[i]), sum(counts[w] > 0 for w in words[i]), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6)
        n_bytes = len((TEXTS[i % len(TEXTS)] or "").encode())
        assert r.n_bytes == n_bytes and math.isclose(r.bits_per_byte, -score * math.log2(10) / (n_bytes + 1), rel_tol=1e-6)


def test_scores_are_probabilities_of_whole_texts():
    seen = [b"ab", b"ba", b"ab"]
    ten = plain_log_probabilities(seen, [bytes(x) for n in range(2) for x in ([()] if n == 0 else [(c,) for c in range(255)])])
    assert sum(10**x for x in ten) < 1


def test_nothing_in_nothing_out(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_rows_beat_the_words_alone(spark):
    out = lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum()
