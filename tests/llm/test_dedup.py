"""Exact, line and SimHash duplicates against brute force, on texts with nulls, ties and odd spaces."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from storecast.llm.exact_dedup import exact_groups
from storecast.llm.graph import components
from storecast.llm.line_dedup import common_lines_dropped
from storecast.llm.simhash import FLIPS, fingerprint, near_duplicates

SCHEMA = "doc_id long, text string, keep_id string, h long, norm string"
LONG = " ".join(f"word{k % 97} or, a" for k in range(3000))
TEXTS = [None, "", " ", "a  b", "a\tb", "a b ", "É x", "é x", LONG, LONG.replace(" ", "\n"), LONG + " end", "x" * 20000, "x" * 20000, "x" * 20001, "a b"]


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "k", 1, "n") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups_equal_brute_force_also_when_hashes_collide(spark, bits):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    got = {r.doc_id: r for r in exact_groups(table(spark, TEXTS), hash_bits=bits).collect()}
    for k, t in enumerate(norm):
        same = [i for i, u in enumerate(norm) if u == t]
        assert (got[k].keep_id, got[k].group_size, got[k].kept, got[k].text_sha256) == (min(same), len(same), k == min(same), sha(t))


def test_exact_groups_of_nothing_and_of_null_or_repeated_ids(spark):
    assert exact_groups(table(spark, [])).count() == 0
    got = exact_groups(table(spark, ["a", "a", "a", "b"], [None, 5, 5, None])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 1, True), (-1, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)]


def test_lines_equal_brute_force(spark):
    docs = [f"{'Common  ' if k % 2 else ' common'}\nown {k}\n\n{'near' if k < 9 else 'far'}" for k in range(12)] + [None, "", "\n"]
    keys = [[x.strip(" \t\n\x0b\x0c\r").lower() for x in (d or "").split("\n")] for d in docs]
    n = {k: sum(k in x for x in keys) for x in keys for k in x}
    got = {r.doc_id: r for r in common_lines_dropped(table(spark, docs)).collect()}
    for i, d in enumerate(docs):
        kept = [x for x, k in zip((d or "").split("\n"), keys[i], strict=True) if not k or n[k] < 10]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (len(keys[i]), len(keys[i]) - len(kept), "\n".join(kept))


def test_lines_count_documents_not_rows(spark):
    got = common_lines_dropped(table(spark, ["same"] * 12, [1] * 6 + [2] * 6)).collect()
    assert len(got) == 12 and all(r.n_dropped == 0 for r in got)
    assert common_lines_dropped(table(spark, [])).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    label = list(range(len(fps)))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(label[i], label[j])
            if (label[i], label[j]) != (m, m):
                label[i] = label[j] = m
                changed = True
    return label


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()] + [*TEXTS, LONG[:-4], LONG + " b c d"]
    texts += [f"{t} and {k} more" for k in range(2) for t in sorted((t for t in texts if t), key=len)[-30:]]
    fps = [plain_fingerprint(t) for t in texts]
    assert fps == [fingerprint(t and t.encode()) for t in texts]
    want = plain_components(fps)
    got = {r.doc_id: r for r in near_duplicates(table(spark, texts)).collect()}
    assert [(got[k].fingerprint, got[k].component_id) for k in range(len(texts))] == [(f"{fps[k]:016x}", want[k]) for k in range(len(texts))]
    assert len(set(want)) < len(set(fps))
    assert near_duplicates(table(spark, [])).count() == 0


def test_variants_meet_exactly_within_three_bits():
    rng = np.random.default_rng(5)
    for bits in range(1, 7):
        for _ in range(60):
            x = int(rng.integers(0, 2**63))
            y = x
            for b in rng.choice(64, bits, replace=False):
                y ^= 1 << int(b)
            near = {(x ^ int(f), k < 65) for k, f in enumerate(FLIPS[: 65 if bin(x).count("1") % 2 == 0 else None])}
            far = {(y ^ int(f), k < 65) for k, f in enumerate(FLIPS[: 65 if bin(y).count("1") % 2 == 0 else None])}
            met = {(v, a or b) for v, a in near for w, b in far if v == w}
            assert any(ok for _, ok in met) == (bits <= 3)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 301)}, 901: 900}
