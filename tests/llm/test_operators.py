"""Mixing, packing, toxicity and top-k against brute force or held-out rows."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from storecast.llm.mixing import DIMS, SHARE, achieved, mixed_sample, probabilities, raked
from storecast.llm.packing import best_fit, packed
from storecast.llm.topk import top_k
from storecast.llm.queries import table, topics_of
from storecast.llm.toxicity import BlockMaxIndex, fit, isotonic, scored


def test_raking_meets_the_targets(spark):
    rows = [(s, l, t, 10 + 7 * i + 3 * j + k * k) for i, s in enumerate("abc") for j, l in enumerate(("en", "de")) for k, t in enumerate("xyz")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n long")
    targets = {"source": 0.5, "lang": {"en": 0.7, "de": 0.3}, "topic": 0.0}
    out = raked(cells, targets, 30).toPandas()
    assert math.isclose(out.w.sum(), 1, rel_tol=1e-9)
    assert np.allclose(out.groupby("lang").w.sum()[["en", "de"]], [0.7, 0.3], atol=1e-9)
    assert np.allclose(out.groupby("topic").w.sum(), 1 / 3, atol=1e-9)
    root = np.sqrt(out.groupby("source").n.sum())
    assert np.allclose(out.groupby("source").w.sum(), root / root.sum(), atol=1e-9)


def test_expected_shares_meet_the_targets_or_say_so(spark):
    d = "/root/testdata/sf0.1"
    docs = mixed_sample(table(spark, d, "documents"), topics_of(spark, d)).persist()
    cells = docs.groupBy(*DIMS).agg(F.sum("n_tokens").alias("n"))
    own = raked(cells, share=SHARE).persist()
    # What the documents' probabilities amount to.
    p = probabilities(own).select(*DIMS, "n", "probability").toPandas()
    assert p.probability.between(0, 1).all()
    expected = p.n * p.probability
    assert abs(expected.sum() / p.n.sum() / SHARE - 1) < 0.01
    report = achieved(own).toPandas()
    for dim in DIMS:
        part = report[report.dim == dim].set_index("level")
        got = (expected / expected.sum()).groupby(p[dim]).sum()
        assert np.allclose(got[part.index], part.share, atol=2e-3)
        assert (np.abs(part.share - part.target) <= 0.01 * part.target + 1e-12).eq(part.met).all() and part.met.all()
    lang = report[report.dim == "lang"].set_index("level").target
    assert np.allclose(lang[["en", "de", "fr", "es"]], [0.5, 0.2, 0.2, 0.1])
    kept = docs.filter("kept").groupBy("lang").agg(F.sum("n_tokens").alias("n")).toPandas().set_index("lang").n
    assert np.allclose((kept / kept.sum())[["en", "de", "fr", "es"]], [0.5, 0.2, 0.2, 0.1], atol=0.03)


def test_a_level_too_small_for_its_target_is_taken_whole(spark):
    rows = [(s, "en", t, n) for s, n in (("big", 900), ("mid", 300), ("tiny", 4)) for t in "xy"]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n long")
    own = raked(cells, {"source": 0.0, "lang": 1.0, "topic": 0.0}, share=0.5)
    p = {(r.source, r.topic): r.probability for r in probabilities(own).collect()}
    assert p["tiny", "x"] == p["tiny", "y"] == 1
    # 1204 of 2408 are wanted: 8 from tiny, and 598 each from the others.
    assert math.isclose(p["big", "x"], 598 / 1800, abs_tol=1e-6) and math.isclose(p["mid", "y"], 598 / 600, abs_tol=1e-6)
    assert achieved(own, {"source": 0.0}).filter("not met").count() == 0


def test_sample_takes_nulls_and_holds_the_share(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 7), None if k % 5 == 0 else "s" + str(k % 3), "en" if k % 2 else None) for k in range(2000)], "doc_id long, text string, source string, lang string")
    out = mixed_sample(docs, targets={"source": 0.5, "lang": 0.5, "topic": 1.0}).toPandas()
    assert len(out) == 2000 and abs(out.n_tokens[out.kept].sum() / out.n_tokens.sum() - 0.5) < 0.05
    assert mixed_sample(docs.limit(0)).count() == 0


def plain_best_fit(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [(b["rest"], k) for k, b in enumerate(bins) if b["rest"] >= n and s not in b["s"] and c not in b["c"]]
        if not fits:
            bins.append({"rest": capacity, "s": set(), "c": set()})
            fits = [(capacity, len(bins) - 1)]
        rest = min(fits)[0]
        k = out_of = [k for r, k in fits if r == rest]
        out.append((rest, out_of))
        # any bin of the tightest rest is right; the caller checks the choice and goes on with it
        k = yield out_of
        bins[k]["rest"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)


def test_best_fit_always_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 150
        lengths, sources, clusters = rng.integers(1, 51, n).tolist(), rng.integers(0, 6, n).tolist(), rng.integers(0, 40, n).tolist()
        chosen = best_fit(lengths, sources, clusters, 100)
        plain = plain_best_fit(lengths, sources, clusters, 100)
        allowed = next(plain)
        for k, b in enumerate(chosen):
            assert b in allowed
            allowed = plain.send(b) if k < n - 1 else None


def test_packing_keeps_every_token_and_no_conflict(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 11}", k % 50 if k % 4 else None, (k * 37) % 190) for k in range(3000)] + [(5000, None, None, 1234), (5001, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, cluster long, n_tokens long")
    out = packed(docs, capacity=100, shard_docs=500).toPandas()
    want = {r[0]: r[3] or 0 for r in rows}
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == want
    used = out[out.bin.notna()]
    assert (used.groupby("bin").n_tokens.sum() <= 100).all()
    by = {r[0]: r for r in rows}
    for _, group in used.groupby("bin"):
        sources, clusters = [by[d][1] for d in group.doc_id], [by[d][2] for d in group.doc_id if by[d][2] is not None]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
        at = 0
        for r in group.sort_values("start").itertuples():
            assert r.start == at
            at += r.n_tokens
    assert packed(docs.limit(0)).count() == 0


def test_block_max_search_equals_brute_force():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.linalg.norm(w)))
    dense = np.zeros((500, 40))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    index = BlockMaxIndex(vectors, 40, block=16)
    for k in range(0, 500, 7):
        ids, cosines = index.nearest(*vectors[k], 10)
        exact = dense @ dense[k]
        assert np.allclose(np.sort(exact)[::-1][:10], cosines) and np.allclose(exact[ids], cosines)


def test_search_with_dense_lists_equals_brute_force():
    rng = np.random.default_rng(12)
    common = np.arange(6)
    vectors = []
    for _ in range(700):
        t = np.unique(np.concatenate([common[rng.random(6) < 0.5], 6 + rng.integers(0, 3000, rng.integers(1, 25))]))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.linalg.norm(w)))
    vectors[9] = vectors[8]
    dense = np.zeros((700, 3006))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    index = BlockMaxIndex(vectors, 3006, block=16)
    assert 0 < len(index.matrix) <= 6
    start = np.cumsum([0, *(len(t) for t, _ in vectors[:-1])])
    found = list(index.nearest_of(start, *(np.concatenate(x) for x in zip(*vectors, strict=True)), 15))
    for k, (ids, cosines) in enumerate(found):
        exact = np.round(dense @ dense[k], 12)
        want = sorted(range(700), key=lambda i: (-exact[i], i))[:15]
        want = [i for i in want if exact[i] > 0]
        assert np.allclose(cosines, exact[want], atol=1e-9) and np.allclose(exact[ids], exact[want], atol=1e-9)


def plain_scores(docs, labels):
    """Toxicity scores by the definition: dictionaries, and cosines with every example."""
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    features = lambda t: Counter(f for w in split(t) for f in ([w] if len(w) < 4 else [w, b"." + w[:4]]))
    learnable = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    label = {}
    for i, y in labels:
        label[i] = max(label.get(i, 0), y)
    by_text = {}
    for i, t in docs:
        if i in label and learnable(i):
            known = by_text.get(t, (i, 0))
            by_text[t] = (min(known[0], i), max(known[1], label[i]))
    examples = sorted((i, y, features(t)) for t, (i, y) in by_text.items())
    n, toxic = len(examples), sum(y for _, y, _ in examples)
    rate, prior = toxic / n, (toxic + 0.5) / (n + 1)
    vocabulary = {f for _, _, x in examples for f in x}
    frequency = Counter(f for _, t in docs for f in set(features(t)))
    held, with_toxic = Counter(f for _, _, x in examples for f in x), Counter(f for _, y, x in examples if y for f in x)
    weight = {f: (math.log((1 + len(docs)) / (1 + frequency[f])) + 1) * math.sqrt(1 + (with_toxic[f] - held[f] * rate) ** 2 / (held[f] * rate) / (1 - rate) * n / (n - held[f] + 0.5)) for f in vocabulary}

    def vector(x):
        v = {f: (1 + math.log(c)) * weight[f] for f, c in x.items() if f in vocabulary}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {f: w / norm for f, w in v.items()}

    known = [(y, vector(x)) for _, y, x in examples]

    def vote(v, without=None):
        near = sorted((-round(sum(w * u.get(f, 0) for f, w in v.items()), 12), k) for k, (_, u) in enumerate(known) if k != without)[:15]
        near = [(-c, known[k][0]) for c, k in near if c < 0]
        return (sum(c * y for c, y in near) + 0.05 * prior) / (sum(c for c, _ in near) + 0.05) if near else None

    votes = [vote(v, k) for k, (_, v) in enumerate(known)]
    x, y = isotonic(np.array([prior if v is None else v for v in votes]), np.array([float(e[1]) for e in examples]))
    out = {}
    for i, t in docs:
        v = vote(vector(features(t)))
        out[i] = prior if v is None else min(1, max(0, 0.9 * float(np.interp(v, x, y)) + 0.1 * v))
    return out


def test_toxicity_scores_equal_brute_force_from_any_partitioning(spark):
    rng = np.random.default_rng(6)
    word = [f"w{k}x{k % 7}" for k in range(80)] + ["vile", "viler", "vilest", "Grim", "ßä"]
    docs = [(i, " ".join(rng.choice(word, rng.integers(1, 30)))) for i in range(300)]
    docs[40], docs[41] = (40, docs[42][1]), (41, docs[42][1])  # equal texts
    labels = [(i, int("vile" in t or rng.random() < 0.1)) for i, t in docs[:200]] + [(40, 1), (41, 0), (42, 0)]
    df, given = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    want = plain_scores(docs, labels)
    for parts in (1, 7):
        got = {r.doc_id: r.score for r in scored(df.repartition(parts), given.repartition(parts)).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-8) for i in want)
    model = fit(df, given)
    assert model.toxic[model.ids.tolist().index(min(i for i in (40, 41, 42) if zlib.crc32(str(i).encode()) % 5))] == max(y for i, y in labels if i in (40, 41, 42) and zlib.crc32(str(i).encode()) % 5)


def test_isotonic_pools_violations():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = scored(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    hit, wrong = out[out.toxic == 1].predicted.mean(), out[out.toxic == 0].predicted.mean()
    assert hit > 0.9 and wrong < 0.02 and out.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot " * 50000)], "doc_id long, text string")
    assert scored(odd, labels.limit(0)).count() == 3 and scored(odd.limit(0), labels).count() == 0


def test_toxicity_from_few_labels_at_any_share(spark):
    learnt = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:40]
    docs = spark.createDataFrame([(i, f"{'vile' if k % 2 else 'kind'} w{k} w{k + 1}") for k, i in enumerate(learnt)] + [(1000, "vile"), (1001, "kind"), (1002, "w7"), (1003, "w39")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(learnt)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in scored(docs, labels).filter("doc_id >= 1000").collect()}
    assert (got[1000].predicted, got[1001].predicted) == (1, 0)
    # A word of two examples is a term like any other.
    assert {e.doc_id for e in got[1002].evidence} == {learnt[6], learnt[7]} and {e.doc_id for e in got[1003].evidence} == {learnt[38], learnt[39]}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8).astype(np.float32).tolist() for _ in range(400)]
    vectors += [vectors[5]] * 60 + [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
    ids = list(range(len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>")
    got = {}
    for r in top_k(df, df.filter("vec_id % 10 = 0"), 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    x = np.floor(1024 * np.array(vectors[:460], float))
    for q in range(0, 460, 10):
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:10]
        assert [got[q][k + 1] for k in range(10)] == [(i, -s) for s, i in want]
    assert set(got) == set(range(0, 460, 10))
    assert top_k(df.limit(0), df, 10).count() == 0 and top_k(df, df.limit(0), 10).count() == 0


def plain_top_k(rows, k, is_query):
    good = [(i, np.floor(1024 * np.array(v, float))) for i, v in rows if i is not None and v and None not in v and np.isfinite(1024 * np.array(v, float)).all()]
    asked = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and is_query(i):
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        x = np.floor(1024 * np.array(v, float))
        best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_loses_nothing_where_ids_repeat(spark):
    rng = np.random.default_rng(11)
    pool = [rng.integers(-4, 5, 3).astype(float).tolist() for _ in range(12)]
    rows = []
    for i in range(60):
        for _ in range(int(rng.integers(1, 21)) if i % 4 == 0 else 1):
            rows.append((i, pool[int(rng.integers(12))] if rng.random() < 0.7 else rng.normal(size=3).tolist()))
        if i % 5 == 0:
            rows += [(i, [float("-inf"), 1.0, 0.0]), (i, None), (i, [None, 1.0, 2.0]), (i, [float("nan")] * 3), (i, [])]
    rows += [(0, pool[0])] * 30 + [(None, pool[0])] * 3 + [(90, [-0.0, 1.0]), (91, [0.0, 1.0]), (92, [1e306, 0.0]), (93, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = df.select("*", *(F.lit(1).alias(c) for c in ("v", "block", "slot", "query_id", "rank", "score", "dims", "ids", "asked", "upper", "turn", "of", "at", "vector", "query", "floor", "left")))
    for k in (1, 2, 3, 7, 12):
        for parts in (1, 5):
            got = sorted(map(tuple, top_k(clash.repartition(parts), clash.filter("vec_id % 3 = 0"), k).collect()))
            assert got == plain_top_k(rows, k, lambda i: i % 3 == 0)


def test_top_k_of_the_findings(spark):
    same = spark.createDataFrame([(0, [1.0, 2.0])] * 3 + [(5, [1.0, 2.0]), (9, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.vec_id) for r in top_k(same, same.filter("vec_id = 0"), 2).orderBy("rank").collect()] == [5, 9]
    bad = spark.createDataFrame([(0, [float("-inf"), 1.0]), (0, [1.0, 2.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in top_k(bad, bad.filter("vec_id = 0"), 2).collect()] == [(0, 3, 3 * 1024 * 1024)]


def test_toxicity_examples_are_bounded_by_their_features(spark):
    """Long examples do not make the model larger than its bound; those taken are taken whole, in the order of a hash."""
    rng = np.random.default_rng(2)
    text = lambda k, n: " ".join(f"{'vile' if k % 3 == 0 else 'kind'}{x}" for x in rng.integers(0, 40 if k % 2 else 100_000, n))
    rows = [(k, text(k, 60_000 if k == 7 else 2_000 if k % 2 == 0 else 50)) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    model = fit(docs, labels, max_features=40_000)
    sizes = {r.doc_id: r.n for r in docs.selectExpr("doc_id", "size(array_distinct(split(text, ' '))) n").collect()}
    assert 10 < len(model.ids) < 100 and sum(sizes[i] for i in model.ids.tolist()) <= 40_000 and len(model.terms.hashes) <= 40_000
    whole = fit(docs, labels)
    assert len(whole.ids) > len(model.ids) and set(model.ids.tolist()) <= set(whole.ids.tolist())
    out = scored(docs, labels).toPandas()
    assert ((out.score >= 0.5) == (out.doc_id % 3 == 0)).mean() > 0.9


def test_top_k_sends_no_table_by_way_of_the_driver(spark, monkeypatch):
    from storecast.llm import topk

    plans = []
    monkeypatch.setattr(topk, "written", lambda df, name, own=topk.written: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or own(df, name))
    df = spark.createDataFrame([(i, [float((i * j) % 7) for j in range(1, 5)]) for i in range(300)], "vec_id long, embedding array<float>")
    out = top_k(df, df.filter("vec_id % 10 = 0"), 5)
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    assert out.count() == 150
    assert not [name for name, plan in plans if "Broadcast" in plan]
    # No pair of a block and a query block is moved: their cells are scanned where they were joined.
    left = next(plan for name, plan in plans if name == "left")
    assert "Exchange" not in left[left.index("MapInArrow") : left.index("SortMergeJoin")]


def test_the_index_is_built_and_sent_with_little_besides_it(spark):
    from storecast.llm.store import sent

    rng = np.random.default_rng(5)
    sizes, n_terms = np.full(2000, 400), 40_000
    term = np.concatenate([np.sort(np.concatenate([np.flatnonzero(rng.random(300) < 0.6)[:150], 300 + rng.choice(n_terms - 300, 250, replace=False)])) for _ in range(len(sizes))]).astype(np.int32)
    sizes = np.diff(np.append(np.flatnonzero(np.diff(term, prepend=n_terms) < 0), len(term)))
    weight = rng.random(len(term))
    tracemalloc.start()
    index = BlockMaxIndex.of(sizes, term, weight, n_terms)
    held, most = tracemalloc.get_traced_memory()
    own = {k: v.nbytes for k, v in vars(index).items() if isinstance(v, np.ndarray)}
    assert len(index.matrix) and len(index.owner) and most < 2.2 * sum(own.values())
    tracemalloc.reset_peak()
    get = sent(spark, index)
    most = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert most < 1.1 * max(own.values()) + 1_000_000
    start = np.cumsum(sizes) - sizes
    near = lambda x: [a.tolist() for a in x.nearest(term[: start[1]], weight[: start[1]], 5)]
    assert spark.sparkContext.parallelize([0], 1).map(lambda _: near(get())).first() == near(index)
