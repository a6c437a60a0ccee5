"""Importance resampling, infilling and URL filters against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storecast.llm.importance import importance_sample
from storecast.llm.infill import infilled, restored, unit_ends
from storecast.llm.url_filter import BLOCK, RULES, Bloom, build, estimated_bytes, hosts_with, judged, keyed, places, shape

CLASHES = "h n ends a b keys pairs mask kind best buckets words weight score rank place eligible form output bucket host path rule verdict listed".split()


def clashing(df):
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES if c not in df.columns))


def digest(seed, doc_id):
    return hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()


# Importance resampling


def plain_sample(docs, target, buckets=10_000, percent=10, least=20, seed=2024, ngrams=1):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i : i + k]) for k in range(1, ngrams + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own, wanted = [(i, *features(t)) for i, t in docs], [features(t)[1] for t in target]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, f in own:
        np.add.at(s, f, 1)
    for f in wanted:
        np.add.at(t, f, 1)
    gain = np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(int)
    rows = []
    for i, n, f in own:
        u = (int(digest(seed, i)[:8], 16) + 0.5) / 4294967296
        w = int(gain[f].sum()) if f else 0
        rows.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log(u))), None])
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(long[: len(long) * percent // 100]):
        r[5] = k + 1
    return sorted(map(str, map(tuple, rows)))


def ranked(out):
    return sorted(str((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"])) for r in out.collect())


def some_texts(n, seed):
    dice = random.Random(seed)
    vocabulary = ["alpha", "BETA", "gamma9", "été", "straße", "日本語", "İstanbul", "x", "😀", "K"] + [f"w{k}" for k in range(200)]
    return [" ,;\n".join(dice.choice(vocabulary) for _ in range(dice.choice([0, 1, 19, 20, 21, 60]))) for _ in range(n)]


@pytest.mark.parametrize("ngrams", [1, 3])
def test_sample_equals_plain_python(spark, ngrams):
    docs = [(k, t) for k, t in enumerate(some_texts(300, 1))] + [(None, "a b " * 20), (7, None), (8, ""), (8, "a b " * 20), (8, "a b " * 20), (400, "word " * 60_000)]
    target = [*some_texts(40, 2), None]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    out = importance_sample(df, spark.createDataFrame([(t,) for t in target], "text string"), buckets=997, percent=30, ngrams=ngrams)
    assert ranked(out) == plain_sample(docs, target, buckets=997, percent=30, ngrams=ngrams)


def test_sample_of_the_whole_table(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = importance_sample(docs, target)
    assert ranked(out) == plain_sample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


def test_sample_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert importance_sample(docs.limit(0), docs).count() == 0
    got = {r.doc_id: r for r in importance_sample(docs, docs.limit(0), least_words=0, percent=100).collect()}
    assert got[2].weight == 0 and {r["rank"] for r in got.values()} == {1, 2}


def test_rows_alike_in_score_are_all_drawn_once(spark):
    docs = spark.createDataFrame([(5, "same words " * 15)] * 400 + [(k, "same words " * 15) for k in range(400)], "doc_id long, text string").repartition(16)
    got = importance_sample(docs, docs, percent=50).filter("rank is not null").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 401))


# Infilling


def plain_infill(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(digest(seed, doc_id)[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = ["", None, "\n", "\n\n", "one line", "one\n", "é\n\nb\u2028c\r\nd\x0be\x85f\n", "😀\n" * 9, "<", "a<\n<P\nS>\n>M>", "has <M> mark", "x" * 40_000, "y" * 16_384 + "\n" + "z" * 16_383 + "\nend", "line of text\n" * 30_000, "<P\n>" * 20, "\x00\n\x00"]


def test_infill_equals_plain_python(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS * 12)] + [(None, "a\nb\nc"), (3, "a\nb"), (3, "a\nb"), (-5, "q\n" * 7), (2**62, "q\nr")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.lit(1)))
    for options in ({}, {"rate": 50, "spm": 90, "seed": 3}):
        out = infilled(df, **options).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
        got = sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out)
        assert got == sorted(str(plain_infill(k, t, **options)) for k, t in docs)
        assert all(r.again == r.text for r in out)
    assert infilled(df.limit(0)).count() == 0


def test_units_do_not_depend_on_the_pieces():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    from storecast.llm.infill import LINES

    split = Split(Regex(LINES), "isolated")
    dice = random.Random(5)
    for _ in range(200):
        text = "".join(dice.choice("ab\n\néx😀") for _ in range(dice.randrange(40)))
        ends = [m.end() for m in re.finditer(LINES, text)]
        assert all(unit_ends(text, split, piece) == ends for piece in (1, 2, 3, 7, 100))


# URL filters


def plain_verdict(url, rules, listed):
    if url is None or "://" not in url:
        host = path = ""
    else:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), len(h), v == "block", h + p) for v, h, p in rules if under(h) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], "block" if max(fits)[2] else "allow"
    return host, path, None, "block" if any(map(under, listed)) else "allow"


URLS = [
    None, "", "no scheme", "http:/a.org/", "http://EXAMPLE.org/es/x", "https://a.b.Example.Org/en/12?q=/es/", "ftp://org/", "x://org", "x://org?/", "x://org#/", "x://y.org/es/", "x://badexample.org/es/", "x://example.org/ES/", "x://user@a.com:80/fr/",
    "x://a.com/fr/1", "x://a.com/de/1", "x://com/de/", "x://a.net/de/", "x://..org/", "x://cheap-pills.net/q", "x://a.cheap-pills.com/fr/", "x://y/http://example.org/es/", "x://a.org/\n?b", "://org/", "x://" + "a." * 3000 + "org/" + "p" * 9000, "x://é.com/fr/é",
]


@pytest.mark.parametrize("most_bytes", [1 << 26, 40])
def test_verdicts_equal_plain_python(spark, most_bytes):
    urls = URLS + [f"http://h{k % 90}.{'example' if k % 2 else 'other'}.{('org', 'com', 'net')[k % 3]}/{('es', 'en', 'fr', 'de')[k % 4]}/{k}" for k in range(400)]
    rows = [(k, u) for k, u in enumerate(urls)] + [(None, "x://a.org/"), (3, "x://a.com/de/"), (3, "x://a.com/de/")]
    listed = ["cheap-pills.net", "h3.example.com", "other.net", "H7.other.org", None, "", "never-seen.net"]
    rules = (*RULES, ("allow", "h5.other.net", "/es/"), ("block", "h5.other.net", "/es/"), ("block", "org", "/en/100"))
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string"))
    out = judged(pages, rules, spark.createDataFrame([(h,) for h in listed], "host string"), most_bytes=most_bytes)
    got = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in out.collect())
    assert got == sorted(str((k, *plain_verdict(u, rules, [h.lower() for h in listed if h]))) for k, u in rows)


def test_no_pages_no_rules_no_list(spark):
    pages = spark.createDataFrame([(1, "x://a.org/"), (2, None)], "page_id long, url string")
    assert judged(pages.limit(0)).count() == 0
    assert {(r.rule, r.verdict) for r in judged(pages, ()).collect()} == {(None, "allow")}
    assert {r.verdict for r in judged(pages, (), pages.limit(0).select("url")).collect()} == {"allow"}


def test_all_pages_equal_plain_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    listed = [r.host for r in hosts_with(pages).collect()]
    assert listed
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(pages, listed=hosts_with(pages)).collect()}
    assert got == {r.page_id: plain_verdict(r.url, RULES, listed) for r in pages.select("page_id", "url").collect()}


def test_cascade_tells_all_keys_of_the_corpus_apart(spark):
    hosts = [f"h{k}.net" for k in range(6000)]
    pages = spark.createDataFrame([(k, f"x://{h}/a") for k, h in enumerate(hosts)], "page_id long, url string")
    rows = keyed(pages, "page_id", "url", [0], 2)
    listed = spark.createDataFrame([(BLOCK, h) for h in hosts[:500]], "kind int, key string").selectExpr("kind", "key", "xxhash64(1, key) a", "xxhash64(2, key) b")
    cascades = build(listed, rows, 12_000)
    keys = rows.selectExpr("explode(arrays_zip(keys, a, b)) x").select("x.*").distinct().toPandas()
    found = cascades.holds(keys.a.to_numpy(), keys.b.to_numpy()) > 0
    assert set(keys["keys"][found]) == set(hosts[:500]) and len(cascades.levels[BLOCK]) > 1
    assert sum(len(x.bits[: -(-x.size // 8)]) for x in cascades.levels[BLOCK]) < 2 * estimated_bytes(500, 12_000)


def test_a_filter_takes_in_strangers_at_its_rate():
    dice = np.random.default_rng(1)
    a, b = (dice.integers(-(2**63), 2**63 - 1, 40_000) for _ in range(2))
    size, hashes = shape(20_000, 1 / 64)
    bloom = Bloom(np.zeros(-(-size // 8), np.uint8), size, hashes)
    for at in places(a[:20_000], b[:20_000], 3, size, hashes):
        np.bitwise_or.at(bloom.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
    assert bloom.holds(a[:20_000], b[:20_000], 3).all() and 0.005 < bloom.holds(a[20_000:], b[20_000:], 3).mean() < 0.03
