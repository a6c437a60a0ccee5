"""Repeated passages against brute force; license notices with edits."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from storecast.llm.induced_sort import CAP, Queue, Spool, suffixes
from storecast.llm.license_scan import CONTAINMENT, TEMPLATES, WORD, Scanner, license_matches, notices, shingles
from storecast.llm.suffix_dedup import repeats_removed


def plain(texts, length):
    """Removed bytes by the definition; texts in the order of their ids."""
    first, out = {}, []
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], (d, p))
    for d, t in enumerate(texts):
        lost = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] != (d, p):
                lost[p : p + length] = True
        spans = int((lost & ~np.concatenate([[False], lost[:-1]])).sum())
        out.append((len(t), int(lost.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~lost])))
    return out


def in_order(text, memory, direct):
    batches = list(suffixes(text, np.cumsum(np.bincount(text)) - np.bincount(text), memory, direct))
    return [np.concatenate(x) for x in zip(*batches, strict=True)]


@pytest.mark.parametrize(("memory", "direct"), [(1 << 20, 1 << 20), (1 << 20, 0), (1, 20), (1, 0)])
def test_suffixes_and_shared_prefixes_equal_a_plain_scan(memory, direct):
    rng = np.random.default_rng(4)
    bodies = [rng.integers(1, 2 + k % 9, int(rng.integers(0, 300))) for k in range(60)]
    bodies += [np.tile(rng.integers(1, 5, k), 40) for k in range(1, 9)] + [np.ones(600, int)]
    for body in bodies:
        text = np.append(body, 0).astype(np.uint16)
        plain_text = text.tolist()
        order, shared = in_order(text, memory, direct)
        want = sorted(range(len(text)), key=lambda i, t=plain_text: t[i:])
        if len(body) < CAP:
            assert order.tolist() == want
        for a, b, n in zip(order, order[1:], shared[1:], strict=False):
            x, y = plain_text[a : a + CAP], plain_text[b : b + CAP]
            assert x <= y and n == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), CAP)


def test_sorting_far_more_than_memory_holds():
    """Tuples of 24 bytes for each of 300,000 symbols go through queues that hold a twentieth of the text's own bytes."""
    rng = np.random.default_rng(5)
    rows = rng.integers(2, 60, (200, 120))[rng.integers(0, 200, 2500)]
    rows[np.arange(2500), rng.integers(0, 120, 2500)] = 1
    spool = Spool(np.uint16)
    spool.append(np.append(rows.ravel(), 0))
    del rows
    text, memory = spool.mapped(), spool.n * 2 // 20
    starts = np.cumsum(np.bincount(text)) - np.bincount(text)
    seen, last, spilled, push = 0, None, [], Queue.push

    def counted(self, *x):
        push(self, *x)
        spilled.append(self.spilled)

    Queue.push = counted
    tracemalloc.start()
    try:
        for place, shared in suffixes(text, starts, memory, 1000):
            seen += len(place)
            last = (place, shared)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        Queue.push = push
        tracemalloc.stop()
    assert seen == len(text) and max(spilled) > len(text) / 4
    assert peak < 2 * len(text), peak  # the tuples of one pass are 24 bytes each
    place, shared = last
    for a, b, n in zip(place, place[1:], shared[1:], strict=False):
        x, y = text[a : a + CAP].tolist(), text[b : b + CAP].tolist()
        assert x <= y and n == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), CAP)


def test_queue_gives_keys_in_order_and_equal_ones_as_they_came():
    rng = np.random.default_rng(6)
    key = rng.integers(0, 9, 500)
    queue = Queue(np.array([0, 3, 4]), np.array([False, True, False]), 1)
    for s in range(0, 500, 50):
        queue.push(key[s : s + 50], np.arange(s, s + 50), np.arange(s, s + 50))
    assert np.concatenate([x[:, 1] for x in queue.drain()]).tolist() == np.argsort(key, kind="stable").tolist() and queue.spilled


def texts_with_repeats():
    rng = np.random.default_rng(8)
    word = lambda n: bytes(rng.integers(97, 105, n).astype(np.uint8))
    passage, other = word(260), "é".encode() * 90
    texts = [word(int(rng.integers(0, 500))) for _ in range(30)]
    for k in range(30):
        if k % 2:
            cut = int(rng.integers(0, 200))
            texts[k] = texts[k] + passage[cut:] + word(50) + (passage if k % 3 == 0 else b"")
        if k % 5 == 0:
            texts[k] += other
        if k % 7 == 0:
            texts[k] = texts[(k + 3) % 30]
    return [*texts, b"", b"a" * 700, b"ab" * 300, passage, passage[:99], passage[:100]]


@pytest.mark.parametrize(("heavy", "memory"), [(4096, 1 << 23), (2, 1 << 10)])
def test_repeats_equal_brute_force(spark, heavy, memory):
    texts = texts_with_repeats()
    rows = [(i, t.decode("utf-8", "replace"), 1, 2) for i, t in enumerate(texts)]
    texts = [r[1].encode() for r in rows]
    docs = spark.createDataFrame([*rows[::-1], (99, None, 1, 2), (None, texts[1].decode(), 1, 2)], "doc_id long, text string, start long, of long").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats_removed(docs, heavy=heavy, memory=memory).collect()}
    for i, want in enumerate(plain(texts, 100)):
        assert got[i] == want, i
    assert got[99] == (0, 0, 0, b"") and got[None][1] == 0
    assert repeats_removed(docs.limit(0)).count() == 0


def test_repeats_on_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text.encode()) for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats_removed(docs).collect()}
    assert [got[i] for i, _ in texts] == plain([t for _, t in texts], 100)
    assert sum(x[1] for x in got.values()) > 0


def test_licenses(spark):
    filler = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor " * 40
    rows = [(k, f"{filler} {TEMPLATES[n].upper()} {filler}") for k, n in enumerate(sorted(TEMPLATES))]
    changed = TEMPLATES["MIT text"].replace("restriction", "limits")
    broken = " ".join(w + (" x" if i % 4 == 0 else "") for i, w in enumerate(TEMPLATES["MIT text"].split()))
    rows += [(20, TEMPLATES["MIT"]), (21, filler), (22, None), (23, ""), (24, changed), (25, broken), (26, "under the MIT"), (27, f"{TEMPLATES['MIT']} {TEMPLATES['MIT']}")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in license_matches(docs).collect()}
    for k, n in enumerate(sorted(TEMPLATES)):
        assert n in got[k].licenses.split(","), n
        m = next(m for m in got[k].matches if m["license"] == n)
        assert m.containment == 1 and rows[k][1].encode()[m.start : m.end].decode().rstrip(".:").lower() in TEMPLATES[n].lower()
    assert [got[k].licenses for k in (20, 21, 22, 23, 24, 25, 26)] == ["MIT", "", "", "", "MIT text", "", ""]
    assert got[27].n_matches == 2
    assert license_matches(docs.limit(0)).count() == 0


def test_licenses_with_inserted_words(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use'
    filler = "lorem ipsum dolor sit amet consetetur " * 30
    apache = TEMPLATES["Apache-2.0 header"].replace("you may", "as we said in the notes of this release you may")
    rows = [(1, mit), (2, f"{filler} {mit} {filler}"), (3, "x"), (4, apache), (5, f"{mit} {mit}")]
    got = {r.doc_id: r for r in license_matches(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [got[k].licenses for k in range(1, 6)] == ["MIT text", "MIT text", "", "Apache-2.0", "MIT text"]
    assert got[1].matches[0].containment == 19 / 23 and got[5].n_matches == 2
    m = got[2].matches[0]
    assert rows[1][1][m.start : m.end] == mit[: mit.index(", including")]


def test_licenses_equal_brute_force():
    rng = np.random.default_rng(5)
    scanner, texts = Scanner(TEMPLATES), []
    for _ in range(300):
        own = list(map(str, rng.integers(0, 50, rng.integers(0, 60))))
        for name in rng.choice(sorted(TEMPLATES), rng.integers(0, 3)):
            notice = TEMPLATES[name].split()
            for _ in range(rng.integers(0, 3)):
                cut = int(rng.integers(0, len(notice)))
                notice[cut : cut + int(rng.integers(0, 2))] = ["more"] * int(rng.integers(0, 15))
            cut = int(rng.integers(0, len(own) + 1))
            own[cut:cut] = notice
        texts.append(" ".join(own).encode())
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = scanner.scan(np.frombuffer(b"".join(texts), np.uint8), offsets)
    found = 0
    for r, text in enumerate(texts):
        words, want = WORD.findall(text.lower()), set()
        for name in TEMPLATES:
            template = WORD.findall(TEMPLATES[name].lower().encode())
            mine, size = shingles(template), min(5, len(template))
            best = len(mine & {tuple(words[j : j + size]) for j in range(len(words) - size + 1)})
            if best / len(mine) >= CONTAINMENT:
                want.add(name)
        assert {m["license"] for m in got.get(r, [])} == want, r
        found += len(want)
    assert found > 100


def test_any_number_of_inserted_words_equals_a_plain_count(spark):
    """0 to 200 words put in at one to three places, through Spark, against a count over the whole text."""
    rng = np.random.default_rng(6)
    texts = []
    for n in (0, 1, 5, 12, 26, 27, 28, 29, 40, 80, 150, 200):
        for places in (1, 2, 3):
            for name in ("MIT text", "Apache-2.0 header", "GPL-3.0", "BSD-3-Clause"):
                own = TEMPLATES[name].split()
                for cut in sorted(rng.choice(np.arange(1, len(own)), places, replace=False), reverse=True):
                    own[cut:cut] = [f"w{x}" for x in rng.integers(0, 500, n)]
                texts.append(" ".join([*(f"v{x}" for x in rng.integers(0, 500, int(rng.integers(0, 60)))), *own, "end of it"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for stretch in (1, 2, 3.5):
        got = {r.doc_id: r for r in license_matches(docs, stretch=stretch).collect()}
        found = 0
        for k, text in enumerate(texts):
            words, want = WORD.findall(text.lower().encode()), set()
            for name, template in TEMPLATES.items():
                mine = shingles(WORD.findall(template.lower().encode()))
                size = len(next(iter(mine)))
                if len(mine & {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}) >= CONTAINMENT * len(mine) - 1e-9:
                    want.add(name)
            assert set(filter(None, got[k].licenses.split(","))) == want, (k, stretch)
            found += len(want)
        assert found > 40


def test_notices_do_not_overlap():
    assert list(notices([0, 1, 2, 3, 7, 8], list("abcdab"), 2, 9, 2)) == [(0, 5, 4), (7, 10, 2)]


def test_rows_that_repeat_an_id_are_texts_of_their_own(spark):
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 105, n).astype(np.uint8)).decode()
    passage, own = word(250), word(150)
    rows = [(7, own), (7, passage + word(80)), (7, word(30) + passage), (7, "twice " + word(120)), (2, passage[:140]), (None, passage), (None, own), (None, None), (9, own[10:] + word(5)), (7, "")]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {(r.doc_id, r.text): (r.doc_id, r.a, r.b) for r in df.filter("doc_id is not null").select("doc_id", "text", F.xxhash64(F.col("text").cast("binary")).alias("a"), F.xxhash64(F.lit(1), F.col("text").cast("binary")).alias("b")).collect()}
    order = sorted(hashed, key=hashed.get)
    want = dict(zip(order, plain([t.encode() for _, t in order], 100), strict=True))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats_removed(df).collect())
    assert got == sorted((i or -1, *want.get((i, t), (len(t or ""), 0, 0, (t or "").encode()))) for i, t in rows)


def test_matches_do_not_depend_on_the_texts_before(spark):
    rng = np.random.default_rng(5)
    word = lambda: "t" + str(rng.integers(0, 10**6))
    long = [word() for _ in range(64)]
    full = [word() for _ in range(2000)]  # as long as a whole license
    notes = [" ".join(long[:54]), " ".join(long[3:60]), " ".join([*long[:30], "put", "in", *long[30:]]), " ".join(full[:1700]), " ".join([*full[:900], *full[1000:]]), " ".join(long[:20])]
    scanner = Scanner({"long": " ".join(long), "full": " ".join(full)})

    def found(lead, text):
        data = f"{lead}{text}".encode()
        return scanner.scan(np.frombuffer(data, np.uint8), np.array([0, len(lead), len(data)])).get(1, [])

    alone = [found("", t) for t in notes]
    assert [[x["license"] for x in got] for got in alone] == [["long"], ["long"], ["long"], ["full"], ["full"], []]
    for n in range(1, 21):
        lead = "foreign word " * n + "\n"
        assert [found(lead, t) for t in notes] == alone
