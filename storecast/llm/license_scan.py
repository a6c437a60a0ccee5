"""License notices in texts: MinHash bands over overlapping windows, then exact containment.

A notice may hold 0.8 of a template's five-word shingles. Words put in between
them break four shingles at least, so a template that may miss four is looked
for in windows of twice its words, any other in windows of its own length;
windows start every few words of a text, so one covers a notice of that length whole. A
window's MinHash values are minima over its shingles; their bands are looked
up among the templates' own. From the window's length follows the least
similarity of window and template, and from that the number of bands: a notice
is missed with a probability of at most MISS. Windows without a shingle of any
template share no minimum with one and are not hashed further. What the bands
retrieve is then compared word by word.

A notice that is longer than any window, because more was put in, is found by
the exact count that follows: of the shingles that stand in a text outside the
notices found so far, and that the windows' first step has at hand anyway, the
shortest stretch with the most distinct ones matches if these are 0.8 of the
template's and it is longer than the windows. So the stretch of the windows
decides how a notice is found, not whether.

Templates are a parameter; each adds a fixed cost, and they are sent with the
code. Texts are scanned where they lie, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import lowered, mixed, pieces, prefix_sums, run_hash, words

# Short notices as people write them, and the first sentences of common licenses.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
SHINGLE, CONTAINMENT, ROWS, MISS, SEED = 5, 0.8, 2, 1e-4, 11
#: The longest notice that windows cover, as a multiple of its template, where words may be put in; longer ones are counted over the text.
STRETCH = 2
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
TOP = np.uint64(2**64 - 1)


def word_mask(low: np.ndarray) -> np.ndarray:
    return (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))


def shingles(own: list[bytes]) -> set[tuple[bytes, ...]]:
    """The five-word shingles; the whole sequence if it is shorter."""
    return {tuple(own[i : i + SHINGLE]) for i in range(max(1, len(own) - SHINGLE + 1))} if own else set()


def shingle_hashes(word: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    n = max(0, len(word) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + word[k : k + n]
    return mixed(h)


def longest(n_words: int, stretch: float = STRETCH) -> int:
    """Words of the longest notice that a window covers: shingles on both sides of an insertion are kept only if those across it may be missing."""
    own = max(1, n_words - SHINGLE + 1)
    return int(stretch * n_words) if own - math.ceil(CONTAINMENT * own - 1e-9) >= SHINGLE - 1 else n_words


def plan(n_words: int, stretch: float = STRETCH) -> tuple[int, int, int]:
    """Words of a window, words from one to the next, and bands, for a template of so many words."""
    step = max(1, n_words // 16)
    size = longest(n_words, stretch) + step - 1
    own, theirs = max(1, n_words - SHINGLE + 1), max(1, size - SHINGLE + 1)
    shared = math.ceil(CONTAINMENT * own - 1e-9)
    least = shared / (own + theirs - shared)
    bands = 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least**ROWS))
    return size, step, bands


def covered(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Which of n positions are at most ``before`` ahead of one of ``at``, or at most ``after`` behind it."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.maximum(at - before, 0), 1)
    np.add.at(edges, np.minimum(at + after + 1, n), -1)
    return np.cumsum(edges[:-1]) > 0


def notices(at: list[int], shingle: list, need: int, size: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(first word, end word, distinct shingles) of stretches of at most ``size`` words with ``need`` shingles of ``length`` words.

    Of stretches that begin within one, the one with the most shingles, then
    the shortest, then the first; they do not overlap.
    """
    begin = 0
    while begin < len(at):
        held: dict = {}
        left, best, limit = begin, None, None
        for right in range(begin, len(at)):
            held[shingle[right]] = held.get(shingle[right], 0) + 1
            while at[right] + length - at[left] > size or held[shingle[left]] > 1:
                held[shingle[left]] -= 1
                if not held[shingle[left]]:
                    del held[shingle[left]]
                left += 1
            if limit is not None and at[left] >= limit:
                break
            if len(held) >= need:
                limit = at[right] + length if limit is None else limit
                found = (len(held), at[left] - at[right], -left, right)
                best = found if best is None or found[:3] > best[:3] else best
        if best is None:
            return
        first, end = at[-best[2]], at[best[3]] + length
        yield first, end, best[0]
        while begin < len(at) and at[begin] < end:
            begin += 1


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minima of every window of ``size``; what lies past the end counts as largest."""
    x, done = np.concatenate([x, np.full(size, TOP)]), 1
    while done < size:
        by = min(done, size - done)
        x = np.minimum(x[:-by], x[by:])
        done += by
    return x


class Scanner:
    def __init__(self, templates: Mapping[str, str], stretch: float = STRETCH):
        if stretch < 1:
            raise ValueError("a window covers its template at least")
        self.stretch = stretch
        rng = np.random.default_rng(SEED)
        self.names = sorted(templates)
        self.words = [WORD.findall(templates[n].encode().lower()) for n in self.names]
        self.shingles = [shingles(w) for w in self.words]
        self.by_length: dict[int, list[int]] = {}
        for k, own in enumerate(self.words):
            if own:
                self.by_length.setdefault(len(own), []).append(k)
        most = max((plan(n, stretch)[2] for n in self.by_length), default=0) * ROWS
        self.factors = rng.integers(0, 2**63, most, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.keys, self.known, self.maybe, self.mine = {}, {}, {}, {}
        for n, of in self.by_length.items():
            found: dict[int, list[int]] = {}
            known = []
            for k in of:
                data = np.frombuffer(b" ".join(self.words[k]), np.uint8)
                start, end, _ = words(data, np.array([0, len(data)]), word_mask(data))
                h = shingle_hashes(run_hash(prefix_sums(data), start, end), min(SHINGLE, n))
                known.append(h)
                self.mine[k] = np.unique(h)
                for band in range(plan(n, stretch)[2]):
                    found.setdefault(int(self.band(h, band, lambda x: x.min()[None])[0]), []).append(k)
            self.keys[n] = (np.array(sorted(found), np.uint64), found)
            self.known[n] = np.unique(np.concatenate(known))
            self.maybe[n] = np.zeros(1 << 16, bool)
            self.maybe[n][(self.known[n] & np.uint64(0xFFFF)).astype(np.int64)] = True

    def band(self, h: np.ndarray, band: int, least) -> np.ndarray:
        """A band's value from the minima that ``least`` takes of the permuted hashes."""
        out = np.uint64(band)
        for r in range(ROWS):
            x = h * self.factors[band * ROWS + r]
            out = mixed(least(x ^ (x >> np.uint64(29))) + out)
        return out

    def known_shingles(self, word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template length, shingle hashes, where those of a template of this length stand), where there are any."""
        hashes = {length: shingle_hashes(word, length) for length in {min(SHINGLE, n) for n in self.by_length}}
        low = {length: (h & np.uint64(0xFFFF)).astype(np.int64) for length, h in hashes.items()}
        for n in self.by_length:
            h = hashes[min(SHINGLE, n)]
            some = np.flatnonzero(self.maybe[n][low[min(SHINGLE, n)]])
            some = some[np.isin(h[some], self.known[n])]
            if len(some):
                yield n, h, some

    def candidates(self, found_shingles: list, place: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, first word of a window) of every collision; ``place`` numbers the words of each text."""
        for n, h, some in found_shingles:
            size, step, bands = plan(n, self.stretch)
            length, (keys, found) = min(SHINGLE, n), self.keys[n]
            width = max(1, size - length + 1)
            # Whole windows around the templates' shingles, side by side; one that runs over a seam begins too far from a shingle.
            near = np.flatnonzero(covered(some, width - 1, width - 1, len(h)))
            starts = np.flatnonzero(covered(some, width - 1, 0, len(h))[near] & (place[near] % step == 0))
            h = h[near]
            for band in range(bands):
                value = self.band(h, band, lambda x, width=width, starts=starts, m=len(h): sliding_min(x, width)[:m][starts])
                at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                for i in np.flatnonzero(keys[at] == value).tolist():
                    for k in found[int(value[i])]:
                        yield k, int(near[starts[i]])

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[dict]]:
        """By row: the notices with their bytes and the share of the template's shingles they hold."""
        low = lowered(data)
        start, end, row = words(low, offsets, word_mask(low))
        if not len(start):
            return {}
        raw, out = low.tobytes(), {}
        known = list(self.known_shingles(run_hash(prefix_sums(low), start, end)))
        of: dict[int, list[int]] = {}
        for k, first in sorted(set(self.candidates(known, np.arange(len(row)) - np.searchsorted(row, row)))):
            of.setdefault(k, []).append(first)

        def stretches(k: int, at: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
            """Notices of template k among its shingles that begin at the words ``at`` of one text, as first and end word, with their shingles."""
            length, mine = min(SHINGLE, len(self.words[k])), self.shingles[k]
            tuples = [tuple(raw[start[j] : end[j]] for j in range(i, i + length)) for i in at.tolist()]
            hit = [(i, x) for i, x in zip(at.tolist(), tuples, strict=True) if x in mine]
            yield from notices([i for i, _ in hit], [x for _, x in hit], math.ceil(CONTAINMENT * len(mine) - 1e-9), most, length)

        def add(k: int, first: int, last: int, held: int) -> None:
            r = int(row[first])
            out.setdefault(r, []).append({"license": self.names[k], "start": int(start[first] - offsets[r]), "end": int(end[last - 1] - offsets[r]), "containment": held / len(self.shingles[k])})

        taken: dict[int, list[tuple[int, int]]] = {}
        for k, firsts in of.items():
            n = len(self.words[k])
            size, length = plan(n, self.stretch)[0], min(SHINGLE, n)
            at = np.flatnonzero(covered(np.array(firsts), 0, size - 1, len(row)))
            # Runs of words of one text; a window at the seam of texts is looked at in each.
            for run in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(row[at]) > 0)) + 1):
                for found in stretches(k, run[: len(run) - length + 1], longest(n, self.stretch)):
                    add(k, *found)
                    taken.setdefault(k, []).append(found[:2])
        for n, h, some in known:
            length = min(SHINGLE, n)
            some = some[row[np.minimum(some + length - 1, len(row) - 1)] == row[some]]
            for k in self.by_length[n]:
                mine = some[np.isin(h[some], self.mine[k])]
                for first, last in taken.get(k, ()):
                    mine = mine[(mine + length <= first) | (mine >= last)]
                need = math.ceil(CONTAINMENT * len(self.shingles[k]) - 1e-9)
                if len(mine) < need:
                    continue
                # Texts with enough distinct shingles of the template; few are left.
                each, begin = np.unique(row[mine], return_index=True)
                for part in np.split(mine, begin[1:]):
                    if len(np.unique(h[part])) >= need:
                        for first, last, held in stretches(k, part, len(row)):
                            if last - first > longest(n, self.stretch):
                                add(k, first, last, held)
        return out


MATCH = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: Mapping[str, str] = TEMPLATES, stretch: float = STRETCH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_matches, licenses, matches (license, start and end byte, containment).

    Words are runs of letters and digits, A-Z in lower case. A notice matches
    when a stretch of text holds 0.8 of the template's five-word shingles; a
    template of fewer words must be there whole. Windows cover stretches as long
    as the template, or ``stretch`` times that where inserted words leave 0.8
    whole; stretches of more words, however many, are found by an exact count
    over the rest of the text. Overlapping stretches of one notice give the best,
    the shortest and first of equals. ``licenses`` lists the names once, in
    order. A null or empty text has no matches; rows that repeat an id are
    scanned each; texts of any length are scanned whole; an empty table gives an
    empty result. An empty template matches nothing. Other columns, whatever
    their names, are not read.
    """
    scanner = Scanner(templates, stretch)

    @F.arrow_udf("array<struct<license:string,start:long,end:long,containment:double>>")
    def found(text: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in range(len(text))]
        for first, _, data, offsets in pieces(text):
            for r, hits in scanner.scan(data, offsets).items():
                out[first + r] = sorted(hits, key=lambda x: (x["start"], x["license"]))
        return pa.array(out, MATCH)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), found(F.col(text_col).cast("binary")).alias("matches"))
    return rows.select("doc_id", F.size("matches").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"), "matches")
