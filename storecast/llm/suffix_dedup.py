"""Repeated passages: every byte covered by a string of 100 bytes that starts earlier too.

Strings of LENGTH bytes (windows) are sorted as suffixes, in shards. To bring
equal windows into one shard, each window has an anchor: the k-mer with the
smallest hash in it, which equal windows share at the same place. Runs of
windows with one anchor are snippets. First the anchors' hashes alone are
sent, and blocks of documents get back those that occur more than once: only
their snippets go on. Equal snippets of a block are sent once, by their first place; the others are
covered whole. A shard is a sorted partition of snippets, read as a stream;
it drops equal snippets likewise, writes the others to a file and sorts their
suffixes by external induction (:mod:`.induced_sort`), which also tells how
many bytes neighbours share. Those that share LENGTH bytes are equal windows;
all but the first in the order of the documents are covered.

An anchor with more than HEAVY snippets (around a passage that very many
documents hold) first drops equal snippets in SALTS parts; if it still has
more, it is taken apart into windows, which are dealt by their own hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced_sort import CAP, MEMORY, Spool, blank, least_between, suffixes
from .store import written
from .text import MIX_1, bytes_of, mixed, pieces, prefix_sums, run_hash, window_sums

LENGTH, KMER = 100, 36
BUCKET_ANCHORS, SHARD_BYTES, HEAVY, SALTS, ROWS = 1 << 20, 1 << 23, 4096, 64, 8192
PIECE, BLOCK_BYTES, UPPER = 1 << 19, 1 << 24, np.uint64(0xFFFFFFFF00000000)
FOUND = "doc_id long, start long, end long, route long, rel int, snippet binary"


def snippets(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """First and last window of each run with one anchor, the anchor's place and hash, and the row."""
    n = len(data) - kmer + 1
    if n <= 0 or len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    sums = window_sums(data, kmer)
    # The leftmost of the smallest, by the upper half of a product: the same in equal windows.
    least = sums * MIX_1
    least &= UPPER
    least |= np.arange(n, dtype=np.uint64)
    done, size = 1, length - kmer + 1
    while done < size:
        by = min(done, size - done)
        least = np.minimum(least[:-by], least[by:])
        done += by
    # A run ends where the anchor changes, and where windows begin or cease to lie in one text.
    new = np.concatenate([[True], least[1:] != least[:-1]])
    edge = np.concatenate([offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])])
    new[edge[edge < len(new)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    row = np.searchsorted(offsets, first, "right") - 1
    own = first + length <= offsets[row + 1]
    first, last, row = first[own], last[own], row[own]
    anchor = (least[first] & ~UPPER).astype(np.int64)
    return first, last, anchor, mixed(sums[anchor]), row


def _anchors(buckets: int, length: int, kmer: int):
    """(block, text) to the anchors by bucket: hash, block of documents, and whether it was met twice there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block_of, parts = batch.column(0).to_numpy(zero_copy_only=False), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for first, _, data, offsets in pieces(batch.column(1), PIECE):
                *_, h, row = snippets(data, offsets, length, kmer)
                parts.append((h, block_of[row + first]))
            h, block = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((block, h))
            h, block = h[order], block[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (block[1:] != block[:-1])])) if len(h) else np.zeros(0, np.int64)
            twice = np.diff(new, append=len(h)) > 1
            h, block = h[new], block[new].astype(np.int32)
            to = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            start = np.flatnonzero(np.diff(to, prepend=-1))
            cut = list(zip(start.tolist(), [*start[1:].tolist(), len(to)], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(to[start], pa.int32()), *(pa.array([x[s:e].tobytes() for s, e in cut], pa.binary()) for x in (h, block, twice))], ["bucket", "hashes", "blocks", "twice"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """A bucket's anchors to the blocks of documents, with those that occur more than once."""
    h, block, twice = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("blocks", np.int32), ("twice", bool)))
    order = np.argsort(h)
    h, block, twice = h[order], block[order], twice[order]
    same = np.concatenate([[False], h[1:] == h[:-1], [False]]) if len(h) else np.zeros(1, bool)
    some = same[:-1] | same[1:] | twice if len(h) else np.zeros(0, bool)
    h, block = h[some], block[some]
    order = np.argsort(block, kind="stable")
    h, block = h[order], block[order]
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    cut = zip(start.tolist(), [*start[1:].tolist(), len(block)], strict=False)
    return pa.table({"of": block[start].astype(np.int32), "hashes": pa.array([h[s:e].tobytes() for s, e in cut], pa.binary())})


class _Out:
    """Rows of FOUND: covered stretches, merged where they touch, and first snippets."""

    def __init__(self):
        self.covered: list[tuple[int, int, int]] = []
        self.first: dict[tuple[int, int, bytes], tuple[int, int]] = {}

    def add(self, route: int, rel: int, snippet: bytes, doc: int, start: int) -> None:
        """Keep a snippet's first place; the other one is covered."""
        key, place = (route, rel, snippet), (doc, start)
        known = self.first.get(key)
        if known is None:
            self.first[key] = place
        elif place < known:
            self.first[key] = place
            self.covered.append((known[0], known[1], known[1] + len(snippet)))
        elif place > known:
            self.covered.append((doc, start, start + len(snippet)))

    def table(self) -> pa.Table:
        merged: list[list[int]] = []
        for d, s, e in sorted(self.covered):
            if merged and merged[-1][0] == d and s <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([d, s, e])
        rows = list(self.first.items())
        none = [None] * len(merged)
        return pa.table(
            {
                "doc_id": pa.array([m[0] for m in merged] + [p[0] for _, p in rows], pa.int64()),
                "start": pa.array([m[1] for m in merged] + [p[1] for _, p in rows], pa.int64()),
                "end": pa.array([m[2] for m in merged] + [p[1] + len(k[2]) for k, p in rows], pa.int64()),
                "route": pa.array(none + [k[0] for k, _ in rows], pa.int64()),
                "rel": pa.array(none + [k[1] for k, _ in rows], pa.int32()),
                "snippet": pa.array(none + [k[2] for k, _ in rows], pa.binary()),
            }
        )


def _snippets(length: int, kmer: int):
    """A block of (block, doc_id, text) and its repeated anchors to FOUND."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        wanted = np.unique(np.frombuffer(b"".join(replies.column("hashes").to_pylist()), np.uint64))
        ids, out = docs.column("doc_id").to_pylist(), _Out()
        for begin, _, data, offsets in pieces(docs.column("text"), PIECE):
            raw = data.tobytes()
            first, last, anchor, h, row = snippets(data, offsets, length, kmer)
            # An anchor that occurs twice does so wherever it stands.
            some = np.isin(h, wanted)
            start = first - offsets[row]
            for a, b, p, key, r, at in zip(*(x[some].tolist() for x in (first, last, anchor, h.view(np.int64), row, start)), strict=True):
                out.add(key, p - a, raw[a : b + length], ids[begin + r], at)
        return out.table()

    return run


def _windows(length: int):
    """Snippets of heavy anchors to their windows, each dealt by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Out()
            for r in batch.to_pylist():
                data = np.frombuffer(r["snippet"], np.uint8)
                at = np.arange(len(data) - length + 1)
                for k, route in zip(at.tolist(), run_hash(prefix_sums(data), at, at + length).view(np.int64).tolist(), strict=True):
                    out.add(route, r["rel"] - k, r["snippet"][k : k + length], r["doc_id"], r["start"] + k)
            yield from out.table().to_batches()

    return run


def _distinct(batches: Iterator[pa.RecordBatch], covered: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bytes, int, int]]:
    """The first of equal rows (route, rel, snippet) of a sorted partition; the stretches of the others are added to ``covered``."""
    last = None
    for batch in batches:
        for route, rel, snippet, doc, start in zip(*(batch.column(c).to_pylist() for c in ("route", "rel", "snippet", "doc_id", "start")), strict=True):
            if last == (route, rel, snippet):
                covered.append((doc, start, start + len(snippet)))
            else:
                last = (route, rel, snippet)
                yield route, rel, snippet, doc, start


def _cut(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "route": pa.int64(), "rel": pa.int32(), "snippet": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, types[n]) for x, n in zip(columns, names, strict=True)], names)


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of FOUND to the first of equal snippets, and the stretches of the others."""
    covered, rows = [], []
    for route, rel, snippet, doc, start in _distinct(batches, covered):
        rows.append((doc, start, start + len(snippet), route, rel, snippet))
        if len(rows) + len(covered) >= ROWS:
            yield _cut([*rows, *((*c, None, None, None) for c in covered)], list(FOUND_COLUMNS))
            rows.clear()
            covered.clear()
    yield _cut([*rows, *((*c, None, None, None) for c in covered)], list(FOUND_COLUMNS))


class _Text:
    """Snippets one after another in a file, as symbols from 2, with a 1 behind each, and where each stands."""

    def __init__(self):
        self.text, self.base, self.size, self.doc, self.start = (Spool(t) for t in (np.uint16, np.int64, np.int64, np.int64, np.int64))
        self.counts, self.rows = np.zeros(258, np.int64), []

    def add(self, snippet: bytes, doc: int, start: int) -> None:
        self.rows.append((snippet, doc, start))
        if len(self.rows) >= ROWS:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            snippet, doc, start = zip(*self.rows, strict=True)
            self.rows = []
            size = np.array([len(x) for x in snippet])
            base = np.cumsum(size + 1) - size - 1
            symbols = np.ones(int((size + 1).sum()), np.uint16)
            inside = np.ones(len(symbols), bool)
            inside[base + size] = False
            symbols[inside] = np.frombuffer(b"".join(snippet), np.uint8).astype(np.uint16) + 2
            self.base.append(base + self.text.n)
            self._symbols(symbols)
            for spool, x in ((self.size, size), (self.doc, doc), (self.start, start)):
                spool.append(np.array(x, np.int64))

    def _symbols(self, symbols: np.ndarray) -> None:
        self.text.append(symbols)
        self.counts += np.bincount(symbols, minlength=258)

    def sorted(self, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._symbols(np.zeros(1, np.uint16))
        return suffixes(self.text.mapped(), np.cumsum(self.counts) - self.counts, memory)


def _shard(length: int, memory: int):
    """A shard's sorted first snippets to the stretches covered by what starts earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, covered, held, texts = ["doc_id", "start", "end"], [], None, _Text()
        for route, _, snippet, doc, start in _distinct(batches, covered):
            # An anchor with one snippet repeats nothing.
            if held and held[0] == route:
                if held[1]:
                    texts.add(*held[1])
                texts.add(snippet, doc, start)
                held = (route, None)
            else:
                held = (route, (snippet, doc, start))
            if len(covered) >= ROWS:
                yield _cut(covered, names)
                covered.clear()
        yield _cut(covered, names)
        texts.flush()
        if not texts.base.n:
            return
        base, size, of, at = (x.mapped() for x in (texts.base, texts.size, texts.doc, texts.start))
        later, carried, best = blank((texts.text.n,)), CAP, np.zeros(0, np.int64)
        for place, share in texts.sorted(memory):
            place = np.minimum(place, len(later) - 1)
            owner = np.searchsorted(base, place, "right") - 1
            window = place - base[owner] <= size[owner] - length
            share, carried = least_between(share, window, carried)
            if not len(share):
                continue
            # The best of the group that may go on, then this batch's; suffixes that share LENGTH symbols are equal windows.
            group = np.concatenate([np.zeros(len(best), np.int64), np.cumsum(share < length)])
            place = np.concatenate([best, place[window]])
            owner = np.searchsorted(base, place, "right") - 1
            by = np.lexsort((at[owner] + place - base[owner], of[owner], group))
            first = np.concatenate([[True], group[by[1:]] != group[by[:-1]]])
            later[place[by[~first]]] = 1
            best = place[by[np.flatnonzero(first)[-1:]]]
        for s in range(0, len(later), PIECE):
            place = s + np.flatnonzero(later[s : s + PIECE])
            if len(place):
                cut = np.flatnonzero(np.diff(place, prepend=-2) != 1)
                end = place[np.append(cut[1:], len(place)) - 1] + length
                place = place[cut]
                owner = np.searchsorted(base, place, "right") - 1
                shift = at[owner] - base[owner]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of[owner], place + shift, end + shift)], names)

    return run


def _kept():
    @F.arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>")
    def kept(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        data, offsets = bytes_of(text)
        n, removed, spans, left = np.diff(offsets), [], [], []
        for k, (s, e) in enumerate(zip(starts.to_pylist(), ends.to_pylist(), strict=True)):
            own = data[offsets[k] : offsets[k + 1]]
            gone, runs = 0, 0
            if s:
                step = np.zeros(len(own) + 1, np.int64)
                np.add.at(step, s, 1)
                np.add.at(step, e, -1)
                lost = np.cumsum(step)[:-1] > 0
                gone, runs = int(lost.sum()), int((lost & ~np.concatenate([[False], lost[:-1]])).sum())
                own = own[~lost]
            removed.append(gone)
            spans.append(runs)
            left.append(own.tobytes())
        return pa.StructArray.from_arrays([pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])

    return kept


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, kmer: int = KMER, heavy: int = HEAVY, memory: int = MEMORY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left).

    A string starts earlier if its document has a smaller id, or in the same
    document if its place is. Matches do not cross documents. A null text is
    empty. Rows without an id take no part and lose nothing. Rows that repeat
    an id with different texts are documents of their own, the one with the
    smaller hash of its text being the earlier; rows alike in id and text are
    one document, and lose the same bytes. Texts of any length are read whole.
    An empty table gives an empty result. Other columns, whatever their names, are
    not read. A shard's sorter holds about ``memory`` bytes; ``length`` is CAP at most.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    if texts.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = _removed(texts.withColumn("row", F.col("doc_id")), length, kmer, heavy, memory)
    else:
        # Numbers in the order of the ids, and of 128 bits of the text within an id.
        key = ["doc_id", "t1", "t2"]
        named = texts.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
        numbers = named.filter("doc_id is not null").select(*key).distinct().orderBy(*key).select(*(F.col(c).alias(f"of_{c}") for c in key), F.monotonically_increasing_id().alias("row"))
        numbers = written(numbers, "row-numbers")
        out = _removed(named.join(numbers, [F.col(c) == F.col(f"of_{c}") for c in key], "left").select("doc_id", "row", "text"), length, kmer, heavy, memory, one_each=True)
    return out


def _removed(texts: DataFrame, length: int, kmer: int, heavy: int, memory: int, one_each: bool = False) -> DataFrame:
    """:func:`repeats_removed` of (doc_id, row, text); rows with one number hold one text, and those without take no part."""
    whole, texts = texts, texts.filter("row is not null").select(F.col("row").alias("doc_id"), "text")
    texts = texts.dropDuplicates(["doc_id"]) if one_each else texts
    # Anchors are about two in every length - kmer + 2 bytes.
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(2 * size / (length - kmer + 2) / BUCKET_ANCHORS))
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    # The length is part of the hash, so that rows that repeat an id are spread too.
    named = texts.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    anchors = named.select("block", "text").mapInArrow(_anchors(buckets, length, kmer), "bucket int, hashes binary, blocks binary, twice binary")
    wanted = anchors.groupBy("bucket").applyInArrow(_repeated, "of int, hashes binary")
    found = written(named.groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(_snippets(length, kmer), FOUND), "snippets")

    first = found.filter("snippet is not null")
    covered = found.filter("snippet is null").select("doc_id", "start", "end")
    key = ["route", "rel", "snippet", "doc_id", "start"]
    many = _heavy(first, heavy)
    if not many.isEmpty():
        salted = first.join(many, F.col("route") == F.col("many"), "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        fewer = written(salted.repartition("route", "salt").sortWithinPartitions(*key).select(*FOUND_COLUMNS).mapInArrow(_reduced, FOUND), "heavy-snippets")
        covered = covered.unionByName(fewer.filter("snippet is null").select("doc_id", "start", "end"))
        first, fewer = first.join(many, F.col("route") == F.col("many"), "left_anti"), fewer.filter("snippet is not null")
        many = _heavy(fewer, heavy)
        if not many.isEmpty():
            apart = written(fewer.join(many, F.col("route") == F.col("many"), "left_semi").select(*FOUND_COLUMNS).mapInArrow(_windows(length), FOUND), "heavy-windows")
            covered = covered.unionByName(apart.filter("snippet is null").select("doc_id", "start", "end"))
            fewer = fewer.join(many, F.col("route") == F.col("many"), "left_anti").unionByName(apart.filter("snippet is not null"))
        first = first.unionByName(fewer)
    total = first.agg(F.coalesce(F.sum(F.octet_length("snippet")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / SHARD_BYTES))
    dealt = first.select(*key).repartition(shards, "route").sortWithinPartitions(*key)
    later = dealt.mapInArrow(_shard(length, memory), "doc_id long, start long, end long")
    stretches = covered.unionByName(later).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    both = whole.join(stretches, F.col("row") == F.col("of"), "left")
    return both.select("doc_id", _kept()("text", "gone.start", "gone.end").alias("x")).select("doc_id", "x.n_bytes", "x.n_removed", "x.n_spans", "x.kept")


def _heavy(first: DataFrame, heavy: int) -> DataFrame:
    return written(first.groupBy("route").count().filter(F.col("count") > heavy).select(F.col("route").alias("many")), "heavy-anchors")


FOUND_COLUMNS = ("doc_id", "start", "end", "route", "rel", "snippet")
