"""Suffixes in order, with the symbols that neighbours share, by induction over files.

A suffix that begins a rise (a seed) is sorted by its substring up to the next
seed; the substrings are named in order, and the names sorted as a text of
their own, by the same means, until every name occurs once. Up to DIRECT
seeds are named and sorted in memory. All other suffixes
are induced from the seeds: ascending those that fall, then descending those
that rise. A priority queue holds (symbol, rank of the suffix that induced it,
place), spilled as sorted runs and read by ranges of symbols.

Common prefixes go along. Two suffixes that follow each other in a bucket
share one symbol more than the two that induced them, and these share the
least prefix between their ranks: a table of least values over runs of 2^k
ranks. Where falling and rising suffixes meet in a bucket, their runs of its
symbol are read. Between seeds, shared names give the length that is known,
and the rest is read. Prefixes count up to CAP; so does the order.

Text, names, lists and table lie in files of the task's own, mapped where they
are read by place. What is held in memory is bounded by ``memory`` bytes and
DIRECT names at any length of text.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

CAP, MEMORY, TUPLE, BLOCK, DIRECT = 254, 1 << 23, 128, 16, 1 << 20
NONE = np.zeros((0, 3), np.int64)


def scratch_folder() -> str | None:
    """Where a task of Spark spills; the system's temporary folder outside of one."""
    own = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return own if own and os.path.isdir(own) else None


class Spool:
    """A list of numbers in a file, added to at its end."""

    def __init__(self, dtype: type):
        self.file, self.dtype, self.n = tempfile.TemporaryFile(dir=scratch_folder()), np.dtype(dtype), 0

    def append(self, x: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(x, self.dtype).data)
        self.n += len(x)

    def read(self, start: int, end: int) -> np.ndarray:
        self.file.seek(start * self.dtype.itemsize)
        out = np.frombuffer(self.file.read((end - start) * self.dtype.itemsize), self.dtype)
        self.file.seek(0, 2)
        return out

    def mapped(self) -> np.ndarray:
        self.file.flush()
        return np.asarray(np.memmap(self.file, self.dtype, "r", shape=(self.n,))) if self.n else np.zeros(0, self.dtype)


def blank(shape: tuple[int, ...]) -> np.ndarray:
    """Bytes of zero in a file."""
    file = tempfile.TemporaryFile(dir=scratch_folder())
    file.truncate(max(1, int(np.prod(shape))))
    return np.asarray(np.memmap(file, np.uint8, "r+", shape=shape)) if np.prod(shape) else np.zeros(shape, np.uint8)


class Queue:
    """A priority queue of (key, rank, place) on disk; equal keys come in the order they were put in.

    Rows that do not fit in memory are spilled as sorted runs, of which the
    first key, the offset and the length are kept. ``first`` holds the first key
    of each range of keys; the rows of one range are read at a time. A range
    of one key may be of any size, for its rows are taken run by run; another
    holds no more than fit in memory. Keys never fall below the open range.
    """

    def __init__(self, first: np.ndarray, single: np.ndarray, memory: int):
        self.first, self.single, self.room = first, single, max(16, memory // TUPLE)
        self.end = np.append(first[1:], np.iinfo(np.int64).max)
        self.file, self.written, self.runs = tempfile.TemporaryFile(dir=scratch_folder(), buffering=0), 0, NONE
        self.waiting, self.held, self.spilled = [], 0, 0
        self.now, self.whole, self.cur, self.late = -1, False, NONE, NONE

    def push(self, key: np.ndarray, rank: np.ndarray, place: np.ndarray) -> None:
        rows = np.stack([key, rank, place], 1).astype(np.int64)
        if self.whole:
            here = rows[:, 0] < self.end[self.now]
            if here.any():
                self.late = np.concatenate([self.late, rows[here]])
                if not self.single[self.now]:
                    self.late = self.late[np.argsort(self.late[:, 0], kind="stable")]
                    if len(self.late) > 4096:
                        self.cur, self.late = np.concatenate([self.cur, self.late]), NONE
                        self.cur = self.cur[np.argsort(self.cur[:, 0], kind="stable")]
                rows = rows[~here]
        if len(rows):
            self.waiting.append(rows)
            self.held += len(rows)
        if self.held > self.room:
            rows = np.concatenate(self.waiting)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            self.file.seek(self.written)
            self.file.write(rows.astype(np.uint32).data)
            self.runs = np.concatenate([self.runs[self.runs[:, 2] > 0], [[rows[0, 0], self.written, len(rows)]]])
            self.written += 12 * len(rows)
            self.spilled += len(rows)
            self.waiting, self.held = [], 0

    def _of_run(self, k: int, most: int) -> list[np.ndarray]:
        """The open range's rows of a run, up to ``most``."""
        _, offset, left = self.runs[k].tolist()
        out, size = [], 32
        while most and left:
            n = min(left, size, most)
            rows = np.frombuffer(os.pread(self.file.fileno(), 12 * min(n + 1, left), offset), np.uint32).reshape(-1, 3).astype(np.int64)
            m = min(n, int(np.searchsorted(rows[:, 0], self.end[self.now])))
            out.append(rows[:m])
            offset, left, most, size = offset + 12 * m, left - m, most - m, 4 * size
            if left:
                self.runs[k, 0] = rows[m, 0]
            if m < n:
                break
        self.runs[k, 1:] = offset, left
        return out

    def _next(self, most: int | None) -> np.ndarray:
        """The rows that wait for the open range; those of its first run where their number is limited."""
        runs = np.flatnonzero((self.runs[:, 0] < self.end[self.now]) & (self.runs[:, 2] > 0)).tolist()
        if most and runs:
            return np.concatenate(self._of_run(runs[0], most))
        parts = [x for k in runs for x in self._of_run(k, int(self.runs[k, 2]))]
        if self.held:
            rows = np.concatenate(self.waiting)
            here = rows[:, 0] < self.end[self.now]
            parts.append(rows[here])
            self.waiting = [rows[~here]]
            self.held = len(self.waiting[0])
        return np.concatenate([NONE, *parts])

    def ahead(self) -> int | None:
        """The next range that holds rows."""
        runs = self.runs[self.runs[:, 2] > 0, 0]
        keys = [int(x.min()) for x in (runs, *(w[:, 0] for w in self.waiting)) if len(x)]
        return int(np.searchsorted(self.first, min(keys), "right")) - 1 if keys else None

    def open(self, r: int) -> None:
        self.now, self.whole, self.late, self.cur = r, False, NONE, NONE
        if not self.single[r]:
            cur = self._next(None)
            self.cur, self.whole = cur[np.argsort(cur[:, 0], kind="stable")], True

    def peek(self, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The first rows of the open range, and of those that came since all of it was read."""
        while not self.whole and len(self.cur) < want:
            part = self._next(self.room)
            self.whole = not len(part)
            self.cur = np.concatenate([self.cur, part])
        return self.cur[:want], self.late[:want]

    def take(self, cur: int, late: int) -> None:
        self.cur, self.late = self.cur[cur:], self.late[late:]

    def drain(self) -> Iterator[np.ndarray]:
        """All rows in order."""
        while (r := self.ahead()) is not None:
            self.open(r)
            while len(rows := self.peek(self.room)[0]):
                yield rows
                self.take(len(rows), 0)


class Listed:
    """Sorted suffixes in files, read from either end: symbol, place, and what each shares with the one read before."""

    def __init__(self, place: Spool, shared: Spool, backwards: bool, room: int):
        self.place, self.shared, self.backwards, self.room, self.at = place, shared, backwards, room, 0
        self.rows = (np.zeros(0, np.int64),) * 2

    def _read(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.place.n
        if not self.backwards:
            return self.place.read(s, e).astype(np.int64), self.shared.read(s, e).astype(np.int64)
        shared = self.shared.read(n - e + 1, min(n, n - s + 1))[::-1].astype(np.int64)
        return self.place.read(n - e, n - s)[::-1].astype(np.int64), shared if s else np.concatenate([[0], shared])

    def peek(self, want: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows[0]) < want and self.at < self.place.n:
            end = min(self.place.n, self.at + max(want, self.room))
            more = self._read(self.at, end)
            self.rows, self.at = tuple(np.concatenate(x) for x in zip(self.rows, more, strict=True)), end
        return tuple(x[:want] for x in self.rows)

    def take(self, n: int) -> None:
        self.rows = tuple(x[n:] for x in self.rows)

    def all(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while len((rows := self.peek(self.room))[0]):
            yield rows
            self.take(len(rows[0]))


class Least:
    """Least values over any run of a list that grows.

    For each place the least value of its BLOCK up to it and from it on, and a
    table of the least of 2^k blocks.
    """

    def __init__(self, most: int):
        blocks = most // BLOCK + 1
        self.values, self.upto, self.onward = (blank((blocks * BLOCK,)) for _ in range(3))
        self.levels, self.n = blank((blocks.bit_length(), blocks)), 0

    def append(self, x: np.ndarray) -> None:
        begin, self.n = self.n // BLOCK, self.n + len(x)
        self.values[self.n - len(x) : self.n] = x
        end = self.n // BLOCK
        part = self.values[end * BLOCK : self.n]
        self.upto[end * BLOCK : self.n] = np.minimum.accumulate(part)
        if end > begin:
            here = slice(begin * BLOCK, end * BLOCK)
            full = self.values[here].reshape(-1, BLOCK)
            self.upto[here] = np.minimum.accumulate(full, 1).ravel()
            self.onward[here] = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
            self.levels[0, begin:end] = full.min(1)
            for k in range(1, end.bit_length()):
                s, e, half = max(0, begin - (1 << k) + 1), end - (1 << k) + 1, 1 << (k - 1)
                below = self.levels[k - 1]
                np.minimum(below[s:e], below[s + half : e + half], out=self.levels[k, s:e])

    def between(self, after: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The least of after + 1 .. to."""
        after = after + 1
        first, last = after // BLOCK, to // BLOCK
        out = np.minimum(self.onward[after], self.upto[to]).astype(np.int64)
        some = np.flatnonzero(last - first > 1)
        if len(some):
            s, n = first[some] + 1, last[some] - first[some] - 1
            k = np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1
            out[some] = np.minimum(out[some], np.minimum(self.levels[k, s], self.levels[k, s + n - (1 << k)]))
        some = np.flatnonzero(first == last)
        at, end = after[some], to[some]
        out[some] = self.values[at]
        while len(some):
            at += 1
            left = at <= end
            some, at, end = some[left], at[left], end[left]
            out[some] = np.minimum(out[some], self.values[at])
        return out


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share, ``known`` of which are certain."""
    out = np.minimum(known, CAP)
    left = np.flatnonzero(out < CAP)
    while len(left):
        left = left[text[a[left] + out[left]] == text[b[left] + out[left]]]
        out[left] += 1
        left = left[out[left] < CAP]
    return out


def induced(text: np.ndarray, given: Listed, first: np.ndarray, single: np.ndarray, top: int | None, memory: int, every: bool) -> tuple[Spool, Spool]:
    """The induced suffixes (with ``every``, the given ones too) in the order they leave the queue, and what each shares with the one before.

    ``top`` is the largest symbol if symbols count downwards from it, else None.
    """
    queue, least = Queue(first, single, memory), Least(len(text))
    places, shares = Spool(np.uint32), Spool(np.uint8)
    symbol = (lambda at: text[at].astype(np.int64)) if top is None else (lambda at: top - text[at].astype(np.int64))
    end = np.append(first[1:], np.iinfo(np.int64).max)
    want, last = 256, (-1, False, 0, 0)  # symbol, from the queue, rank, place
    while True:
        g_place, g_share = given.peek(want)
        g_symbol = symbol(g_place)
        if queue.now >= 0:
            cur, late = queue.peek(want)
            inside = int(np.searchsorted(g_symbol, end[queue.now]))
        if queue.now < 0 or not (len(cur) or len(late) or inside):
            to = [r for r in (queue.ahead(), int(np.searchsorted(first, g_symbol[0], "right")) - 1 if len(g_symbol) else None) if r is not None]
            if not to:
                return places, shares
            queue.open(min(to))
            continue
        kind = np.repeat([0, 1, 2], [len(cur), len(late), inside])
        key = np.concatenate([cur[:, 0], late[:, 0], g_symbol[:inside]])
        rank = np.concatenate([cur[:, 1], late[:, 1], g_share[:inside]])
        place = np.concatenate([cur[:, 2], late[:, 2], g_place[:inside]])
        order = np.argsort(2 * key + (kind == 2), kind="stable")[:want]
        kind, key, rank, place = kind[order], key[order], rank[order], place[order]
        own = kind < 2
        before = symbol(np.maximum(place - 1, 0))
        induces = (place > 0) & ((before > key) | ((before == key) & own))
        # What these induce comes after all that are taken: the run ends before a suffix that belongs behind one of its own.
        low = np.minimum.accumulate(np.where(induces, before, np.iinfo(np.int64).max >> 1))
        behind = np.flatnonzero(2 * key[1:] + ~own[1:] > 2 * low[:-1])
        n = int(behind[0]) + 1 if len(behind) else len(key)
        want = min(2 * want, queue.room) if n == len(key) else max(64, 2 * n)
        kind, key, rank, place, own, before, induces = (x[:n] for x in (kind, key, rank, place, own, before, induces))
        queue.take(int((kind == 0).sum()), int((kind == 1).sum()))
        given.take(int((kind == 2).sum()))

        key_0, own_0, rank_0, place_0 = (np.concatenate([[v], x[:-1]]) for v, x in zip(last, (key, own, rank, place), strict=True))
        share = np.zeros(n, np.int64)
        same = key == key_0
        both = same & own & own_0
        if both.any():
            share[both] = 1 + least.between(rank_0[both], rank[both])
        both = same & ~own & ~own_0
        share[both] = rank[both]
        seam = np.flatnonzero(same & ~own & own_0)
        if len(seam):
            share[seam] = common(text, place[seam], place_0[seam], np.ones(len(seam), np.int64))
        share = np.minimum(share, CAP)
        last = (int(key[-1]), bool(own[-1]), int(rank[-1]), int(place[-1]))
        now = least.n
        least.append(share)
        keep = slice(None) if every else own
        places.append(place[keep])
        shares.append(share[keep])
        queue.push(before[induces], now + np.flatnonzero(induces), place[induces] - 1)


def both_ways(text: np.ndarray, seeds: Listed, first: np.ndarray, single: np.ndarray, top: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in order from the order of the seeds, with what each shares with the one before."""
    room = max(16, memory // TUPLE)
    falls = induced(text, seeds, first, single, None, memory, every=False)
    last = np.append(first[1:] - 1, top)
    order = induced(text, Listed(*falls, True, room), (top - last)[::-1], single[::-1], top, memory, every=True)
    del falls
    yield np.array([len(text) - 1]), np.zeros(1, np.int64)
    yield from Listed(*order, True, room).all()


def least_between(shares: np.ndarray, keep: np.ndarray, carried: int) -> tuple[np.ndarray, int]:
    """What the kept suffixes share with the kept one before, and what the next one has of that so far."""
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros(0, np.int64), min(carried, int(shares.min(initial=CAP)))
    out = np.minimum.reduceat(shares[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
    out[0] = min(int(out[0]), carried)
    return out, int(shares[at[-1] + 1 :].min(initial=CAP))


def ranges(starts: np.ndarray, total: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of symbols that hold ``room`` suffixes at most, or one symbol; symbol k's suffixes begin at ``starts[k]``."""
    first, single, at = [], [], 0
    while at < len(starts):
        begin = int(starts[at])
        to = len(starts) if total - begin <= room else max(at + 1, int(np.searchsorted(starts, np.array(begin + room, starts.dtype), "right")) - 1)
        first.append(at)
        single.append(to == at + 1)
        at = to
    return np.array(first, np.int64), np.array(single)


def doubled(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`suffixes` of a text that fits in memory, by doubling."""
    name, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while step < CAP and name.max() + 1 < len(name):
        after = np.append(name[step:] + 1, np.zeros(min(step, len(name)), np.int64))
        name = np.unique(name * (len(name) + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.argsort(name, kind="stable")
    return order, np.concatenate([[0], common(text, order[1:], order[:-1], np.zeros(len(order) - 1, np.int64))])


def names_of(text: np.ndarray, at: np.ndarray, size: np.ndarray, top: int) -> np.ndarray:
    """Numbers of the substrings at ``at``, in their order; where one ends, it is above those that go on, since they fall there."""
    bits = (top + 1).bit_length()
    each, name, left, done = 63 // bits, np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(left):
        key = np.zeros(len(left), np.int64)
        for k in range(done, done + each):
            inside = k < size[left]
            key = (key << bits) | np.where(inside, text[np.minimum(at[left] + k, len(text) - 1)].astype(np.int64), (1 << bits) - 1)
        done += each
        order = np.lexsort((key, name[left]))
        left, key = left[order], key[order]
        group = name[left]
        outer = np.concatenate([[True], group[1:] != group[:-1]])
        inner = outer | np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(left))
        start = np.maximum.accumulate(np.where(inner, place, 0))
        name[left] = group + start - np.maximum.accumulate(np.where(outer, place, 0))
        many = ~inner | np.append(~inner[1:], False)
        left = left[many & (size[left] > done)]
    return np.unique(name, return_inverse=True)[1].astype(np.int64)


def suffixes(text: np.ndarray, starts: np.ndarray, memory: int = MEMORY, direct: int = DIRECT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (place, symbols shared with the suffix before, up to CAP), in order.

    ``text`` is an array, best a mapped one, of less than 2^32 symbols, whose last is its only 0;
    ``starts[k]`` is the number of symbols less than k.
    """
    n, room, top = len(text), max(16, memory // TUPLE), len(starts) - 1
    first, single = ranges(starts, n, room)
    # Seeds from the end of the text: where it falls to a symbol from which it rises.
    seed, span, follows, rises = Spool(np.uint32), blank((n,)), n - 1, True
    by_symbol = Queue(first, single, memory)
    for e in range(n, 0, -room):
        s = max(0, e - room)
        part = text[s : min(n, e + 1)].astype(np.int64)
        step = np.sign(np.diff(part)) if e < n else np.append(np.sign(np.diff(part)), 1)
        if step[-1] == 0:
            step[-1] = 1 if rises else -1
        change = np.flatnonzero(step)
        up = step[change[np.searchsorted(change, np.arange(len(step)))]] > 0
        rises = bool(up[0])
        fell = np.concatenate([[s > 0 and text[s - 1] > text[s]], part[1 : len(step)] < part[: len(step) - 1]])
        at = s + np.flatnonzero(up & fell)
        span[at] = np.minimum(np.append(at[1:], follows) - at + 1, CAP + 1)
        if len(at):
            follows = int(at[0])
            seed.append(at[::-1])
            by_symbol.push(text[at].astype(np.int64), np.zeros(len(at), np.int64), at)
    if n == 1:
        span[0] = 1
        seed.append(np.zeros(1, np.int64))
        by_symbol.push(*np.zeros((3, 1), np.int64))
    n_seeds, seed_at = seed.n, seed.mapped()
    if n_seeds <= direct:
        at = seed_at[::-1].astype(np.int64)
        number, many = doubled(names_of(text, at, span[at].astype(np.int64), top))
        cuts = range(0, n_seeds, room)
        yield from _from_seeds(text, ((at[number[k : k + room]], many[k : k + room], number[k : k + room]) for k in cuts), seed_at, first, single, top, memory)
        return
    places, shares, before = Spool(np.uint32), Spool(np.uint8), -1
    for rows in by_symbol.drain():
        places.append(rows[:, 2])
        shares.append(np.diff(rows[:, 0], prepend=before) == 0)
        before = int(rows[-1, 0])
    del by_symbol

    # Names of the seeds' substrings, in order; then back to the order of the text.
    by_place = Queue(np.arange(0, n, room), np.full(-(-n // room), room == 1), memory)
    sorted_seeds, begins, name, length, carried, seen = Spool(np.uint32), Spool(np.uint32), -1, 0, CAP, 0
    for place, share in both_ways(text, Listed(places, shares, False, room), first, single, top, memory):
        is_seed = span[place] > 0
        share, carried = least_between(share, is_seed, carried)
        place = place[is_seed]
        if not len(place):
            continue
        size = span[place].astype(np.int64)
        new = (size != np.concatenate([[length], size[:-1]])) | (share < size)
        names = name + np.cumsum(new)
        name, length = int(names[-1]), int(size[-1])
        begins.append(seen + np.flatnonzero(new))
        seen += len(place)
        sorted_seeds.append(place)
        by_place.push(place, names, place)
    if name + 1 == n_seeds:
        batches = ((x, np.zeros(len(x), np.int64), None) for x, _ in Listed(sorted_seeds, sorted_seeds, False, room).all())
    else:
        upper = Spool(np.uint32)
        for rows in by_place.drain():
            upper.append(rows[:, 1])
        del by_place
        batches = ((seed_at[n_seeds - 1 - number].astype(np.int64), many, number) for number, many in suffixes(upper.mapped(), begins.mapped(), memory, direct))
    yield from _from_seeds(text, batches, seed_at, first, single, top, memory)


def _from_seeds(text: np.ndarray, batches: Iterator[tuple], seed_at: np.ndarray, first: np.ndarray, single: np.ndarray, top: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`suffixes` from batches of sorted seeds: place, names shared with the one before, number in the text (None: no name is shared)."""
    places, shares, before, n_seeds = Spool(np.uint32), Spool(np.uint8), len(text) - 1, len(seed_at)
    for place, many, number in batches:
        known = np.zeros(len(place), np.int64)
        if number is not None:
            known = seed_at[n_seeds - 1 - np.minimum(number + many, n_seeds - 1)].astype(np.int64) - place
        other = np.concatenate([[before], place[:-1]])
        differ = np.flatnonzero(other != place)
        share = np.zeros(len(place), np.int64)
        share[differ] = common(text, place[differ], other[differ], known[differ])
        places.append(place)
        shares.append(share)
        before = int(place[-1])
    yield from both_ways(text, Listed(places, shares, False, max(16, memory // TUPLE)), first, single, top, memory)
