"""URL filters by cascades of Bloom filters: exact membership in lists, without joins when pages are judged.

The keys of a page are its host and the hosts above it, each with the listed
lengths of its path's beginning. A cascade's first filter holds a list's keys,
its second those keys of the corpus that the first takes in wrongly, its third
the listed keys that the second takes in, and so on until a filter takes in
nothing wrongly. All keys of the corpus were tried, so for each of them the
first filter that refuses it tells whether it is listed.

Building reads the corpus's keys once; only those that the first filters take
in are shuffled. Judging is a narrow pass over the pages.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .importance import LOWER, UPPER
from .store import dropped, sent, written
from .text import mixed

#: (verdict, host, beginning of the path), as the production query takes them.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Parts of host names, between points and hyphens, that put a host on the query's list.
BAD_PARTS = ("ads", "adult", "bets", "casino", "pills", "spam")
ALLOW, BLOCK, LISTED = 0, 1, 2
#: Bits of a piece in which a filter is put together; bytes of filters sent to all tasks at once; levels before giving up.
PIECE_BITS, MOST_BYTES, MOST_LEVELS = 1 << 19, 1 << 26, 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z in lower case and the path; both empty without a ``://`` or without a url."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


@dataclass
class Bloom:
    """``bits`` in bytes, ``size`` of them in use, ``hashes`` places for a key."""

    bits: np.ndarray
    size: int
    hashes: int

    def holds(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in places(a, b, level, self.size, self.hashes):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def places(a: np.ndarray, b: np.ndarray, level: int, size: int, hashes: int) -> list[np.ndarray]:
    """The bits of keys known by two 64-bit hashes; each level has its own."""
    with np.errstate(over="ignore"):
        start, step = mixed(a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)), mixed(b.astype(np.uint64) ^ np.uint64(level + 1)) | np.uint64(1)
        return [(start + np.uint64(k) * step) % np.uint64(size) for k in range(hashes)]


def shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and places of a filter for ``n`` keys that takes in a stranger at the given rate."""
    hashes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(n * hashes / math.log(2))), hashes


@dataclass
class Cascades:
    """By kind of list its filters, first level first; keys of other shards are strangers to all."""

    levels: dict[int, list[Bloom]] = field(default_factory=dict)
    shards: int = 1
    shard: int = 0

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bit ``kind`` of a number is set where the key is on that list."""
        out = np.zeros(len(a), np.int8)
        own = np.flatnonzero(shard_of(a, self.shards) == self.shard)
        for kind, levels in self.levels.items():
            live = own
            for level, bloom in enumerate(levels):
                hit = bloom.holds(a[live], b[live], level)
                if level % 2:
                    out[live[~hit]] |= 1 << kind
                live = live[hit]
            if len(levels) % 2:
                out[live] |= 1 << kind
        return out


def shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return mixed(a.astype(np.uint64)) % np.uint64(shards)


def _mask(get: Callable[[], object]) -> Callable[[Column, Column], Column]:
    """Arrays of hashes to an array of the kinds that hold each key."""

    @F.arrow_udf(T.ArrayType(T.ByteType()))
    def mask(a: pa.Array, b: pa.Array) -> pa.Array:
        filters = get()
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
        found = filters.holds(flat(a), flat(b)) if len(a) else np.zeros(0, np.int8)
        offsets = np.concatenate([[0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))

    return mask


@dataclass
class _Level:
    """One level's filters, for trying keys against it alone."""

    level: int
    blooms: dict[int, Bloom]
    shards: int
    shard: int

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int8)
        own = np.flatnonzero(shard_of(a, self.shards) == self.shard)
        for kind, bloom in self.blooms.items():
            out[own[bloom.holds(a[own], b[own], self.level)]] |= 1 << kind
        return out


def _places(level: int, shapes: dict[int, tuple[int, int]], shards: int, shard: int):
    """Keys of a shard to the bits they set: kind, piece of the filter, bit in the piece."""

    def run(batches):
        for batch in batches:
            kinds, a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            own = shard_of(a, shards) == shard
            for kind, (size, hashes) in shapes.items():
                of = own & (kinds == kind)
                if of.any():
                    at = np.unique(np.concatenate(places(a[of], b[of], level, size, hashes)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), kind, np.int32)), pa.array((at // PIECE_BITS).astype(np.int64)), pa.array((at % PIECE_BITS).astype(np.int32))], ["kind", "piece", "bit"]
                    )

    return run


def _pieces(table: pa.Table) -> pa.Table:
    bits = np.zeros(PIECE_BITS, bool)
    bits[table.column("bit").to_numpy()] = True
    return pa.table({"kind": table.column("kind").slice(0, 1), "piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def encoded(keys: DataFrame, level: int, rates: dict[int, float], shards: int, shard: int) -> dict[int, Bloom]:
    """A filter for the keys (kind, a, b) of each kind; what reaches the driver is the filters' bytes."""
    counts = {r.kind: r.n for r in keys.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # a row a kind
    shapes = {k: shape(-(-n // shards) if shards > 1 else n, rates[k]) for k, n in counts.items()}
    out = {k: Bloom(np.zeros(-(-size // PIECE_BITS) * PIECE_BITS // 8, np.uint8), size, hashes) for k, (size, hashes) in shapes.items()}
    if not out:
        return out
    bits = keys.select("kind", "a", "b").mapInArrow(_places(level, shapes, shards, shard), "kind int, piece long, bit int").distinct()
    for r in bits.groupBy("kind", "piece").applyInArrow(_pieces, "kind int, piece long, bits binary").collect():
        out[r.kind].bits[r.piece * PIECE_BITS // 8 : (r.piece + 1) * PIECE_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def build(listed: DataFrame, rows: DataFrame, n_keys: int, shards: int = 1, shard: int = 0) -> Cascades:
    """The cascades of ``listed`` (kind, key, a, b: distinct) over all keys of ``rows`` (arrays keys, a, b; ``n_keys`` of them at most).

    The first filter's rate makes its errors about as many as the listed keys;
    the later ones halve what is left.
    """
    spark = listed.sparkSession
    counts = {r.kind: r.n for r in listed.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    out = Cascades({k: [] for k in counts}, shards, shard)
    blooms = encoded(listed, 0, {k: min(0.5, n / (math.sqrt(2) * max(1, n_keys))) for k, n in counts.items()}, shards, shard)
    kinds_of = lambda mask: F.filter(F.array(*map(F.lit, sorted(counts) or [0])), lambda k: F.get(mask, F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0)
    inside, outside, level = listed, None, 0
    while blooms:
        for kind, bloom in blooms.items():
            out.levels[kind].append(bloom)
        tried = _mask(sent(spark, _Level(level, blooms, shards, shard)))
        if outside is None:
            took = rows.select(F.explode(F.arrays_zip("keys", "a", "b", tried(F.col("a"), F.col("b")).alias("mask"))).alias("x")).filter("x.mask > 0")
            took = took.select("x.keys", "x.a", "x.b", "x.mask").distinct()
            each = took.select(F.explode(kinds_of(F.array("mask"))).alias("kind"), F.col("keys").alias("key"), "a", "b")
            wrong = each.join(listed.select("kind", "key"), ["kind", "key"], "left_anti")
        else:
            mask = tried(F.array("a"), F.array("b"))
            wrong = outside.withColumn("mask", mask).filter(F.get("mask", F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("kind"))) != 0).select("kind", "key", "a", "b")
        wrong = written(wrong.select("kind", "key", "a", "b"), "taken-in")
        if outside is not None and outside is not listed:
            dropped(outside)
        inside, outside, level = wrong, inside, level + 1
        if level > MOST_LEVELS:
            raise ValueError("the cascade does not end: two keys have the same hashes")
        blooms = encoded(inside, level, dict.fromkeys(counts, 0.5), shards, shard)
    for left in (inside, outside):
        if left is not listed:
            dropped(left)
    return out


def estimated_bytes(listed: int, n_keys: int) -> float:
    """Of a cascade's filters: 1.44 bits for each halving of the first filter's rate, and under four for all later levels."""
    return listed * (1.44 * math.log2(max(2, math.sqrt(2) * n_keys / max(1, listed))) + 4) / 8


def keyed(pages: DataFrame, id_col: str, url_col: str, lengths: list[int], most_labels: int) -> DataFrame:
    """page_id, host, path, and the page's keys with their two hashes. Hosts above the longest listed one are enough."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    start = F.greatest(F.lit(1), F.size(labels) - most_labels + 1)
    hosts = F.transform(F.sequence(start, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    # A host of more labels than any listed one is no key, but those above it are.
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(fitting, lambda n: F.struct(h.alias("host"), F.concat(h, F.substr(F.col("path"), F.lit(1), n)).alias("key")))))
    rows = rows.withColumn("pairs", keys)
    hashed = lambda k: F.transform("pairs", lambda p: F.xxhash64(F.lit(k), p["key"]))
    return rows.select("page_id", "host", "path", "pairs", F.col("pairs.key").alias("keys"), hashed(1).alias("a"), hashed(2).alias("b"))


def hosts_with(pages: DataFrame, parts: tuple[str, ...] = BAD_PARTS, url_col: str = "url") -> DataFrame:
    """The distinct hosts of pages that have one of the parts between points and hyphens."""
    host, _ = host_and_path(F.col(url_col).cast("string"))
    own = pages.select(host.alias("host")).filter(F.arrays_overlap(F.split("host", r"[.-]"), F.array(*map(F.lit, parts))))
    return own.distinct()


def judged(
    pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", *,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (null: none fits), verdict, listed.

    ``rules`` are (allow or block, host, beginning of the path); ``listed`` is a
    table of hosts to block. Both hold for a host and all below it. Of the rules
    that fit, the one with the most code points of host and path together
    decides, then the one with the longer host, and of an allow and a block rule
    of the same key the block. Where no rule fits, a page of a listed host is
    blocked and any other allowed.

    If the filters would take more than ``most_bytes``, keys are dealt by hash
    to so many shards that a shard's filters take less, and the pages are
    judged against one shard after another, stored between.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is allowed. Hosts are taken as they stand, ports and users included.
    Urls of any length are read whole. Rows that repeat an id are judged each by
    its own url; a null id stays null. Null or empty listed hosts do not count.
    No pages: an empty result; no rules and no list: all pages are allowed.
    Other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    own = spark.createDataFrame([(BLOCK if v == "block" else ALLOW, h, p) for v, h, p in rules], "kind int, host string, path string")
    if listed is not None:
        host = F.col(listed.columns[0]).cast("string")
        own = own.unionByName(listed.select(F.lit(LISTED).alias("kind"), F.translate(host, UPPER, LOWER).alias("host"), F.lit("").alias("path")))
    own = own.filter("host <> ''").select("kind", "host", "path", F.concat("host", "path").alias("key")).distinct()
    own = written(own.select("*", F.xxhash64(F.lit(1), "key").alias("a"), F.xxhash64(F.lit(2), "key").alias("b")), "listed")
    facts = own.agg(F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.count("*").alias("n")).first()
    rows = keyed(pages, id_col, url_col, sorted(facts.lengths) or [0], facts.labels or 1)
    n_keys = max(1, pages.count() * (facts.labels or 1) * max(1, len(facts.lengths)))
    shards = max(1, math.ceil(estimated_bytes(facts.n, n_keys) / most_bytes))
    mask = None
    for shard in range(shards):
        found = _mask(sent(spark, build(own.select("kind", "key", "a", "b"), rows, n_keys, shards, shard)))(F.col("a"), F.col("b"))
        rows = rows.withColumn("mask", found if mask is None else F.zip_with("mask", found, lambda x, y: x.bitwiseOR(y)))
        mask = True
        if shard + 1 < shards:
            rows = written(rows, f"judged-{shard}")
    hits = F.filter(F.zip_with("pairs", "mask", lambda p, m: F.struct(F.length(p["key"]).alias("n"), F.length(p["host"]).alias("h"), m.bitwiseAND(F.lit(3)).alias("kind"), p["key"].alias("key"))), lambda x: x["kind"] > 0)
    best = F.array_max(hits)
    rows = rows.select("page_id", "host", "path", best.alias("best"), F.exists("mask", lambda m: m >= 1 << LISTED).alias("listed"))
    verdict = F.when(F.col("best.kind") == 1 << ALLOW, "allow").when(F.col("best").isNotNull(), "block").when(F.col("listed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"), "listed")
