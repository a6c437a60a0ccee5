"""Near duplicates by SimHash: fingerprints within three bits, linked by meeting in the middle.

A fingerprint has 64 bits. Two fingerprints that differ in up to three bits
meet in a variant that lies within one bit of the one and within two of the
other. So every fingerprint sends the variants within half the radius, one
bit rounded down or two bits rounded up: those of even parity send the 65
within one bit; those of odd parity also those with two bits flipped (two
that differ in one or three bits have different parity, and two that differ
in two bits meet within one bit of each). Of three bits, two lie in the same
half, so pairs within a half suffice: 1057 variants instead of 2081.

The shuffle is on variants. In a variant's group, each member is within three
bits of any that is within one bit of the variant, so a star around one such
member links all: no pairs within a group are made. Every link is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .store import dropped, written

SHINGLE, SEED = 3, 42
ONES = [1 << k for k in range(64)]
PAIRS = [1 << (h + i) | 1 << (h + j) for h in (0, 32) for i in range(32) for j in range(i)]
FLIPS = np.array([0, *ONES, *PAIRS], np.uint64)
NEAR = 65  # of FLIPS, those of one bit at most
BATCH, BUCKET = 2048, 1 << 20  # fingerprints a batch, variants a bucket
TASK_VARIANTS = 1 << 22
MEAN_VARIANTS = (NEAR + len(FLIPS)) / 2


def fingerprint(text: bytes | None) -> int:
    """The SimHash of one text: A-Z in lower case, three-word shingles, XXH64."""
    own = (text or b"").lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(own) - SHINGLE + 1].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 255 * 64):  # sums of up to 255 bits fit a byte
        bits = np.unpackbits(hashes[k : k + 255 * 64].view(np.uint8), bitorder="little").reshape(-1, 64)
        for i in range(0, len(bits), 255):
            counts += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in text.to_pylist()], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long, zero for a text without words or null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _fingerprints(F.col(text_col).cast("binary")).alias("fp"))


def _variants(n_buckets: int):
    """Batches of distinct fingerprints to rows of a bucket's variants and the flips that made them."""

    def emit(fps: np.ndarray) -> pa.RecordBatch:
        odd = np.bitwise_count(fps) & 1 == 1
        keys = [(fps[~odd][:, None] ^ FLIPS[:NEAR]).ravel(), (fps[odd][:, None] ^ FLIPS).ravel()]
        flips = [np.tile(np.arange(n, dtype=np.uint16), m) for n, m in ((NEAR, int((~odd).sum())), (len(FLIPS), int(odd.sum())))]
        key, flip = np.concatenate(keys), np.concatenate(flips)
        spread = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        bucket = ((spread * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        key, flip, bucket = key[order], flip[order], bucket[order]
        start = np.flatnonzero(np.diff(bucket, prepend=-1))
        end = [*start[1:].tolist(), len(key)]
        cut = list(zip(start.tolist(), end, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.array([key[s:e].tobytes() for s, e in cut], pa.binary()), pa.array([flip[s:e].tobytes() for s, e in cut], pa.binary())], ["bucket", "keys", "flips"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            while sum(map(len, held)) >= BATCH:
                fps = np.concatenate(held)
                yield emit(fps[:BATCH])
                held = [fps[BATCH:]]
        if held and len(fps := np.concatenate(held)):
            yield emit(fps)

    return run


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components: each node but the smallest of a component with that smallest."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while (new != (again := new[new])).any():
            new = again
        if (new == label).all():
            own = label != np.arange(len(nodes))
            return nodes[own], nodes[label[own]]
        label = new


def _links(table: pa.Table) -> pa.Table:
    """A bucket's variants to links between fingerprints within three bits."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
    flips = np.frombuffer(b"".join(table.column("flips").to_pylist()), np.uint16)
    order = np.argsort(keys)
    keys, flips = keys[order], flips[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(start, append=len(keys))
    several = np.repeat(size > 1, size)
    keys, flips, size = keys[several], flips[several], size[size > 1]
    a = b = np.zeros(0, np.uint64)
    if len(size):
        start = np.cumsum(size) - size
        fps, near = keys ^ FLIPS[flips], flips < NEAR
        # The star's centre: the smallest member within one bit of the variant.
        rank = np.where(near, fps, np.uint64(2**64 - 1))
        centre = np.repeat(np.minimum.reduceat(rank, start), size)
        linked = np.repeat(np.logical_or.reduceat(near, start), size) & (fps != centre)
        a, b = fps[linked], centre[linked]
        sure = np.bitwise_count(a ^ b) <= 3
        a, b = spanning(a[sure], b[sure])
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Rows link when their fingerprints differ in three bits at most;
    component_id is the smallest id that links reach, the row's own included.
    Texts without words, empty or null, have fingerprint zero and link like any
    other. Rows that repeat an id are all returned. A null id is never the
    smallest, so a component of null ids has a null component_id. An empty
    table gives an empty result. Texts of any length are read whole. Other columns, whatever
    their names, are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    buckets = max(1, math.ceil(distinct.count() * MEAN_VARIANTS / BUCKET))
    # The table of fingerprints is small, what a task makes of it is not: dealt by the variants to come.
    tasks = max(1, math.ceil(distinct.count() * MEAN_VARIANTS / TASK_VARIANTS))
    variants = distinct.select("fp").repartition(tasks, "fp").mapInArrow(_variants(buckets), "bucket int, keys binary, flips binary")
    found = written(variants.groupBy("bucket").applyInArrow(_links, "a long, b long"), "near-links")
    roots = components(found)
    rooted = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    dropped(found)
    named = written(rooted.join(least, "root").select(F.col("fp").alias("own"), "component_id"), "named")
    for old in (distinct, rooted, least):
        dropped(old)
    return rows.join(named, F.col("fp") == F.col("own")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
