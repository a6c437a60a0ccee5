"""Best-fit packing of documents into bins of a fixed number of tokens, with conflicts.

Two documents of one source, or of one cluster of duplicates, never share a
bin. Documents are dealt to shards of bounded size by a hash of their id, so
a source or a cluster that holds a third of all rows is spread over all of
them. In a shard the longest come first. Bins are kept by what is left in
them and carry a bitmap of their sources and one of their clusters; the search
starts at the bin that the document would fill best and goes on to the next
larger rest until a compatible one is found, or a new bin is opened.
Only ids, keys and counts are shuffled, no texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

CAPACITY, SHARD_TOKENS, SHARD_DOCS = 2048, 1 << 20, 4096


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item, in the order given; items are at most ``capacity`` long."""
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1)}  # a single document has no conflict
    rest_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rests = 0  # bit r: some bin has r tokens left
    has_source: list[int] = []
    has_cluster: list[int] = []
    out = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        s_bit, c_bit = source_bit[s], cluster_bit.get(c, 0)
        rest, found = n, -1
        while (above := open_rests >> rest) and found < 0:
            rest += (above & -above).bit_length() - 1
            for k, b in enumerate(rest_bins[rest]):
                if not has_source[b] & s_bit and not has_cluster[b] & c_bit:
                    found = b
                    del rest_bins[rest][k]
                    break
            else:
                rest += 1
        if found < 0:
            found, rest = len(has_source), capacity
            has_source.append(0)
            has_cluster.append(0)
        elif not rest_bins[rest]:
            open_rests &= ~(1 << rest)
        has_source[found] |= s_bit
        has_cluster[found] |= c_bit
        rest -= n
        rest_bins[rest].append(found)
        open_rests |= 1 << rest
        out.append(found)
    return out


def _shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        shard, ids, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "doc_id", "n_tokens"))
        order = np.lexsort((table.column("cluster").fill_null(0).to_numpy(), np.nan_to_num(ids.astype(float), nan=np.inf), -(n % capacity)))
        tail = order[n[order] % capacity > 0]
        # A row without a cluster is one of its own, whatever its id and length.
        sources, clusters = table.column("source").to_pylist(), [(k,) if c is None else c for k, c in enumerate(table.column("cluster").to_pylist())]
        bins = best_fit((n[tail] % capacity).tolist(), [sources[k] for k in tail], [clusters[k] for k in tail], capacity)
        full = np.repeat(np.arange(len(n)), n // capacity)  # whole bins of long documents
        piece = np.arange(len(full)) - np.repeat(np.cumsum(n // capacity) - n // capacity, n // capacity)
        used = max(bins, default=-1) + 1
        row = np.concatenate([full, tail, np.flatnonzero(n == 0)])
        where = np.concatenate([used + np.arange(len(full)), np.array(bins, np.int64), np.full(int((n == 0).sum()), -1)]).astype(np.int64)
        length = np.concatenate([np.full(len(full), capacity), n[tail] % capacity, np.zeros(int((n == 0).sum()), np.int64)]).astype(np.int64)
        no = np.concatenate([piece, n[tail] // capacity, np.zeros(int((n == 0).sum()), np.int64)]).astype(np.int64)
        by_bin = np.argsort(where, kind="stable")
        ends = np.cumsum(length[by_bin])
        first = np.concatenate([[True], np.diff(where[by_bin]) != 0]) if len(where) else np.zeros(0, bool)
        start = np.empty(len(where), np.int64)
        start[by_bin] = ends - length[by_bin] - np.maximum.accumulate(np.where(first, ends - length[by_bin], 0)) if len(where) else 0
        none = pa.array(where < 0)
        number = pa.array(shard[0].astype(np.int64) * (1 << 40) + where, mask=where < 0) if len(where) else pa.array([], pa.int64())
        return pa.table({"doc_id": table.column("doc_id").take(pa.array(row)), "piece": no.astype(np.int32), "bin": number, "start": pa.array(start, mask=none.to_numpy(zero_copy_only=False)), "n_tokens": length})

    return run


def packed(docs: DataFrame, *, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Of ``docs`` (doc_id, source, cluster, n_tokens): doc_id, piece, bin, start, n_tokens.

    A document longer than ``capacity`` fills whole bins with its first pieces;
    its last piece is packed with others. start is the first token in the bin.
    A document without tokens has one piece of length 0 in no bin (null). Null
    sources are one source; a null cluster is a cluster of its own. Rows that
    repeat an id are packed each. An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("cluster").cast("long").alias("cluster"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"),
    )
    rows = written(rows, "lengths")
    tokens, n = rows.agg(F.sum("n_tokens"), F.count("*")).first()
    shards = max(1, math.ceil(max((tokens or 0) / shard_tokens, n / shard_docs)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.coalesce("cluster", F.xxhash64(F.lit("no cluster"), "doc_id", "n_tokens")), "n_tokens"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_shard(capacity), "doc_id long, piece int, bin long, start long, n_tokens long")
