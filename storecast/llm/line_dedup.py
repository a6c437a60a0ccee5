"""Lines that many documents share, dropped from all of them.

Lines are normalised and hashed, the distinct documents of each hash counted,
and the lines of the hashes over the threshold dropped; the others are put
together again in their order. Only hashes and line numbers are shuffled
before the last join; each task sends a hash once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .text import SPACE

MIN_DOCS, MIN_CHARS = 10, 1


def _keys(min_chars: int):
    """Arrow batches of (doc_id, t1, t2, text) to a row per document and distinct line key, with the lines that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, where = [], [], []
            for row, (doc, text) in enumerate(zip(batch.column(0), batch.column(3).to_pylist(), strict=True)):
                seen: dict[bytes, list[int]] = {}
                for k, line in enumerate((text or b"").lower().split(b"\n")):
                    key = line.strip(SPACE)
                    if key and (min_chars == 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        seen.setdefault(key, []).append(k)
                ids.extend([row] * len(seen))
                hashes.extend(map(xxhash.xxh3_128_digest, seen))
                where.extend(seen.values())
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            rows = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(rows) for k in range(3)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(where, pa.list_(pa.int32()))],
                ["doc_id", "t1", "t2", "h1", "h2", "lines"],
            )

    return run


@F.arrow_udf(T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]))
def _without(text: pa.Array, lines: pa.Array) -> pa.Array:
    """The text without the lines of the given numbers."""
    out = []
    for t, drop in zip(text.to_pylist(), lines.to_pylist(), strict=True):
        own = (t or b"").split(b"\n")
        gone = {k for part in drop or () for k in part}
        kept = b"\n".join(x for k, x in enumerate(own) if k not in gone) if gone else (t or b"")
        out.append({"n_lines": len(own), "n_dropped": len(gone), "kept": kept.decode("utf-8", "replace")})
    return pa.array(out, pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())]))


def common_lines_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept (the text that is left).

    A line's key is the line without whitespace at its ends, A-Z in lower case.
    Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines. Rows that repeat an id are one document in
    the counts; a null id is a document of its own. Each row loses lines of its
    own text only. A null or empty text is one empty line,
    which is never dropped. Keys are compared by 128-bit hash. An empty table gives
    an empty result. Texts of any length are read whole. Other columns, whatever
    their names, are not read.
    """
    text = F.col(text_col).cast("binary")
    # An id may be null or stand for several texts: a row is known by its id and 128 bits of its text.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    keys = written(texts.mapInArrow(_keys(min_chars), "doc_id long, t1 long, t2 long, h1 long, h2 long, lines array<int>"), "line-keys")
    counted = keys.select("doc_id", "h1", "h2")
    if not texts.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        counted = counted.filter("doc_id is not null").distinct().unionByName(counted.filter("doc_id is null"))
    hot = written(counted.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2"), "common-lines")
    lost = keys.join(hot, ["h1", "h2"]).groupBy(F.col("doc_id").alias("lost_id"), F.col("t1").alias("l1"), F.col("t2").alias("l2")).agg(F.collect_set("lines").alias("lines"))
    both = texts.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("t1") == F.col("l1")) & (F.col("t2") == F.col("l2")), "left")
    return both.select("doc_id", _without("text", "lines").alias("x")).select("doc_id", "x.n_lines", "x.n_dropped", "x.kept")
