"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own whose
nodes are the last 0 to DEPTH bytes. A node predicts with the
Krichevsky-Trofimov estimate of its zeros and ones, and the weights that mix
the estimates of all depths are those of context-tree weighting: half of a
node's weight is its own estimate's, half that of its children together. A
path ends at its deepest node seen in training. The
code length of a text is the sum over its bytes and one end mark, so the
model is a distribution over whole texts.

What is learnt is the number of times each byte follows each context in the
training texts; all else follows from these counts. They are gathered from the
whole corpus and never in one place: documents are dealt to blocks by a hash
of their id, a block sends the distinct contexts (and words) it needs with its
own counts, these are summed by bucket, and each block gets back the values it
asked for. The trees are computed for all contexts that share their last three
bytes together; what the nodes above sum over such groups is added up in Spark
for two bytes of context and sent back to the groups. Only the nodes of the
two shallowest levels, 256 contexts of 255 decisions, go through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, sent, written
from .text import lowered, mixed, pieces, prefix_sums, run_hash, words

DEPTH = 5  # bytes of context; a context with its byte is one number of DEPTH + 1 bytes
BLOCK_BYTES, BUCKET_KEYS = 1 << 24, 1 << 20
END = 0xFF  # no byte of UTF-8: the end mark, and what stands before a text
END_WORD = mixed(np.array([END], np.uint64))
LOG_HALF = math.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series after eight steps of recurrence."""
    up = np.zeros_like(x)
    for k in range(8):
        up += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - up


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimate gives to a sequence of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and each end mark with its context as one number, and where each text's numbers begin.

    The last byte before stands highest, the predicted one lowest, so that
    contexts that end alike are neighbours in sorted order.
    """
    n = len(offsets) - 1
    lead = np.repeat(np.arange(1, n + 1) * DEPTH, np.diff(offsets))
    stream = np.full(len(data) + DEPTH * n + 1, END, np.uint64)
    stream[np.arange(len(data)) + lead] = data
    starts = offsets[:-1] + DEPTH * np.arange(1, n + 1)
    ends = offsets[1:] + DEPTH * np.arange(1, n + 1)  # where the end marks stand
    own = np.ones(len(stream), bool)
    for d in range(DEPTH):
        own[starts - 1 - d] = False
    own[ends] = True
    at = np.flatnonzero(own)
    key = stream[at]
    for d in range(DEPTH):
        key |= stream[at - 1 - d] << np.uint64(8 * (DEPTH - d))
    return key, offsets[:-1] + np.arange(n)


def tokens(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    start, end, row = words(low, offsets)
    return run_hash(prefix_sums(low), start, end), row


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, n = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (counts, np.int64)))
    order = np.argsort(key)
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[start], np.add.reduceat(n, start) if len(start) else n


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is a training one."""
    seen, n = np.unique(keys[train], return_counts=True)
    other = np.unique(keys[~train])
    return _counted([seen, other], [n, np.zeros(len(other), np.int64)])


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a key: the same for every block, and even."""
    return ((mixed(key) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


REQUEST = "kind int, bucket int, block long, keys binary, n binary, total long"


def _by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order of sorted keys by bucket, the buckets that occur, and where each begins (and the last ends)."""
    to = _bucket(key, buckets)
    order = np.argsort(to, kind="stable")
    start = np.flatnonzero(np.diff(to[order], prepend=-1))
    return order, to[order][start], [*start.tolist(), len(key)]


def _requests(buckets: int):
    """A block of (block, train, text) to its distinct contexts (kind 0) and words (kind 1) with their training counts, by bucket."""

    def run(table: pa.Table) -> pa.Table:
        train = table.column("train").to_numpy(zero_copy_only=False)
        found: list[list] = [[[], []], [[END_WORD], [np.array([train.sum()], np.int64)]]]
        for first, end, data, offsets in pieces(table.column("text")):
            low, own = lowered(data), train[first:end]
            key, start = grams(low, offsets)
            word, row = tokens(low, offsets)
            for kind, (k, t) in enumerate(((key, np.repeat(own, np.diff(start, append=len(key)))), (word, own[row]))):
                got, n = _distinct(k, t)
                found[kind][0].append(got)
                found[kind][1].append(n)
        block, out = table.column("block")[0].as_py(), []
        for kind, (keys, counts) in enumerate(found):
            key, n = _counted(keys, counts)
            order, to, edge = _by_bucket(key, buckets)
            key, n = key[order], n[order]
            for k, (s, e) in zip(to.tolist(), zip(edge, edge[1:], strict=False), strict=True):
                # DEPTH + 1 bytes hold a context with its byte; counts of a block fit 32 bits
                part = key[s:e].view(np.uint8).reshape(-1, 8)[:, : DEPTH + 1 if kind == 0 else 8]
                out.append({"kind": kind, "bucket": k, "block": block, "keys": np.ascontiguousarray(part).tobytes(), "n": n[s:e].astype(np.uint32).tobytes(), "total": int(n[s:e].sum())})
        return pa.Table.from_pylist(out, pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("total", pa.int64())]))

    return run


def _keys(blob: bytes, kind: int) -> np.ndarray:
    if kind:
        return np.frombuffer(blob, np.uint64)
    wide = np.zeros((len(blob) // (DEPTH + 1), 8), np.uint8)
    wide[:, : DEPTH + 1] = np.frombuffer(blob, np.uint8).reshape(-1, DEPTH + 1)
    return wide.view(np.uint64).ravel()


def _summed(kind: int, table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A bucket's keys by block, its distinct keys and their counts over all blocks."""
    keys = [_keys(x, kind) for x in table.column("keys").to_pylist()]
    return keys, *_counted(keys, [np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("n").to_pylist()])


def _context_counts(table: pa.Table) -> pa.Table:
    """A bucket's requests to rows of (context with byte, training count), also where that is zero."""
    _, key, n = _summed(0, table)
    return pa.table({"key": key.view(np.int64), "n": n})


def _word_counts(table: pa.Table) -> pa.Table:
    """A bucket's requests to each block's word counts in the order asked, and the bucket's distinct words on every row."""
    keys, key, n = _summed(1, table)
    replies = [n[np.searchsorted(key, k)].tobytes() for k in keys]
    return pa.table({"block": table.column("block"), "kind": pa.array([1] * len(keys), pa.int32()), "bucket": table.column("bucket"), "reply": pa.array(replies, pa.binary()), "seen": pa.array([int((n > 0).sum())] * len(keys), pa.int64())})


REPLY = "block long, kind int, bucket int, reply binary, seen long"


class Level:
    """The nodes of one decision at one depth: zeros, ones, and the log weight of the subtree below."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.n0, self.n1, self.below = key, n0, n1, below
        own = log_kt(n0, n1)
        self.weight = own if below is None else np.logaddexp(own, below) + LOG_HALF
        self.odds = None if below is None else own - below

    def one(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)

    def seen(self) -> np.ndarray:
        return self.n0 + self.n1 > 0

    def mix(self, deeper: np.ndarray, known: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of a one in nodes ``at``, given that of the next depth where it is known; whether these are known."""
        own = 1 / (1 + np.exp(-np.clip(self.odds, -700, 700)))
        share = np.where(known, own[at], 1.0)
        return share * self.one()[at] + (1 - share) * deeper, self.seen()[at]


def _trees(key: np.ndarray, n: np.ndarray, decision: int, top: int) -> tuple[list[Level], list[np.ndarray]]:
    """The levels from depth DEPTH to ``top`` of one decision, and the node of each key (then of each node) in the next."""
    symbol = key & np.uint64(0xFF)
    bit = (symbol >> np.uint64(7 - decision) & np.uint64(1)).astype(bool)
    # A node is its context, cut to its depth, and the bits decided before.
    node = (key >> np.uint64(8)) << np.uint64(8) | symbol >> np.uint64(8 - decision)
    names, at = np.unique(node, return_inverse=True)
    n0, n1 = np.bincount(at, np.where(bit, 0, n), len(names)), np.bincount(at, np.where(bit, n, 0), len(names))
    levels, to = [Level(names, n0, n1, None)], [at]
    for depth in range(DEPTH - 1, top - 1, -1):
        last, drop = levels[-1], np.uint64(8 * (DEPTH - depth))
        up = last.key >> (drop + np.uint64(8)) << (drop + np.uint64(8)) | last.key & np.uint64(0xFF)
        names, at = np.unique(up, return_inverse=True)
        levels.append(Level(names, *(np.bincount(at, x, len(names)) for x in (last.n0, last.n1, last.weight))))
        to.append(at)
    return levels, to


TOP = 3  # the depth down to which a group of contexts, dealt by their last three bytes, is complete


def _above(level: Level, context: int, decision: int) -> np.ndarray:
    """The number of each node's ancestor: its last ``context`` bytes, then the bits decided before under a leading one."""
    last = (level.key >> np.uint64(8 * (DEPTH + 1 - context))).astype(np.int64)
    return last * 256 + (1 << decision) + (level.key & np.uint64(0xFF)).astype(np.int64)


def _parents(node: np.ndarray, level: Level) -> pa.Table:
    """What each of the nodes named for the rows of ``level`` sums over these."""
    names, at = np.unique(node, return_inverse=True)
    return pa.table({"node": names, **{c: np.bincount(at, x, len(names)) for c, x in (("n0", level.n0), ("n1", level.n1), ("below", level.weight))}})


SUMS = "node long, n0 double, n1 double, below double"


def _tops(group: tuple, table: pa.Table) -> pa.Table:
    """A group of contexts to what each node with two bytes of context sums over its children in the group."""
    key, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    out = []
    for decision in range(8):
        level = _trees(key, n, decision, TOP)[0][-1]
        out.append(_parents(_above(level, TOP - 1, decision), level))
    out = pa.concat_tables(out)
    return out.add_column(0, "group", pa.array([group[0].as_py()] * out.num_rows, pa.int32()))


def _level(table: pa.Table | pa.RecordBatch) -> Level:
    """Rows of SUMS as a level, in the order of their numbers."""
    node, *sums = (table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in ("node", "n0", "n1", "below"))
    order = np.argsort(node)
    return Level(node[order], *(x[order] for x in sums))


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with two bytes of context to what each node with one byte sums over these."""
    for batch in batches:
        level = _level(batch)
        yield from _parents((level.key >> 16) * 256 + (level.key & 255), level).to_batches()


class Shallow:
    """Depths 1 and 0 of all decisions, 256 * 256 nodes at most."""

    def __init__(self, rows: list):
        node = np.array([r[0] for r in rows], np.int64)
        n0, n1, below = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
        self.at = np.full(1 << 16, -1, np.int64)
        self.at[node] = np.arange(len(node))
        self.one_byte = Level(node, n0, n1, below)
        name = node & 255
        self.none = Level(np.arange(256), *(np.bincount(name, x, 256) for x in (n0, n1, self.one_byte.weight)))

    def mix(self, node: np.ndarray, deeper: np.ndarray, known: np.ndarray) -> np.ndarray:
        return self.none.mix(*self.one_byte.mix(deeper, known, self.at[node]), node & 255)[0]


def _logs(shallow):
    """A group of contexts, and its nodes with two bytes of context, to the log probability of each byte after its context, all depths mixed."""

    def run(table: pa.Table, nodes: pa.Table) -> pa.Table:
        key, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
        symbol, second = (key & np.uint64(0xFF)).astype(np.int64), _level(nodes)
        two = (key >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)
        total = np.zeros(len(key))
        for decision in range(8):
            levels, to = _trees(key, n, decision, TOP)
            at, p, known = to[0], levels[0].one()[to[0]], levels[0].seen()[to[0]]
            for level, up in zip(levels[1:], to[1:], strict=True):
                at = up[at]
                p, known = level.mix(p, known, at)
            name = (1 << decision) + (symbol >> (8 - decision))
            p, known = second.mix(p, known, np.searchsorted(second.key, two * 256 + name))
            p = shallow().mix((two >> 8) * 256 + name, p, known)
            total += np.log(np.where(symbol >> (7 - decision) & 1, p, 1 - p))
        return pa.table({"key": table.column("key"), "log_p": total})

    return run


def _context_replies(asked: pa.Table, logs: pa.Table) -> pa.Table:
    """A bucket's requests and log probabilities to each block's, in the order asked."""
    key, value = logs.column("key").to_numpy().view(np.uint64), logs.column("log_p").to_numpy()
    order = np.argsort(key)
    key, value = key[order], value[order].astype(np.float32)
    replies = [value[np.searchsorted(key, _keys(x, 0))].tobytes() for x in asked.column("keys").to_pylist()]
    n = len(replies)
    return pa.table({"block": asked.column("block"), "kind": pa.array([0] * n, pa.int32()), "bucket": asked.column("bucket"), "reply": pa.array(replies, pa.binary()), "seen": pa.array([0] * n, pa.int64())})


def _summed_nodes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below")))


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _scores(total: int, distinct: int, buckets: int):
    """A block's texts and replies to a row per document."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        parts, keys = [], ([], [END_WORD])
        for first, last, data, offsets in pieces(docs.column("text")):
            low = lowered(data)
            key, start = grams(low, offsets)
            word, row = tokens(low, offsets)
            (key, at), (word, word_at) = (np.unique(x, return_inverse=True) for x in (key, word))
            keys[0].append(key)
            keys[1].append(word)
            parts.append((first, last, key, at.astype(np.int32), start, word, word_at.astype(np.int32), row.astype(np.int32)))
        known = []
        for kind, kind_type in ((0, np.float32), (1, np.int64)):
            key = np.unique(np.concatenate(keys[kind]))
            order, to, _ = _by_bucket(key, buckets)
            mine = replies.filter(pc.equal(replies.column("kind"), kind))
            reply = dict(zip(mine.column("bucket").to_pylist(), mine.column("reply").to_pylist(), strict=True))
            value = np.empty(len(key), kind_type)
            value[order] = np.frombuffer(b"".join(reply[k] for k in to.tolist()), kind_type)
            known.append((key, value.astype(np.float64) if kind == 0 else value))
        (context, log_p), (word_key, count) = known
        points = np.log10(count + 1.0) - math.log10(total + distinct + 1)
        end = int(np.searchsorted(word_key, END_WORD[0]))
        n_docs = docs.num_rows
        n_tokens, n_known, base, score = np.ones(n_docs, np.int64), np.full(n_docs, int(count[end] > 0)), np.full(n_docs, points[end]), np.zeros(n_docs)
        for first, last, key, at, start, word, word_at, row in parts:
            score[first:last] = np.add.reduceat(log_p[np.searchsorted(context, key)][at], start) / math.log(10)
            own = np.searchsorted(word_key, word)
            n_tokens[first:last] += np.bincount(row, minlength=last - first)
            n_known[first:last] += np.bincount(row, (count > 0)[own][word_at], last - first).astype(np.int64)
            base[first:last] += np.bincount(row, points[own][word_at], last - first)
        return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": score, "n_bytes": pc.binary_length(docs.column("text")).cast(pa.int64())})

    return run


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    score is the log10 probability of the text, A-Z in lower case, and its end
    under the weighted context trees of the rows that are not held out, summed
    from each byte's in single precision; bits_per_byte is its code length over the
    text's bytes and its end mark, which counts as one;
    base_score that of its words under their smoothed counts. Words are told
    apart by 64-bit hash. A null text is empty: its end alone is scored. A null
    id counts as the empty string for the split. Rows that repeat an id are
    scored, and learnt from, each. An empty table gives an empty result; with
    no training rows, every decision has probability one half. Texts of any length are read whole. Other columns, whatever
    their names, are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    size, n_docs = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, math.ceil((size + n_docs) / block_bytes))
    buckets = max(1, math.ceil((size + n_docs) / (8 * BUCKET_KEYS)))
    # The text is part of the hash, so that rows that repeat an id are spread too.
    dealt = texts.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).alias("block"), (~held_out("doc_id")).alias("train"), "doc_id", "text")
    asked = written(dealt.select("block", "train", "text").groupBy("block").applyInArrow(_requests(buckets), REQUEST), "requests")
    by_word = written(asked.filter("kind = 1").groupBy("bucket").applyInArrow(_word_counts, REPLY), "word-replies")
    total = asked.filter("kind = 1").agg(F.sum("total")).first()[0] or 0
    distinct = by_word.groupBy("bucket").agg(F.max("seen").alias("seen")).agg(F.sum("seen")).first()[0] or 0

    contexts = written(asked.filter("kind = 0").groupBy("bucket").applyInArrow(_context_counts, "key long, n long"), "contexts")
    groups = max(1, min(1 << 20, math.ceil(contexts.count() / BUCKET_KEYS * 8)))
    # Contexts with the same last three bytes go together: at most 256 ** (DEPTH - 2) numbers, however large the corpus.
    grouped = contexts.withColumn("group", F.pmod(F.xxhash64(F.shiftrightunsigned("key", 8 * (DEPTH - 2))), F.lit(groups)).cast("int"))
    tops = written(grouped.groupBy("group").applyInArrow(_tops, f"group int, {SUMS}"), "context-tops")
    # Nodes with two bytes of context: 2 ** 24 at most, each in 256 groups at most.
    second = written(_summed_nodes(tops), "two-bytes")
    # One row per node of depth 1: 65,536 at most, by construction.
    shallow = Shallow(_summed_nodes(second.mapInArrow(_firsts, SUMS)).collect())
    wanted = tops.select("group", "node").join(second, "node")
    logs = grouped.groupBy("group").cogroup(wanted.groupBy("group")).applyInArrow(_logs(sent(spark, shallow)), "key long, log_p double")
    logs = written(logs, "log-probabilities")
    for read in (contexts, tops, second):
        dropped(read)

    @F.arrow_udf("int")
    def bucket_of(key: pa.Array) -> pa.Array:
        return pa.array(_bucket(key.to_numpy(zero_copy_only=False).view(np.uint64), buckets).astype(np.int32))

    by_context = asked.filter("kind = 0").groupBy("bucket").cogroup(logs.select(bucket_of("key").alias("bucket"), "key", "log_p").groupBy("bucket")).applyInArrow(_context_replies, REPLY)
    replies = by_word.unionByName(by_context)
    out = dealt.select("block", "doc_id", "text").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scores(total, distinct, buckets), SCORED)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def plain_log_probabilities(train: list[bytes], texts: Iterator[bytes]) -> list[float]:
    """The same scores by the definition, with dictionaries: for tests on small inputs."""
    counts: dict[tuple, list[int]] = {}
    children: dict[tuple, set] = {}

    def decisions(text: bytes):
        stream = bytes([END] * DEPTH) + text + bytes([END])
        for i in range(DEPTH, len(stream)):
            name = 1
            for k in range(7, -1, -1):
                bit = stream[i] >> k & 1
                yield [(name, stream[i - d : i]) for d in range(DEPTH + 1)], bit
                name = name * 2 + bit

    for t in train:
        for path, bit in decisions(t):
            for d, node in enumerate(path):
                counts.setdefault(node, [0, 0])[bit] += 1
                if d:
                    children.setdefault(path[d - 1], set()).add(node)
    kt = lambda node: float(log_kt(*(np.array([float(x)]) for x in counts.get(node, [0, 0])))[0])
    known: dict[tuple, tuple[float, float]] = {}

    def weight(node) -> tuple[float, float]:
        """Log weight of a node and of its children together."""
        if node not in known:
            below = sum(weight(c)[0] for c in children.get(node, ()))
            known[node] = (kt(node) if len(node[1]) == DEPTH else float(np.logaddexp(kt(node), below)) + LOG_HALF, below)
        return known[node]

    out = []
    for t in texts:
        total = 0.0
        for path, bit in decisions(t):
            p = None
            for node in reversed(path):
                n0, n1 = counts.get(node, [0, 0])
                own = (n1 + 0.5) / (n0 + n1 + 1)
                if p is None:
                    p = own if n0 + n1 or not node[1] else None
                else:
                    share = 1 / (1 + math.exp(-max(-700.0, min(700.0, kt(node) - weight(node)[1]))))
                    p = share * own + (1 - share) * p
            total += math.log(p if bit else 1 - p)
        out.append(total / math.log(10))
    return out
