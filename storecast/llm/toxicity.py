"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Features are words and the first four bytes of words (inflected forms share a
stem), lower-cased, split at everything that is neither a letter nor a digit.
All features of the examples make the vocabulary. The inverse document
frequencies are counted over all documents; a feature's is multiplied by the
root of one plus its chi-squared statistic with the label on the examples, so
none is left out, and without any association the weights are plain TF-IDF.
The examples' vectors stand in an inverted index whose postings lie in blocks
with the largest weight of each term; a query reads the common terms' lists
first, and of the others only blocks that their bounds leave in reach of the k
best.
The votes of the neighbours, weighted by cosine, are calibrated by isotonic
regression on the examples themselves, each left out of its own vote.

The classifier is fitted on at most MAX_EXAMPLES labelled documents with at most
MAX_FEATURES distinct features each counted, taken in the order of a hash of
their id, each whole. So the index that is built on the driver and broadcast has
a fixed bound, however long the texts are. Scores depend on the text alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import dropped, sent, written
from .text import lowered, mixed, pieces, prefix_sums, run_hash, words

MAX_EXAMPLES, MAX_FEATURES = 4_000, 3_000_000
#: An example with more than this share of all features that may be taken is passed over.
LARGEST = 1 / 20
PREFIXES = (4,)
NEIGHBOURS, BLOCK, SMOOTHING, EVIDENCE = 15, 64, 0.05, 3
DENSE, QUERIES_AT_ONCE, PIECE = 16, 64, 1 << 19


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, times) of the distinct words by row; the words' feature hashes, one row per kind, and which of them exist."""
    low = lowered(data)
    letter = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    start, end, row = words(low, offsets, letter)
    sums = prefix_sums(low)
    whole, first, word = np.unique(run_hash(sums, start, end), return_index=True, return_inverse=True)
    start, end = start[first], end[first]
    both, times = np.unique(row * max(1, len(whole)) + word, return_counts=True)
    kinds, exist = [whole], [np.ones(len(whole), bool)]
    for k in PREFIXES:
        long = end - start >= k
        kinds.append(np.zeros(len(whole), np.uint64))
        kinds[-1][long] = mixed(run_hash(sums, start[long], start[long] + k) + np.uint64(k))
        exist.append(long)
    return both // max(1, len(whole)), both % max(1, len(whole)), times, np.array(kinds), np.array(exist)


def _added(rows: np.ndarray, terms: np.ndarray, times: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) with equal pairs added up, by row and term."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = rows * n_terms + terms
    order = np.argsort(both)
    both = both[order]
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[start] // n_terms, both[start] % n_terms, np.add.reduceat(times[order], start)


@dataclass
class Terms:
    """The vocabulary: sorted feature hashes."""

    hashes: np.ndarray

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times) of the vocabulary's terms, by row."""
        if not len(self.hashes) or not len(data):
            return _added(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 1)
        row, word, times, features, exist = _features(data, offsets)
        at = np.minimum(np.searchsorted(self.hashes, features), len(self.hashes) - 1)
        hit = (exist & (self.hashes[at] == features))[:, word]
        kind, pair = np.nonzero(hit)
        return _added(row[pair], at[kind, word[pair]], times[pair], len(self.hashes))


def _document_counts(get: Callable[[], Terms]):
    """Texts to (term, documents), one row per term and task, and the number of documents as term -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = get()
        n, seen = 0, np.zeros(len(terms.hashes), np.int64)
        for batch in batches:
            n += len(batch)
            for _, _, data, offsets in pieces(batch.column(0), PIECE):
                seen += np.bincount(terms.counts(data, offsets)[1], minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[n], seen[some]]))], ["term", "n"])

    return run


def _feature_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, toxic) to (doc_id, toxic, features, times)."""
    for batch in batches:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(batch)
        for first, _, data, offsets in pieces(batch.column(1), PIECE):
            if not len(data):
                continue
            row, word, times, features, exist = _features(data, offsets)
            known, at = np.unique(features, return_inverse=True)
            kind, pair = np.nonzero(exist[:, word])
            rows, terms, times = _added(row[pair], at.reshape(features.shape)[kind, word[pair]], times[pair], max(1, len(known)))
            start = np.flatnonzero(np.diff(rows, prepend=-1)).tolist()
            for s, e in zip(start, [*start[1:], len(rows)], strict=False):
                out[first + int(rows[s])] = known[terms[s:e]].view(np.int64), times[s:e].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.list_(pa.int32()))], ["doc_id", "toxic", "features", "times"])


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all the ranges, one after another, and the lengths."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def _unit_weights(term: np.ndarray, times: np.ndarray, idf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The TF-IDF weights of vectors that lie one after another, each vector of length one."""
    out = np.log(times)
    out += 1
    out *= idf[term]
    ends = np.cumsum(sizes)
    for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        own = out[start:end]
        own /= np.sqrt((own * own).sum())
    return out


class BlockMaxIndex:
    """Unit vectors by term, the postings in blocks of owners with their largest weight.

    Terms that more than a DENSE-th of the owners have are lists without gaps,
    a matrix that is read for many queries at once; the other terms' postings
    lie by block, and are read only in blocks that can hold one of the k best.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        self._build(sizes, np.concatenate([t for t, _ in vectors]).astype(np.int32) if vectors else np.zeros(0, np.int32), np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0), n_terms, block)

    @classmethod
    def of(cls, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        """Of vectors that lie one after another."""
        out = cls.__new__(cls)
        out._build(sizes, term, weight, n_terms, block)
        return out

    def _build(self, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, block: int) -> None:
        # On the driver, so what is held besides the index is kept small: the matrix is filled vector by vector, and all else is for the postings outside it.
        self.n, self.block, self.n_blocks = len(sizes), block, -(-len(sizes) // block)
        dense = np.bincount(term, minlength=n_terms) * DENSE > self.n
        self.column = np.where(dense, np.cumsum(dense) - 1, -1).astype(np.int32)
        self.matrix = np.zeros((int(dense.sum()), self.n_blocks * block))
        ends = np.cumsum(sizes)
        for i, (start, end) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            own = term[start:end]
            full = dense[own]
            self.matrix[self.column[own[full]], i] = weight[start:end][full]
        light = ~dense[term]
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[light]
        term, weight = term[light], weight[light]
        del light
        order = np.argsort(term, kind="stable")
        self.owner, self.weight, term = self.owner[order], weight[order], term[order]
        del order, weight
        # A cell is the postings of a term in a block.
        where = self.owner // block
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (where[1:] != where[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.cell_block, self.cell_start = where[new], np.append(new, len(term)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.cells = np.searchsorted(term[new], np.arange(n_terms + 1, dtype=np.int32)).astype(np.int32)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k largest positive cosines, ties to the smaller number."""
        return next(self.nearest_of(np.array([0]), terms, weights, k))

    def nearest_of(self, start: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`nearest` for each of several queries, the terms of which begin at ``start``."""
        ends = np.append(start, len(terms))
        column = self.column[terms]
        for first in range(0, len(start), QUERIES_AT_ONCE):
            part = ends[first : first + QUERIES_AT_ONCE + 1]
            inside = slice(part[0], part[-1])
            query, dense = np.repeat(np.arange(len(part) - 1), np.diff(part)), column[inside] >= 0
            wanted = np.zeros((len(part) - 1, len(self.matrix)))
            wanted[query[dense], column[inside][dense]] = weights[inside][dense]
            scores = wanted @ self.matrix
            for q in range(len(part) - 1):
                own = slice(part[q], part[q + 1])
                light = column[own] < 0
                yield self._best(scores[q], terms[own][light], weights[own][light], k)

    def _best(self, score: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the dense terms' scores with the other terms' added."""
        cells, n = _ranges(self.cells[terms], self.cells[terms + 1])
        if len(cells):
            weight, block = np.repeat(weights, n), self.cell_block[cells]
            if self.n > k:
                # What a block can still reach against what k owners have already.
                reach = score.reshape(-1, self.block).max(1) + np.bincount(block, self.most[cells] * weight, self.n_blocks)
                alive = (reach >= np.partition(score[: self.n], self.n - k)[self.n - k] - 1e-9)[block]
                cells, weight = cells[alive], weight[alive]
            posts, n = _ranges(self.cell_start[cells], self.cell_start[cells + 1])
            score += np.bincount(self.owner[posts], self.weight[posts] * np.repeat(weight, n), len(score))
        score = np.round(score[: self.n], 12)
        ids = np.flatnonzero(score > 0)
        if len(ids) > k:
            ids = ids[score[ids] >= np.partition(score[ids], len(ids) - k)[len(ids) - k]]
        ids = ids[np.lexsort((ids, -score[ids]))[:k]]
        return ids, score[ids]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function that fits y best: mean x and y of each pooled block."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            a2, b2, n2 = pools.pop()
            a1, b1, n1 = pools.pop()
            n = n1 + n2
            pools.append([(a1 * n1 + a2 * n2) / n, (b1 * n1 + b2 * n2) / n, n])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


@dataclass
class Model:
    terms: Terms
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    index: BlockMaxIndex | None  # in tasks alone
    prior: float
    empty_score: float
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    get: Callable[[], Model] | None = None  # the model in tasks, but for its knots

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        return float(((cosines * self.toxic[ids]).sum() + SMOOTHING * self.prior) / (cosines.sum() + SMOOTHING))

    def calibrated(self, vote: float) -> float:
        fitted = float(np.interp(vote, *self.knots)) if len(self.knots[0]) else vote
        return min(1.0, max(0.0, 0.9 * fitted + 0.1 * vote))

    def neighbours(self, start: np.ndarray, terms: np.ndarray, times: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of texts whose terms begin at ``start``."""
        w = (1 + np.log(times)) * self.idf[terms]
        norm = np.sqrt(np.add.reduceat(w * w, start)) if len(start) else np.zeros(0)
        return self.index.nearest_of(start, terms, w / np.repeat(norm, np.diff(np.append(start, len(terms)))), k)

    def score(self, ids: np.ndarray, cosines: np.ndarray) -> tuple[float, list]:
        if not len(ids):
            return self.empty_score, []
        near = [{"doc_id": int(self.ids[i]), "cosine": float(c), "toxic": int(self.toxic[i])} for i, c in zip(ids[:EVIDENCE], cosines[:EVIDENCE], strict=True)]
        return self.calibrated(self.vote(ids, cosines)), near


def learnable(id_col: str = "doc_id"):
    """True for the rows that labels may be learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _own_votes(get: Callable[[], Model]):
    """The examples (doc_id, text) to their numbers in the index and the votes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        for batch in batches:
            number, votes = np.searchsorted(model.ids, batch.column(0).to_numpy()), []
            for first, _, data, offsets in pieces(batch.column(1), PIECE):
                rows, terms, times = model.terms.counts(data, offsets)
                start = np.flatnonzero(np.diff(rows, prepend=-1))
                for k, (ids, cosines) in zip(number[first + rows[start]].tolist(), model.neighbours(start, terms, times, NEIGHBOURS + 1), strict=True):
                    other = ids != k
                    votes.append((k, model.vote(ids[other][:NEIGHBOURS], cosines[other][:NEIGHBOURS])))
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in votes], pa.int64()), pa.array([v[1] for v in votes], pa.float64())], ["number", "vote"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_examples: int = MAX_EXAMPLES, max_features: int = MAX_FEATURES) -> Model:
    """A model from the labels (doc_id, toxic) of the learnable documents; without any, every score is the prior.

    One example per text: its id is the smallest, and it is toxic if any of
    its documents is. Examples are a bounded sample: ``max_examples`` of them,
    as long as they have ``max_features`` features together, each example's
    distinct ones counted; one with a twentieth of that alone is passed over.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    given = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("toxic").cast("int").alias("toxic")).filter("of is not null and toxic in (0, 1)").filter(learnable("of"))
    chosen = given.groupBy("of").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("of"), "of").limit(max_examples)
    # At most max_examples rows of 12 bytes: a broadcast of proven size.
    examples = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    # Rows that repeat an id with other texts: the one with the smallest text.
    stored = written(examples.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("x")).select("doc_id", "x.text", "x.toxic"), "examples")
    examples = stored
    features_of = written(examples.mapInArrow(_feature_lists, "doc_id long, toxic int, features array<long>, times array<int>").withColumn("size", F.size("features")), "features")
    # One window over max_examples rows of 12 bytes at most, and as many ids to all tasks.
    upto = F.sum(F.col("size").cast("long")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))
    taken = written(features_of.filter(F.col("size") <= max_features * LARGEST).select("doc_id", upto.alias("upto")).filter(F.col("upto") <= max_features).select(F.col("doc_id").alias("of")), "taken")
    lists, examples = (df.join(F.broadcast(taken), F.col("doc_id") == F.col("of"), "left_semi") for df in (features_of, examples))
    # max_features numbers at most.
    rows = lists.drop("size").toArrow()
    ids = rows["doc_id"].to_numpy()
    order = np.argsort(ids)
    rows, ids = rows.take(order), ids[order]
    toxic = rows["toxic"].to_numpy().astype(np.int64)
    n, n_toxic = len(ids), int(toxic.sum())
    prior, rate = ((n_toxic + 0.5) / (n + 1), n_toxic / n) if n else (0.0, 0.0)
    size = pc.list_value_length(rows["features"]).to_numpy().astype(np.int64)
    times = pc.list_flatten(rows["times"]).to_numpy()
    features = pc.list_flatten(rows["features"]).to_numpy().view(np.uint64)
    del rows
    hashes = np.unique(features)
    term = np.searchsorted(hashes, features).astype(np.int32)
    del features
    terms = Terms(hashes)
    seen = texts.select("text").mapInArrow(_document_counts(sent(spark, terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow() if len(hashes) else None
    frequency = np.zeros(len(hashes) + 1)  # the last, term -1, is the number of documents
    if seen is not None:
        frequency[seen["term"].to_numpy()] = seen["n"].to_numpy()
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    if 0 < rate < 1:
        held = np.bincount(term, minlength=len(hashes))
        usual = held * rate
        idf *= np.sqrt(1 + (np.bincount(term, np.repeat(toxic, size), len(hashes)) - usual) ** 2 / usual / (1 - rate) * n / (n - held + 0.5))
    full = np.flatnonzero(size)
    none = toxic[size == 0].tolist()
    model = Model(terms, idf, ids[full], toxic[full], None, prior, (sum(none) + prior) / (len(none) + 1))
    # Once it is sent the index is of no more use here.
    index = BlockMaxIndex.of(size[full], term, _unit_weights(term, times, idf, size[full]), max(1, len(hashes)))
    del term, times
    model.get = sent(spark, replace(model, index=index))
    del index
    if len(full):
        # One number for each of max_examples rows.
        votes = examples.select("doc_id", "text").mapInArrow(_own_votes(model.get), "number long, vote double").toArrow()
        model.knots = isotonic(votes["vote"].to_numpy(), model.toxic[votes["number"].to_numpy()].astype(float))
    for table in (stored, features_of, taken):
        dropped(table)
    return model


def scores(model: Model):
    """A function of a text column: struct(score, evidence), evidence being the nearest examples."""
    get, knots = model.get, model.knots
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    @F.arrow_udf("struct<score:double,evidence:array<struct<doc_id:long,cosine:double,toxic:int>>>")
    def score(text: pa.Array) -> pa.Array:
        own = get()
        own.knots = knots
        found = [(own.empty_score, [])] * len(text)
        for first, _, data, offsets in pieces(text, PIECE):
            rows, terms, times = own.terms.counts(data, offsets)
            start = np.flatnonzero(np.diff(rows, prepend=-1))
            for k, near in zip((first + rows[start]).tolist(), own.neighbours(start, terms, times, NEIGHBOURS), strict=True):
                found[k] = own.score(*near)
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], evidence)], ["score", "evidence"])

    return lambda text: score(F.col(text).cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, evidence.

    A null or empty text, or one without a term of the vocabulary, gets the
    rate of such examples. Labels other than 0 and 1 are ignored; of several
    for a document the larger counts; rows that repeat a text are one example,
    toxic if any is. Texts of any length are scored whole, word by word.
    Empty tables: empty result, or the prior, zero without labels, for all.
    Other columns, whatever their names, are not read.
    """
    score = scores(fit(docs, labels, id_col, text_col))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(text_col).alias("x"))
    return out.select("doc_id", (~learnable()).alias("held_out"), "x.score", (F.col("x.score") >= 0.5).cast("int").alias("predicted"), "x.evidence")
