"""Factorization machines over hashed text features: bounded fitting, scoring on the executors."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiloom.llm.common import released, small_batches, written

BUCKETS = 1 << 20
CACHED_WORDS = 500_000
LEAST_STEPS = 250


class Features(Protocol):
    """Hashed features of a text, each named once; ``alone`` leaves out those that only repeat another (a word's beginnings)."""

    def __call__(self, text: str) -> np.ndarray: ...

    def alone(self, text: str) -> np.ndarray: ...


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


class FactorizationMachine:
    """P(label 1) = sigmoid(b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the features present."""

    def __init__(self, terms: np.ndarray, rank: int) -> None:
        self.terms = np.sort(terms)
        self.bias = 0.0
        self.weights = np.zeros(len(terms))
        self.factors = np.random.default_rng(7).normal(0, 0.01, (len(terms), rank))

    def columns(self, features: np.ndarray) -> np.ndarray:
        """Positions of the model's own terms among a text's features."""
        if not len(self.terms) or not len(features):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, features), len(self.terms) - 1)
        return at[self.terms[at] == features]

    def margins(self, rows: np.ndarray, columns: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of ``n`` texts, given (row, column) of each feature present, and each text's factor sums."""
        v = self.factors[columns]
        sums = np.column_stack([np.bincount(rows, v[:, f], n) for f in range(v.shape[1])]) if n else np.zeros((0, v.shape[1]))
        squares = np.bincount(rows, (v * v).sum(axis=1), n)
        return self.bias + np.bincount(rows, self.weights[columns], n) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows, columns, n)[0], -30, 30)))

    def fit(self, rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, epochs: int, l2: float, step: float, batch: int = 512) -> None:
        """Adam on batches of the bounded sample, at least LEAST_STEPS of them. ``rows`` is sorted."""
        n, m, rank = len(labels), len(self.terms), self.factors.shape[1]
        rate = (labels.sum() + 0.5) / (n + 1)
        self.bias = math.log(rate / (1 - rate))
        begin = np.searchsorted(rows, np.arange(n + 1))
        rng = np.random.default_rng(3)
        state = [[np.zeros(s), np.zeros(s)] for s in (1, m, (m, rank))]
        values = [np.array([self.bias]), self.weights, self.factors]
        t = 0
        for _ in range(max(epochs, -(-LEAST_STEPS // -(-n // batch)))):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                t += 1
                chosen = order[at : at + batch]
                size = begin[chosen + 1] - begin[chosen]
                own = np.repeat(np.arange(len(chosen)), size)
                c = columns[np.repeat(begin[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                raw, sums = self.margins(own, c, len(chosen))
                off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
                slope = off[own][:, None] * (sums[own] - self.factors[c])
                grads = [
                    np.array([off.sum()]),
                    np.bincount(c, off[own], m) + l2 * self.weights,
                    np.column_stack([np.bincount(c, slope[:, f], m) for f in range(rank)]) + 10 * l2 * self.factors,
                ]
                for (first, second), grad, value in zip(state, grads, values, strict=True):
                    first += 0.1 * (grad - first)
                    second += 0.01 * (grad * grad - second)
                    value -= step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
                self.bias = float(values[0][0])


@dataclass(frozen=True)
class FitLimits:
    """What fitting may hold: sampled labelled rows; terms of the model by their own lift, and pairs.

    Pairs are sought among all terms that at least ``least_rows`` sampled rows and ``least_share`` of them have. Memory
    bounds these to ``pair_terms`` (the most common ones), far beyond what the share leaves of natural texts.
    """

    max_rows: int = 20_000
    max_terms: int = 4_096
    least_z: float = 3.5
    least_rows: int = 10
    least_share: float = 0.005
    pair_terms: int = 1 << 15
    max_pairs: int = 4_096
    least_pair_z: float = 6.0
    rank: int = 8
    epochs: int = 15
    l2: float = 5e-6
    step: float = 0.03


#: Terms of which a task counts all pairs with as many others.
BLOCK_TERMS = 1_024
#: Rows of a block that are unpacked to numbers at once; the counts of such parts are whole numbers and add up exactly.
ROWS_AT_ONCE = 2_048


def telling_pairs(rows: DataFrame, p: np.ndarray, n: np.ndarray, terms: np.ndarray, base: float, limits: FitLimits) -> list[int]:
    """Terms of the pairs whose labels depart most from what both terms tell by themselves.

    ``rows`` (y, alone) is the sample, ``base`` its log odds; ``terms`` is sorted; p and n count the rows of label 1 and 0
    with each. The sample becomes a matrix of bits (at most max_rows x pair_terms, so it may be broadcast); a task
    takes two blocks of terms and counts the rows with both terms of each pair by a matrix product. A pair's rows are
    expected to have the log odds of the base, moved by what either term moves it; what stands ``least_pair_z``
    deviations away (root of the deviance, which holds for small counts too) is taken, the strongest ``max_pairs``.
    """
    k = len(terms)
    if k < 2:
        return []

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for found in batch.column("alone").to_pylist():
                at = np.minimum(np.searchsorted(terms, found), k - 1)
                row = np.zeros(k, bool)
                row[at[terms[at] == found]] = True
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(bits, pa.binary())], ["y", "bits"])

    spark = rows.sparkSession
    got = rows.select("y", "alone").mapInArrow(packed, "y int, bits binary").toArrow()
    y, width = got.column("y").to_numpy(), -(-k // 8)
    matrix = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(len(y), width)
    shared = spark.sparkContext.broadcast((matrix, y == 1))
    lift = np.log((p + 0.5) / (n + 0.5))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, positive = shared.value

        def unpacked(begin: int, at: int) -> np.ndarray:
            bits = np.unpackbits(matrix[at : at + ROWS_AT_ONCE, begin // 8 : (begin + BLOCK_TERMS) // 8], axis=1)
            return bits[:, : max(0, min(BLOCK_TERMS, k - begin))].astype(np.float32)

        def counted(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            both = ones = np.zeros((min(BLOCK_TERMS, k - i), min(BLOCK_TERMS, k - j)), np.float32)
            for at in range(0, len(matrix), ROWS_AT_ONCE):
                x, z, hit = unpacked(i, at), unpacked(j, at), positive[at : at + ROWS_AT_ONCE]
                both, ones = both + x.T @ z, ones + x[hit].T @ z[hit]
            return both.astype(float), ones.astype(float)

        for batch in batches:
            for i, j in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True):
                both, ones = counted(i, j)
                a, b = np.nonzero((both >= limits.least_rows) & (i + np.arange(both.shape[0])[:, None] < j + np.arange(both.shape[1])[None]))
                both, ones, a, b = both[a, b], ones[a, b], a + i, b + j
                # Of terms that nearly always come together the pair tells nothing new.
                own = both < 0.9 * np.minimum(p[a] + n[a], p[b] + n[b])
                both, ones, a, b = both[own], ones[own], a[own], b[own]
                q = 1 / (1 + np.exp(-np.clip(lift[a] + lift[b] - base, -30, 30)))
                part = lambda seen, awaited: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(awaited, 1e-12)), 0.0)
                deviance = np.sqrt(2 * np.maximum(part(ones, both * q) + part(both - ones, both * (1 - q)), 0))
                far = np.flatnonzero(deviance >= limits.least_pair_z)
                far = far[np.argsort(-deviance[far], kind="stable")[: limits.max_pairs]]
                yield pa.RecordBatch.from_arrays([pa.array(terms[a[far]]), pa.array(terms[b[far]]), pa.array(deviance[far])], ["a", "b", "z"])

    begins = list(range(0, k, BLOCK_TERMS))
    blocks = spark.createDataFrame([(i, j) for i in begins for j in begins if i <= j], "i int, j int")
    found = blocks.repartition(min(64, len(begins) * (len(begins) + 1) // 2)).mapInArrow(judged, "a long, b long, z double")
    best = found.orderBy(F.desc("z"), "a", "b").limit(limits.max_pairs).collect()
    shared.unpersist()
    return [t for r in best for t in (r.a, r.b)]


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, make: Callable[[], Features], limits: FitLimits) -> FactorizationMachine:
    """Fit on at most ``limits.max_rows`` labelled documents: those whose id has the least hash, of the rows ``train`` holds for.

    The sample is bounded, so it may be broadcast. Features of the whole texts are made and counted on the executors. A
    term enters the model for its own lift (a log odds ratio ``least_z`` deviations from zero, at most ``max_terms``) or
    for that of a pair (see :func:`telling_pairs`), so words that tell something only together are met as well. What the
    driver gets is the sample reduced to these terms.
    """
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(train & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits.max_rows)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "y")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = make()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array([of(t) for t in texts], pa.list_(pa.int32())) for of in (features, features.alone))], ["y", "terms", "alone"])

    rows = written(sample.mapInArrow(featurize, "y int, terms array<int>, alone array<int>"))
    total = rows.agg(F.count(F.when(F.col("y") == 1, 1)).alias("p"), F.count(F.when(F.col("y") == 0, 1)).alias("n")).first()
    p, n = F.col("p") + 0.5, F.col("n") + 0.5
    other_p, other_n = F.lit(total.p) - F.col("p") + 0.5, F.lit(total.n) - F.col("n") + 0.5
    z = F.abs(F.log(p * other_n / (n * other_p))) / F.sqrt(1 / p + 1 / n + 1 / other_p + 1 / other_n)
    counted = written(rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).where(p + n > 3))
    own = [r.term for r in counted.where(z >= limits.least_z).orderBy(z.desc(), "term").limit(limits.max_terms).select("term").collect()]
    least = max(limits.least_rows, limits.least_share * (total.p + total.n))
    singles = rows.select(F.explode("alone").alias("term")).distinct()
    often = counted.where(F.col("p") + F.col("n") >= least).join(singles, "term", "left_semi")
    common = sorted(often.orderBy((p + n).desc(), "term").limit(limits.pair_terms).collect(), key=lambda r: r.term) if total.p and total.n else []
    paired = telling_pairs(rows, *(np.array([r[c] for r in common], float) for c in ("p", "n")), np.array([r.term for r in common], np.int64), math.log(total.p / total.n), limits) if common else []
    terms = sorted({*own, *paired})
    model = FactorizationMachine(np.array(terms, np.int64), limits.rank)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.columns(np.asarray(t, np.int64)) for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["y", "columns"])

    got = rows.mapInArrow(reduce, "y int, columns array<int>").toArrow()
    released(rows, counted)
    y = got.column("y").to_numpy().astype(float)
    lists = got.column("columns").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.array([], pa.list_(pa.int32()))
    columns = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    if len(y):
        model.fit(np.repeat(np.arange(len(y)), sizes), columns, y, limits.epochs, limits.l2, limits.step)
    return model


def score(docs: DataFrame, model: FactorizationMachine, make: Callable[[], Features], carry: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``carry`` (doc_id) of every row and its score, whole texts, without a shuffle. The model has a proven bound and is broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = carry or ["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fm = make(), shared.value
        for batch in batches:
            found = [fm.columns(features(t or "")) for t in batch.column("__text").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            columns = np.concatenate(found) if found else np.empty(0, np.int64)
            scores = pa.array(fm.scores(rows, columns.astype(np.int64), len(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), scores], [*carry, name])

    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(name, T.DoubleType())])
    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(each, schema)
