"""Exact inner-product search over vectors grouped by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiloom.llm.common import small_batches, written

PAIRS_AT_ONCE = 2_000_000
#: Queries that the bucket of the longest vectors takes in one task; it is one bucket, so its copies are cheap.
OPENING_ROWS = 1024
#: Lengths are cut into so many bands at most; a larger band is split by a hash, so a bucket's size stays bounded.
MOST_BANDS = 256


def scaled_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>, norm2 double) of vectors without null or non-finite components; floor(scale * component)."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = vectors.select("vec_id", "embedding").where(usable & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def best_in_bucket(own: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, keys: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of one bucket that reach the query's bound: (query index, candidate index, score), ties to smaller ids.

    ``own`` and ``keys`` tell rows: a candidate whose key is the query's own takes no part.

    The candidates come by falling length. A query's local threshold bound / (|q| * longest) decides how it is pruned:
    a low one by length, to the candidates long enough to reach the bound; a high one by the query's largest
    coordinate too, outside whose range no vector of that cosine lies. What is left is verified by its product.
    """
    by_length = np.argsort(-np.einsum("ij,ij->i", p, p), kind="stable")
    ids, keys, p = ids[by_length], keys[by_length], p[by_length]
    length = np.sqrt(np.einsum("ij,ij->i", p, p))
    q_length = np.sqrt(np.einsum("ij,ij->i", q, q))
    longest = max(float(length[0]), 1e-12)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(q_length > 0, bound / q_length, np.where(bound <= 0, -np.inf, np.inf))
    reach = np.where(need > 0, np.searchsorted(-length, -(need * (1 - 1e-9)), "right"), len(p))
    local = need / longest
    block = max(1, PAIRS_AT_ONCE // max(1, len(p)))
    for at in range(0, len(q), block):
        rows = np.arange(at, min(at + block, len(q)))
        high = rows[(local[rows] > 0.9) & (reach[rows] > 64)]
        for i in high:  # few: their bound is close to what the bucket can give at all
            f = int(np.argmax(np.abs(q[i])))
            n = int(reach[i])
            unit, cosine = abs(q[i, f]) / q_length[i], np.minimum(1, need[i] / np.maximum(length[:n], 1e-12))
            least = unit * cosine - np.sqrt(max(0.0, 1 - unit * unit)) * np.sqrt(np.maximum(0, 1 - cosine * cosine))
            close = np.flatnonzero(np.sign(q[i, f]) * p[:n, f] >= least * length[:n] - 1e-6 * longest)
            out.append(_top(np.full(1, i), p[close] @ q[i][:, None], close, ids, keys, own, bound, k))
        rest = np.setdiff1d(rows, high, assume_unique=True)
        n = int(reach[rest].max(initial=0))
        if len(rest) and n:
            out.append(_top(rest, p[:n] @ q[rest].T, np.arange(n), ids, keys, own, bound, k))
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    at, found, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else empty
    return at, by_length[found], score


def _top(rows: np.ndarray, scores: np.ndarray, near: np.ndarray, ids: np.ndarray, keys: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """scores: candidates ``near`` by queries ``rows``, whole numbers held exactly in doubles."""
    order = np.argsort(ids[near], kind="stable")
    near, scores = near[order], scores[order]
    scores = np.where(keys[near][:, None] == own[rows][None, :], -np.inf, scores)
    scores = np.where(scores < bound[rows][None, :], -np.inf, scores)
    if len(near) > k:
        floor = -np.partition(-scores, k - 1, axis=0)[k - 1]
        above = scores > floor
        tied = (scores == floor) & np.isfinite(scores)
        take = above | (tied & (np.cumsum(tied, axis=0) <= k - above.sum(axis=0)))
    else:
        take = np.isfinite(scores)
    c, r = np.nonzero(take)
    return rows[r], near[c], scores[c, r].astype(np.int64)


def _matrix(rows: pa.RecordBatch | pa.Table, dims: int) -> np.ndarray:
    v = rows.column("v")
    flat = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, dims)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, bucket_rows: int = 4096, query_rows: int = 1 << 18) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; every row but the query's own is a candidate.

    Candidates are dealt into length buckets of about ``bucket_rows`` vectors (range partitions by length, equal
    lengths split by a hash). First each query meets the bucket of the longest vectors, which gives it a
    bound; then it goes only to buckets whose longest vector can reach that bound, |q| * |p| >= bound, and is
    pruned there by length or coordinate. All products that count are computed exactly, so nothing is lost.

    A task holds one bucket and its queries stream past it in batches, so a bucket is read once for every ``query_rows``
    queries (a second copy halves what one task has to do) and memory depends on the bucket alone. What grows with the
    square of the vectors, where lengths do not prune, is the queries sent: one row for each bucket they may reach.

    Vectors that are null or hold null, NaN or infinite components, and rows without an id, take no part. Repeated rows
    count each: equal rows are searched once and counted, a candidate that occurs twice takes two ranks, a query that
    occurs twice is answered twice, and its twin is a candidate of it. So are rows of the query's id with another
    vector. Vectors of another length than most are compared only with their like, and those without components with
    none. With fewer than k candidates all are returned. An empty table gives none.
    """
    small_batches(vectors.sparkSession)
    rows = scaled_vectors(vectors, scale).where(F.size("v") > 0).groupBy("vec_id", "v", "norm2").agg(F.count("*").alias("copies"))
    rows = written(rows.select("*", F.xxhash64("vec_id", "v").alias("row")))
    n, least, most = rows.agg(F.count("*"), F.min("norm2"), F.max("norm2")).first()
    buckets = min(MOST_BANDS, max(1, -(-n // bucket_rows)))
    cuts = [] if buckets == 1 else sorted(set(rows.approxQuantile("norm2", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    band = F.lit(0)
    if cuts:
        band = F.array_size(F.filter(F.lit(cuts), lambda c: c < F.col("norm2")))
    dealt = rows.select("vec_id", "row", "copies", "v", "norm2", F.size("v").alias("dims"), band.cast("int").alias("band"))
    sizes = dealt.groupBy("dims", "band").agg(F.count("*").alias("rows_in"), F.max("norm2").alias("longest"))
    sizes = written(sizes.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rows_in") / (2 * bucket_rows))).cast("int")))
    place = ["dims", "band", "part"]
    candidates = written(dealt.join(sizes.select("dims", "band", "parts"), ["dims", "band"]).withColumn("part", F.pmod("row", F.col("parts")).cast("int")))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "row", F.col("copies").alias("asked"), "v", "norm2", F.size("v").alias("dims"))

    def blocks(of: int) -> int:
        return max(1, -(-n // (every * of)))

    def search(wanted: DataFrame, within: DataFrame, copies: int) -> DataFrame:
        """(query_id, own, asked, vec_id, copies, score). wanted: queries with the place that each goes to, and its bound so far."""

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, bucket = None, [], None
            for batch in batches:
                told = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*place, "block", "asks")])
                starts = np.concatenate(([0], 1 + np.flatnonzero((told[:, 1:] != told[:, :-1]).any(axis=0)))) if batch.num_rows else []
                for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                    *at, asks = told[:, a].tolist()
                    if at != key:
                        key, held, bucket = at, [], None
                    part = batch.slice(a, b - a)
                    if not asks:
                        held.append(part)
                        continue
                    if not held:
                        continue
                    if bucket is None:
                        rows = pa.Table.from_batches(held)
                        bucket = rows, *(rows.column(c).to_numpy() for c in ("id", "row")), _matrix(rows, at[0])
                    rows, ids, keys, p = bucket
                    own = part.column("row").to_numpy()
                    q, found, score = best_in_bucket(own, _matrix(part, at[0]), part.column("bound").to_numpy(), ids, keys, p, k)
                    if len(q):
                        yield pa.RecordBatch.from_arrays(
                            [*(part.column(c).take(pa.array(q)) for c in ("id", "row", "copies")), *(rows.column(c).take(pa.array(found)).combine_chunks() for c in ("id", "copies")), pa.array(score)],
                            ["query_id", "own", "asked", "vec_id", "copies", "score"],
                        )

        block = F.pmod(F.xxhash64("row"), F.lit(copies)).cast("int").alias("block")
        asked = wanted.select(*place, block, F.lit(1).alias("asks"), F.col("query_id").alias("id"), "row", F.col("asked").alias("copies"), "v", "bound")
        each = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("block")
        given = within.select(*place, each, F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "row", "copies", "v", F.lit(0.0).alias("bound"))
        dealt = given.unionByName(asked).repartition(*place, "block").sortWithinPartitions(*place, "block", "asks")
        return dealt.mapInArrow(meet, "query_id long, own long, asked long, vec_id long, copies long, score long")

    first = sizes.groupBy("dims").agg(F.max_by("band", F.struct("longest", "band")).alias("band"))
    opening = queries.join(first, "dims").select(*queries.columns, "band", F.lit(0).alias("part"), F.lit(float("-inf")).alias("bound"))
    longest = candidates.join(first, ["dims", "band"], "left_semi").where("part = 0")
    started = written(search(opening, longest, blocks(OPENING_ROWS)))
    bounds = started.groupBy("query_id", "own").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.col("own").alias("row"), F.when(F.size("s") >= k, F.element_at("s", k).cast("double")).alias("known"))
    rest = queries.join(bounds, ["query_id", "row"], "left").withColumn("bound", F.coalesce("known", F.lit(float("-inf"))))
    reach = F.sqrt("norm2") * F.sqrt("longest") * (1 + 1e-9)
    opened = first.select("dims", F.col("band").alias("opened"))
    rest = rest.join(sizes.drop("rows_in"), "dims").join(opened, "dims").where(reach >= F.col("bound"))
    rest = rest.select(*queries.columns, "bound", "band", "opened", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).where("band <> opened or part <> 0")
    twins = queries.where("asked > 1").select("query_id", F.col("row").alias("own"), "asked", F.col("query_id").alias("vec_id"), (F.col("asked") - 1).alias("copies"), F.col("norm2").cast("long").alias("score"))
    found = started.unionByName(search(rest, candidates, blocks(query_rows))).unionByName(twins)
    # More than k copies of one row never rank.
    counted = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "asked"))).select("query_id", "rank", "vec_id", "score")
