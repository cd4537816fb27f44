"""Centroid clustering of integer vectors: exact rounds in which bounds, loosened by planar geometry, prove most assignments.

Every vector carries an upper bound of the distance to its centroid and a lower bound of that to any other one. When
centroids move, the upper bound grows by its own centroid's way. The lower one falls by less than the longest way of
the others: a cluster is a sphere around its old centroid, and of a moved centroid only the part of its way matters
that leads towards the sphere (:func:`loosening`). A vector whose bounds still do not meet keeps its cluster without
being looked at; one whose bounds meet is measured exactly, in integers. The margin between the two kinds covers the
rounding of the bounds, so results are those of exhaustive rounds.

Vectors are packed into blocks of one Arrow batch and written once, bucketed by block; the state of a round is one small
row a block. So a round reads the vectors where they lie and shuffles only the state. What reaches the driver is k
centroids and their sums.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import released, shared_dir, small_batches, written
from apiloom.sources.shared import OWN

#: Integers beyond this would let a squared distance leave 64 bits.
LARGEST = 1 << 27
#: Up to this, sums of 64 products are exact in doubles.
EXACT_IN_DOUBLES = 1 << 23
MARGIN = 1e-9

_STATE = "block long, cluster binary, upper binary, lower binary, count_change array<long>, sum_change array<long>, radius array<double>, n_scanned long"
_FOUND = "vec_id long, cluster int, distance long"


@dataclass(frozen=True)
class Move:
    """Centroids after a move, and what it does to the bounds of each cluster's vectors."""

    centroids: np.ndarray
    way: np.ndarray
    loosening: np.ndarray


def integer_vectors(embeddings: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of vectors of ``size`` finite components; others take no part.

    Neither do vectors with a component of 2**27 or more after scaling, whose squared distances would not fit 64 bits.
    """
    whole = F.transform("embedding", lambda x: x.cast("double") * scale)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x")).where(F.size("x") == size)
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ``seed:vec_id`` has the smallest SHA-256, in that order; ids that are null come last."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(code.asc_nulls_last(), "v").select("v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer, at most, any other centroid has come to a vector of each cluster.

    Points that a centroid has come nearer to by t lie within one branch of a hyperbola whose foci are its old and new
    place, so within the cone of half-angle arccos(t / way) around its way, with the apex in the middle. In the plane
    of that axis and a cluster's centre, the sphere's least angle to the axis thus gives the largest possible t.
    """
    middle, axis = (old + new) / 2.0, (new - old).astype(float)
    way = np.linalg.norm(axis, axis=1)
    to = old[:, None, :] - middle[None, :, :]
    far = np.linalg.norm(to, axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((to * axis[None]).sum(2) / (far * way[None]), -1, 1)) - np.arcsin(np.clip(radius[:, None] / far, 0, 1))
    nearer = np.where(radius[:, None] >= far, way[None], way[None] * np.cos(np.clip(angle, 0, np.pi / 2)))
    nearer = np.where(way[None] > 0, nearer, 0.0)
    np.fill_diagonal(nearer, 0.0)
    return nearer.max(axis=1) * (1 + MARGIN)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact, in 64-bit integers."""
    fits = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_IN_DOUBLES
    products = (x.astype(float) @ centroids.T.astype(float)).astype(np.int64) if fits else x @ centroids.T
    return (x * x).sum(1)[:, None] - 2 * products + (centroids * centroids).sum(1)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> int:
    """Bring a block's state to the moved centroids, in place; returns how many vectors were measured against all of them."""
    known = cluster >= 0
    upper[known] += move.way[cluster[known]]
    lower[known] -= move.loosening[cluster[known]]
    scale = np.sqrt((move.centroids.astype(float) ** 2).sum(1)).max() + move.way.max()

    def open_(of: np.ndarray) -> np.ndarray:
        return of[(cluster[of] < 0) | (upper[of] + MARGIN * (upper[of] + np.where(np.isfinite(lower[of]), np.abs(lower[of]), 0) + scale) >= lower[of])]

    rows = open_(np.arange(len(x)))
    again = rows[cluster[rows] >= 0]
    gap = x[again] - move.centroids[cluster[again]]
    upper[again] = np.sqrt((gap * gap).sum(1).astype(float))
    rows = open_(rows)
    if len(rows):
        d = squared_distances(x[rows], move.centroids)
        best = d.argmin(1)
        cluster[rows], upper[rows] = best, np.sqrt(d[np.arange(len(rows)), best].astype(float))
        d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        lower[rows] = np.sqrt(d.min(1).astype(float)) if d.shape[1] > 1 else np.inf
    return len(rows)


def in_blocks_of(vectors: DataFrame, size: int) -> DataFrame:
    """(block, ids array<long>, vectors binary): a row for each Arrow batch, in a table bucketed by block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(b for b in batches if b.num_rows):
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i4")
            yield pa.RecordBatch.from_pydict({"block": pa.array([task + n], pa.int64()), "ids": pa.array([batch.column("vec_id").to_pylist()], pa.list_(pa.int64())), "vectors": pa.array([x.tobytes()], pa.binary())})

    spark = vectors.sparkSession
    name = f"apiloom_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = vectors.mapInArrow(pack, "block long, ids array<long>, vectors binary").repartition(parts, "block")
    packed.write.bucketBy(parts, "block").option("path", f"{shared_dir(spark).rstrip('/')}/{OWN}{name}").saveAsTable(name)
    return spark.table(name)


def _stepper(size: int, k: int, move: Move, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The state of each block after a move, with what it changes in the sums; the last step gives the vectors' rows."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: batch.column(c)[i] for c in batch.schema.names}
                x = np.frombuffer(at["vectors"].as_py(), "<i4").reshape(-1, size).astype(np.int64)
                if at["cluster"].is_valid:
                    cluster, upper, lower = (np.frombuffer(at[c].as_py(), t).copy() for c, t in (("cluster", "<i4"), ("upper", "<f8"), ("lower", "<f8")))
                else:
                    cluster, upper, lower = np.full(len(x), -1, "<i4"), np.full(len(x), np.inf), np.zeros(len(x))
                before = cluster.copy()
                n_scanned = assign(x, cluster, upper, lower, move)
                if last:
                    gap = x - move.centroids[cluster]
                    yield pa.RecordBatch.from_arrays([at["ids"].values.cast(pa.int64()), pa.array(cluster, pa.int32()), pa.array((gap * gap).sum(1), pa.int64())], ["vec_id", "cluster", "distance"])
                    continue
                moved = np.flatnonzero(before != cluster)
                counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
                for ends, sign in ((cluster[moved], 1), (before[moved], -1)):
                    there = ends >= 0
                    np.add.at(counts, ends[there], sign)
                    np.add.at(sums, ends[there], sign * x[moved[there]])
                radius = np.zeros(k)
                np.maximum.at(radius, cluster, upper)
                row = {"block": at["block"].as_py(), "cluster": cluster.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "count_change": counts.tolist(), "sum_change": sums.ravel().tolist(), "radius": radius.tolist(), "n_scanned": n_scanned}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("count_change", pa.list_(pa.int64())), ("sum_change", pa.list_(pa.int64())), ("radius", pa.list_(pa.float64())), ("n_scanned", pa.int64())]))

    return step


def _totals(state: DataFrame, column: str, how: Callable) -> list:
    rows = state.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(how("x").alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.at)]


def cluster_vectors(embeddings: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Centroids begin as the k vectors of :func:`first_centroids` (all, if there are fewer). Each round assigns every
    vector to the nearest centroid (ties: smaller number) and replaces every non-empty one by the componentwise
    floor of its vectors' mean; then vectors are assigned once more. Rounds end early only when no centroid moves, as
    then nothing would change. ``report`` is called with each round's number and the vectors measured against all
    centroids in it.

    Null vectors, other lengths, null or non-finite components take no part; repeated rows each count, and equal
    ids give equal rows; a null vec_id stays null. Without a vector that takes part the result is empty.
    """
    spark: SparkSession = embeddings.sparkSession
    small_batches(spark)
    vectors = integer_vectors(embeddings, size, scale)
    centroids = first_centroids(vectors, k, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], f"{_FOUND}, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = in_blocks_of(vectors, size)
    counts, sums = [0] * k, [[0] * size for _ in range(k)]
    move, state = Move(centroids, np.zeros(k), np.zeros(k)), None

    def joined(*columns: str) -> DataFrame:
        if state is None:
            return blocks.select("block", *columns, *[F.lit(None).cast("binary").alias(c) for c in ("cluster", "upper", "lower")])
        return blocks.select("block", *columns).join(state.select("block", "cluster", "upper", "lower"), "block")

    for n in range(rounds):
        before, state = state, written(joined("vectors").mapInArrow(_stepper(size, k, move, False), _STATE))
        if before is not None:
            released(before)
        if report:
            report(n, state.agg(F.sum("n_scanned")).first()[0])
        counts = [a + b for a, b in zip(counts, _totals(state, "count_change", F.sum), strict=True)]
        change, radius = _totals(state, "sum_change", F.sum), np.array(_totals(state, "radius", F.max))
        sums = [[a + b for a, b in zip(row, change[i * size : (i + 1) * size], strict=True)] for i, row in enumerate(sums)]
        old = move.centroids
        new = np.array([[s // c for s in row] if c else old[i].tolist() for i, (row, c) in enumerate(zip(sums, counts, strict=True))], np.int64)
        move = Move(new, np.linalg.norm((new - old).astype(float), axis=1) * (1 + MARGIN), loosening(old, new, radius * (1 + MARGIN)))
        if (new == old).all():
            break
    found = written(joined("ids", "vectors").mapInArrow(_stepper(size, k, move, True), _FOUND))
    if state is not None:
        released(state)
    released(blocks)
    spark.sql(f"DROP TABLE {blocks.inputFiles()[0].rsplit('/', 2)[-2].removeprefix(OWN)}")
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of = lambda values, kind: F.element_at(F.lit(values), F.col("cluster") + 1).cast(kind)
    codes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in move.centroids.tolist()]
    return found.withColumns({"cluster_inertia": of([inertia.get(i, 0) for i in range(k)], "long"), "inertia": F.lit(sum(inertia.values())).cast("long"), "centroid_sha256": of(codes, "string")})


def clustering_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rows in SQL for DuckDB, a common table expression for each round."""
    nearest = "arg_min(c.i, {d} * 1000 + c.i)"
    d = "CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS i, v AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED (SELECT v.r, {nearest.format(d=d)} AS i FROM v, c{n} c GROUP BY v.r)")
        parts.append(f"s{n} AS MATERIALIZED (SELECT i, list(m ORDER BY p) AS c FROM (SELECT a.i, p, CAST(floor(sum(v.v[p])::HUGEINT / count(*)) AS BIGINT) AS m FROM v JOIN a{n} a ON v.r = a.r, range(1, {size + 1}) AS t(p) GROUP BY a.i, p) GROUP BY i)")
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.i, coalesce(s.c, c.c) AS c FROM c{n} c LEFT JOIN s{n} s ON c.i = s.i)")
    parts.append(f"f AS (SELECT v.r, any_value(v.vec_id) AS vec_id, {nearest.format(d=d)} AS i, min({d}) AS distance FROM v, c{rounds} c GROUP BY v.r)")
    sql = "WITH " + ",\n".join(parts)
    return sql + f"""
        SELECT f.vec_id, CAST(f.i AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY f.i) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM f JOIN c{rounds} c ON f.i = c.i"""
