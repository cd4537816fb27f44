"""SimHash fingerprints, linked by Burkhard-Keller trees within shards that hold every close pair."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiloom.llm.common import small_batches, written
from apiloom.llm.components import connected_components

SHINGLE_SEED = 42
#: Six blocks of the 64 bits. Four differing bits touch four of them at most, so two always agree.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
FRONTIER = 1 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` lower-cased words; of the whole sequence if it is shorter."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SHINGLE_SEED)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SHINGLE_SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    if not len(hashes):
        return 0
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long): no shuffle. Null and blank texts have the fingerprint zero."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, fp long")


def _grow(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree for each group: parent and edge (its distance to the parent) of each member, and each member's root."""
    parent, edge = np.full(len(fp), -1, np.int64), np.zeros(len(fp), np.int64)
    left, cell = np.arange(len(fp)), group
    root = None
    while len(left):
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        head = np.repeat(left[first], np.diff(np.append(first, len(left))))
        root = head if root is None else root
        rest = np.ones(len(left), bool)
        rest[first] = False
        left, head = left[rest], head[rest]
        far = np.bitwise_count(fp[left] ^ fp[head]).astype(np.int64)
        parent[left], edge[left] = head, far
        order = np.argsort(head * 65 + far, kind="stable")
        left, cell = left[order], (head * 65 + far)[order]
    return parent, edge, root


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; label points to the least member known."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, jumped := label[label]):
            label[:] = jumped


def within(fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) of members of a group within the radius, both ways and each with itself, some at a time.

    ``group`` is sorted. Every member searches its group's tree, all members level by level, following only edges
    within the radius of its distance to the node.
    """
    parent, edge, root = _grow(fp, group)
    code = parent * 65 + edge
    order = np.argsort(code, kind="stable")
    code = code[order]
    sizes = np.bincount(np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]).astype(np.int64)))))
    per_query = np.repeat(sizes, sizes)
    cuts = np.searchsorted(np.cumsum(per_query), np.arange(FRONTIER, per_query.sum() + FRONTIER, FRONTIER), "left") + 1
    begin = 0
    for stop in np.minimum(cuts, len(fp)):
        query, node = np.arange(begin, stop), root[begin:stop]
        begin = max(begin, stop)
        while len(query):
            far = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
            near = far <= radius
            yield query[near], node[near]
            low = np.searchsorted(code, node * 65 + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(code, node * 65 + np.minimum(far + radius, 64), "right")
            n = high - low
            query = np.repeat(query, n)
            node = order[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]


def linked_within(fp: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For each member the least index in its group that a chain of links within the radius reaches. ``group`` is sorted."""
    label = np.arange(len(fp))
    for query, node in within(fp, group, radius):
        _union(label, query, node)
    return label


def fingerprint_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect what lies within ``radius``, from distinct (fp, rep) rows.

    A shard holds the fingerprints that agree in two of six blocks; each close pair meets in one at least. Shards are
    dealt by hash and each builds its own tree over its members, so no tree outgrows its shard and none is sent to
    every executor. A member gets one link to the least of its class in the shard, so a dense group of n fingerprints
    gives n links for a shard, not all pairs.
    """
    if radius > 4:
        raise ValueError("the shards hold every pair of up to four differing bits")
    keys = []
    for n, ((i, a), (j, b)) in enumerate(combinations(BLOCKS, 2)):
        part = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in ((i, a), (j, b))]
        keys.append((F.lit(n << 22) + part[0] * 2048 + part[1]).cast("long"))
    rows = fps.select(F.explode(F.array(*keys)).alias("shard"), "fp", "rep")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
            shard, fp, rep = (np.concatenate(c) for c in zip(*parts, strict=True))
            same = shard[1:] == shard[:-1]
            some = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            shard, fp, rep = shard[some], fp[some], rep[some]
            if not len(fp):
                return None
            label = linked_within(fp.view(np.uint64), shard, radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], ["a", "b"])

        for batch in batches:
            new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp", "rep"))
            if not len(new[0]):
                continue
            cut = int(np.searchsorted(new[0], new[0][-1], "left"))
            if cut or (held and held[-1][0][-1] != new[0][0]):
                held.append(tuple(x[:cut] for x in new))
                if (out := links(held)) is not None:
                    yield out
                held = []
            held.append(tuple(x[cut:] for x in new))
        if held and (out := links(held)) is not None:
            yield out

    dealt = rows.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id long, text).

    Texts are lower-cased in A-Z only and cut at ASCII white space; a fingerprint bit is set if over half of the
    shingles' hashes have it. Fingerprints that differ in ``radius`` bits or fewer are linked; component_id is the
    smallest doc_id that links reach. Equal fingerprints are joined first, so copies cost one row.

    A null, empty or blank text has the fingerprint zero, which links like any other. A row whose doc_id is null keeps
    its fingerprint; it takes the component of its fingerprint, null if only such rows have it. Repeated rows get
    equal results. Other columns are ignored. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    parts = connected_components(fingerprint_links(distinct, radius))
    found = distinct.join(parts, distinct.rep == parts.node, "left").select(F.col("fp").alias("of_fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(found, prints.fp == found.of_fp, "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; rows without a doc_id stay."""
    kept = near_duplicates(docs.select("doc_id", "text"), words, radius).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs.doc_id == kept["__kept"], "left").where("`__kept` is not null or doc_id is null").drop("__kept")
