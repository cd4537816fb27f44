"""Exact removal of long byte strings that occur more than once, by column-wise multi-document suffix sorting.

A whole-corpus construction that inserts one symbol of each document a round needs as many rounds as the longest
document has bytes. Here the documents of the construction are short: every string of ``length`` bytes names one of
its own grams as its anchor (the gram of least hash), so equal strings have equal anchors at equal places, and the
strings of a document fall into runs that share an anchor. Runs are dealt by anchor; those of one anchor are aligned
on it, and a string can only equal one in the same column. So the construction inserts one symbol of each run a
round, from the last column to the first, and keeps the order of all suffixes and their common prefixes, in at most
``2 * length`` sequential rounds, whatever the documents' lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiloom.llm.common import keyed, small_batches, written

GRAM = 24
#: Bytes that are hashed at once: texts beyond are cut into segments that overlap by a string.
SEGMENT = 1 << 20
ROWS_OUT = 5_000
_PLACE_BITS = 28
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = (1 << 64) - 1
_SYMBOLS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class StringHashes:
    """Hashes of any string of a byte array, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        terms = _SYMBOLS[data] * _powers(base, len(data))
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        self._back = _powers(pow(base, -1, _WORD + 1), len(data) + 1)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[stop] - self._sums[start]) * self._back[start] + (stop - start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row begins and the last ends."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts whose strings share an anchor: (document, first start, starts, anchor's place, its hash), places in ``data``."""
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    if len(data) < length:
        return none
    grams, power, have = _SYMBOLS[data], _BASES[0], 1
    built = {1: (grams, power)}
    while 2 * have <= GRAM:
        grams = grams[:-have] * np.uint64(power) + grams[have:]
        power = power * power & _WORD
        have *= 2
        built[have] = (grams, power)
    while have < GRAM:
        more = max(n for n in built if have + n <= GRAM)
        right, step = built[more]
        n = len(data) - have - more + 1
        grams, have = grams[:n] * np.uint64(step) + right[have : have + n], have + more
    whole = _mixed(grams)
    width = length - GRAM + 1
    least = (whole & ~_PLACE) | np.arange(len(whole), dtype=np.uint64)
    spread = 1
    while 2 * spread <= width:
        least = np.minimum(least[:-spread], least[spread:])
        spread *= 2
    if spread < width:
        least = np.minimum(least[: len(least) - (width - spread)], least[width - spread :])
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    fits = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(starts)[:-1])), starts) + np.arange(starts.sum())
    if not len(fits):
        return none
    place = (least[fits] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    begin, anchor = fits[first], place[first]
    doc = np.searchsorted(offsets, begin, "right") - 1
    return doc, begin, np.diff(np.append(first, len(fits))), anchor, whole[anchor]


def segments(offsets: np.ndarray, length: int, most: int = SEGMENT) -> Iterator[tuple[int, np.ndarray, int]]:
    """(first document, offsets of the segment's documents in the data, place of its first byte in the first document).

    Neighbouring documents of up to ``most`` bytes go together. A longer one comes in segments of its own, in which each
    of its strings begins in exactly one; a string's anchor depends on its bytes alone, so cuts do not change it.
    """
    n, d = len(offsets) - 1, 0
    while d < n:
        last = max(d + 1, int(np.searchsorted(offsets, offsets[d] + most, "right")) - 1)
        size = int(offsets[d + 1] - offsets[d])
        if size <= most:
            yield d, offsets[d : last + 1], 0
        else:
            for at in range(0, size - length + 1, most - length + 1):
                yield d, np.array([offsets[d] + at, min(offsets[d] + at + most, offsets[d + 1])]), at
        d = last


def repeated_columns(rows: list[bytes], leads: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start within it) of the strings of ``length`` bytes that another row of the same group has in the same column.

    ``leads``: bytes before the anchor. ``group`` is sorted. One symbol of each row is inserted a round, from the last
    column on; ``order`` is the order of all suffixes so far within their groups, ``common`` what each shares with the
    one before it.
    """
    most = int(leads.max(initial=0))
    width, n = most + length, len(rows)
    sizes = np.fromiter(map(len, rows), np.int64, n)
    table = np.zeros((width, n), np.uint16)
    column = np.repeat(most - leads - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    table[column, np.repeat(np.arange(n), sizes)] = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint16) + 1
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    number = np.cumsum(new_group).astype(np.int64) * 257
    found_row, found_start = [], []
    for at in range(width - 1, -1, -1):
        symbol = table[at][order]
        key = number + symbol
        move = np.argsort(key, kind="stable") if np.any(key[1:] < key[:-1]) else np.arange(n)
        key = key[move]
        alike = np.concatenate(([False], key[1:] == key[:-1])) & (symbol[move] > 0)
        after = np.zeros(n + 1, np.int32)
        here = np.flatnonzero(alike)
        low, high = move[here - 1] + 1, move[here]
        after[here] = common[high] + 1
        apart = low != high
        if apart.any():
            spans = np.column_stack((low[apart], high[apart] + 1)).ravel()
            after[here[apart]] = np.minimum.reduceat(common, spans)[::2] + 1
        order, common = order[move], after
        if at <= most:
            again = order[np.maximum(common[:-1], common[1:]) >= length]
            start = at - (most - leads[again])
            own = (start >= 0) & (start < starts[again])
            found_row.append(again[own])
            found_start.append(start[own])
    return np.concatenate(found_row), np.concatenate(found_start)


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the half-open spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, z, no_id): texts compressed for the shuffles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for batch in batches:
            z = [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(z, pa.binary()), batch.column("no_id")], ["doc_id", "text_key", "z", "no_id"])

    return docs.mapInArrow(each, "doc_id long, text_key long, z binary, no_id boolean")


def repeated_spans(docs: DataFrame, length: int = 200, hot: int = 20_000, rows_at_once: int = 20_000) -> DataFrame:
    """(doc_id, text_key, spans array<struct<a, b>>): byte ranges of each document that repeated strings cover.

    Runs whose whole content occurs more than once are told by 128 bits (anchor and content hash) and counted, combined
    within a batch before the shuffle; only runs that differ from their anchor's others go through the construction,
    once for each content. An anchor with more than ``hot`` contents is not gathered in one task: its strings are
    counted one by one, by 128-bit hashes, with partial sums.
    """
    small_batches(docs.sparkSession)
    kind = "long"
    texts = keyed(docs)

    def runs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        data, offsets = text_bytes(batch.column("text"))
        found = [tuple(np.empty(0, np.int64) for _ in range(4))]
        for first, ends, at in segments(offsets, length):
            part, ends = data[ends[0] : ends[-1]], ends - ends[0]
            doc, begin, n, place, anchor = anchored_runs(part, ends, length)
            if len(begin):
                content = StringHashes(part, _BASES[1])(begin, begin + n - 1 + length)
                where = ((begin - ends[doc] + at) << 16) | (n << 8) | (place - begin)
                found.append((doc + first, where, anchor.view(np.int64), content.view(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    if length - GRAM >= 255:
        raise ValueError("length must be under 279")

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, where, anchor, content = runs_of(batch)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(where)], ["anchor", "content", "doc_id", "text_key", "place"])

    def counted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, where, anchor, content = runs_of(batch)
            order = np.lexsort((content, anchor))
            first = np.flatnonzero(np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])))) if len(order) else order
            n, order = np.diff(np.append(first, len(order))), order[first]
            take = pa.array(doc[order])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[order]), pa.array(content[order]), batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(where[order]), pa.array(n)], ["anchor", "content", "doc_id", "text_key", "place", "n"])

    run = f"anchor long, content long, doc_id {kind}, text_key long, place long"
    contents = texts.mapInArrow(counted_runs, run + ", n long").repartition("anchor")
    contents = contents.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "text_key", "place")).alias("one"))
    contents = contents.withColumn("of_anchor", F.expr("count(*) over (partition by anchor)")).where("n > 1 or of_anchor > 1")
    contents = written(contents.select("anchor", "content", "n", "of_anchor", "one.*"))

    whole = contents.where("n > 1").select("anchor", "content")
    runs = texts.mapInArrow(all_runs, run)
    start, n = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255)
    spans = runs.join(whole, ["anchor", "content"], "left_semi").select("doc_id", "text_key", start.alias("a"), (start + n - 1 + length).alias("b"))

    wanted = contents.where("of_anchor > 1").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("place", "anchor", "n", (F.col("of_anchor") > hot).alias("hot"))).alias("runs"))
    rows = _packed(texts).dropDuplicates(["doc_id", "text_key"]).join(wanted, ["doc_id", "text_key"])
    piece = f"anchor long, doc_id {kind}, text_key long, start long, n int, lead int, once boolean, piece binary, w array<struct<x: long, y: long>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor().decompress
        names = ["anchor", "doc_id", "text_key", "start", "n", "lead", "once", "piece", "w"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))]
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, z, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "z", "runs")), strict=True):
                if len(out) >= ROWS_OUT:
                    yield made(out)
                    out = []
                raw = opened(z)
                hashes = None
                for r in found:
                    a, k, lead = r["place"] >> 16, (r["place"] >> 8) & 255, r["place"] & 255
                    if not r["hot"]:
                        out.append((r["anchor"], doc_id, key, a, k, lead, r["n"] == 1, raw[a : a + k - 1 + length], None))
                        continue
                    if hashes is None:
                        data = np.frombuffer(raw, np.uint8)
                        hashes = [StringHashes(data, b) for b in _BASES]
                    at = np.arange(a, a + k)
                    x, y = (h(at, at + length).view(np.int64).tolist() for h in hashes)
                    out.append((r["anchor"], doc_id, key, a, k, lead, r["n"] == 1, None, [{"x": i, "y": j} for i, j in zip(x, y, strict=True)]))
            if out:
                yield made(out)

    pieces = rows.mapInArrow(cut, piece)
    span = f"doc_id {kind}, text_key long, a long, b long"

    def construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = ["doc_id", "text_key", "a", "b"], [], 0

        def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            anchor = rows.column("anchor").to_numpy()
            once = rows.column("once").to_numpy(zero_copy_only=False)
            same = anchor[1:] == anchor[:-1]
            some = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            if not (some & once).any():
                return None
            rows, anchor, once = rows.filter(pa.array(some)), anchor[some], once[some]
            start, n, lead = (rows.column(c).to_numpy().astype(np.int64) for c in ("start", "n", "lead"))
            row, at = repeated_columns(rows.column("piece").to_pylist(), lead, n, anchor, length)
            row, at = row[once[row]], at[once[row]]
            order = np.lexsort((at, row))
            row, at = row[order], at[order]
            if not len(row):
                return None
            breaks = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))
            first = np.flatnonzero(breaks)
            last = np.append(first[1:], len(row)) - 1
            take = pa.array(row[first])
            a, b = start[row[first]] + at[first], start[row[last]] + at[last] + length
            return pa.RecordBatch.from_arrays([rows.column("doc_id").take(take).combine_chunks(), rows.column("text_key").take(take).combine_chunks(), pa.array(a), pa.array(b)], names)

        def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts and (out := solve(parts)) is not None:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = batch.column("anchor").to_numpy()
            cut_at = int(np.searchsorted(anchors, anchors[-1], "left"))
            if size + cut_at >= rows_at_once and (cut_at or held[-1].column("anchor")[-1].as_py() != anchors[0]):
                yield from solved([*held, *([batch.slice(0, cut_at)] if cut_at else [])])
                held, size = [], 0
                batch = batch.slice(cut_at)
            held.append(batch)
            size += batch.num_rows
        yield from solved(held)

    cool = pieces.where("w is null").drop("w").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(construct, span)
    if contents.where(F.col("of_anchor") > hot).limit(1).count():
        single = pieces.where("w is not null").select("doc_id", "text_key", "start", "once", F.posexplode("w").alias("k", "w"))
        again = single.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
        some = single.where("once").join(again, "w", "left_semi").select("doc_id", "text_key", (F.col("start") + F.col("k")).alias("a"), (F.col("start") + F.col("k") + length).alias("b"))
        cool = cool.unionByName(some)
    return spans.unionByName(cool).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def drop_repeats(docs: DataFrame, length: int = 200, hot: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs`` (doc_id, text).

    Each byte that a string of ``length`` bytes covers which also starts anywhere else, in the same document or
    another, is removed; strings are judged on the input, and overlapping ones count. ``kept`` is what is left, as
    bytes: a cut may fall inside a character.

    A null text is empty; texts shorter than ``length`` stay whole. Repeated rows are separate documents, so each is a
    copy of the other; a null doc_id is kept. Other columns are ignored. An empty table gives no rows.
    """
    found = written(repeated_spans(docs.select("doc_id", "text"), length, hot))
    rows = _packed(keyed(docs)).join(found, ["doc_id", "text_key"], "left").select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "z", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for z, spans in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = opened(z)
                gone = covered([(s["a"], s["b"]) for s in spans or []])
                kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
