"""Harmonic packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from apiloom.llm.common import small_batches

CACHED_WORDS = 400_000
SPECIAL = "<|endoftext|>"


class WordCachedEncoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokenizer always starts a token at a space that a non-space follows, so a text may be cut
    there and each word's ids looked up. Texts with other white space after a space are encoded whole, and those that
    hold the vocabulary's special token go through the ``tokenizers`` file itself.
    """

    def __init__(self) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._file = public_tokenizers.path("byte_bpe_50k.json")
        self._whole = None
        self._odd_space = regex.compile(r" (?=\s|$)")
        self._words: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self._encoding.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            if self._whole is None:
                from tokenizers import Tokenizer

                self._whole = Tokenizer.from_file(self._file)
            return np.asarray(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self._odd_space.search(text):
            return self._ids(text)
        words, known = text.split(" "), self._words
        if len(known) > CACHED_WORDS:
            known.clear()
        out = [self._ids(words[0])]
        for word in words[1:]:
            ids = known.get(word)
            if ids is None:
                ids = self._ids(" " + word)
                if len(word) <= 40:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


class HarmonicBins:
    """Open bins of one worker. ``add`` takes documents one by one and returns the pieces of the bins that it fills.

    A document's ids are cut into whole capacities, each a bin of its own, and a tail. A tail of r ids has the class
    k = capacity // r, its length lies between the reciprocals capacity / (k + 1) and capacity / k, and a bin of the
    class takes exactly k tails. What such a bin has left, less than any of its tails, is filled from the head of the
    next document, so documents are cut only there and at whole capacities. Lengths up to the capacity have about
    2 * sqrt(capacity) classes, so what is open is bounded by as many bins.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self._open: dict[int, list[tuple]] = defaultdict(list)
        self._counted: tuple[list[tuple], int] | None = None  # a bin that has its tails, and its gap

    def add(self, document: object, ids: bytes) -> Iterator[list[tuple]]:
        """Filled bins: lists of (document, start, ids of the piece, ids of its document)."""
        total, start = len(ids) // 4, 0
        piece = lambda a, b: (document, a, ids[4 * a : 4 * b], total)
        if self._counted:
            pieces, gap = self._counted
            start = min(gap, total)
            pieces.append(piece(0, start))
            self._counted = (pieces, gap - start)
            if start == gap:
                self._counted = None
                yield pieces
        while total - start >= self.capacity:
            yield [piece(start, start + self.capacity)]
            start += self.capacity
        if start < total:
            k = self.capacity // (total - start)
            tails = self._open[k]
            tails.append(piece(start, total))
            if len(tails) == k:
                del self._open[k]
                gap = self.capacity - sum(len(p[2]) for p in tails) // 4
                if gap:  # no other bin waits: a document gives a tail only once it has filled that one's gap
                    self._counted = (tails, gap)
                else:
                    yield tails

    def _stream(self, pieces: list[tuple]) -> Iterator[list[tuple]]:
        """Pieces one after another, cut where a bin is full; the last bin waits for its gap to be filled."""
        out, room = [], self.capacity
        for document, start, ids, total in pieces:
            while ids:
                part = ids[: 4 * room]
                out.append((document, start, part, total))
                start, ids, room = start + len(part) // 4, ids[len(part) :], room - len(part) // 4
                if not room:
                    yield out
                    out, room = [], self.capacity
        self._counted = (out, room) if out else None

    def rest(self) -> Iterator[list[tuple]]:
        """What is open at the end: whole bins, and one more that is cut into sequences whose lengths are powers of two."""
        open_ = [p for k in sorted(self._open) for p in self._open[k]]
        yield from self._stream([*(self._counted[0] if self._counted else []), *open_])
        self._open.clear()
        pieces = self._counted[0] if self._counted else []
        while pieces:
            size, out, left = 1 << ((sum(len(p[2]) for p in pieces) // 4).bit_length() - 1), [], []
            for document, start, ids, total in pieces:
                take = min(size, len(ids) // 4)
                size -= take
                if take:
                    out.append((document, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    left.append((document, start + take, ids[4 * take :], total))
            yield out
            pieces = left
        self._counted = None


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack documents (``doc_id``, ``text``) into sequences of at most ``capacity`` tokens.

    Each document's ids, ended by ``end_id``, go to harmonic bins (see ``HarmonicBins``). Each worker (Spark partition)
    fills its own, without a shuffle; what is open at its end leaves as full sequences and fewer than
    log2(capacity) + 1 shorter ones whose lengths are powers of two, so no sequence needs padding. ``sequence_id``
    holds the partition and the bin's number there, so it is unique.

    A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if ``with_ids``).
    A null or empty text has the end id alone. A null doc_id is kept. Repeated rows are packed once for each row. An
    empty table gives no rows. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(x, T.LongType()) for x in names[1:]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, harmonic = WordCachedEncoder(), HarmonicBins(capacity)
        sequence = TaskContext.get().partitionId() << 40
        end = np.asarray([end_id], "<u4").tobytes()
        ready: list[tuple] = []
        kinds = None

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for document, start, ids, total in pieces:
                length = len(ids) // 4
                ready.append((document, start, length, zlib.crc32(ids), total, sequence, offset, *([np.frombuffer(ids, "<u4").tolist()] if with_ids else [])))
                offset += length
            sequence += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True))
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.name for f in fields])

        for batch in batches:
            kinds = kinds or [batch.schema.field("doc_id").type, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * with_ids]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for pieces in harmonic.add(doc_id, encode(text or "") + end if text else end):
                    close(pieces)
                if len(ready) >= 20_000:
                    yield out()
        for pieces in harmonic.rest():
            close(pieces)
        if ready:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(fill, T.StructType(fields))
