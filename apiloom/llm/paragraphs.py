"""Near-duplicate passages across a corpus: MinHash banding of paragraphs, exact Jaccard similarity, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiloom.llm.common import in_blocks, keyed, released, small_batches, written
from apiloom.llm.components import connected_components

#: A line of more words than this is cut into pieces where its own words choose.
LONG_LINE = 24
#: A cut has the least hash of two words among so many words on either side; cuts are 11 words apart on average.
REACH = 5
#: A piece that stays longer (words that recur in a short period) is cut again, STRIDE words after each cut.
LONGEST, STRIDE = 32, 12
#: Words beside a piece that are compared with those beside its keeper. No piece is longer.
BESIDE = 32
#: (bands, rows of each): whole long lines are found at 0.8 in 99.4 % of cases, pieces and short lines in 96 %.
LINE_BANDS, PIECE_BANDS = (5, 2), (2, 1)
#: Contents of a band key that one task compares; a larger bucket is compared block by block.
BLOCK = 500
CACHED_WORDS = 500_000
_TIMES = np.random.default_rng(5).integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """32 bits of the XXH64 of words."""

    def __missing__(self, word: str) -> int:
        x = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF
        if len(self) > CACHED_WORDS:
            self.clear()
        if len(word) <= 60:
            self[word] = x
        return x


def hashed_words(text: str | None, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's lower-cased words, and how many each of its lines has (blank lines left out)."""
    parts: list[str] = []
    sizes: list[int] = []
    for line in (text or "").lower().split("\n"):
        own = line.split()
        if own:
            parts += own
            sizes.append(len(own))
    return np.fromiter(map(known.__getitem__, parts), np.uint32, len(parts)), np.array(sizes, np.uint32)


def hashed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, no_id, text_key, words binary, lines binary): each text's word hashes and line sizes, 32 bits each, as a written table.

    Everything after reads this table, so texts are cut into words once. Rows without words are left out.
    """
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            made = [hashed_words(t, known) for t in batch.column("text").to_pylist()]
            own = [batch.column(c) for c in ("doc_id", "no_id", "text_key")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([m[i].tobytes() for m in made], pa.binary()) for i in (0, 1))], ["doc_id", "no_id", "text_key", "words", "lines"])

    return written(keyed(docs).where("text is not null").mapInArrow(each, "doc_id long, no_id boolean, text_key long, words binary, lines binary").where("length(words) > 0"))


@dataclass
class Paragraphs:
    """Paragraphs of a batch of texts, as ranges of its words."""

    words: np.ndarray  # hashes
    text: np.ndarray  # of each paragraph: its text's row,
    start: np.ndarray  # its first word among the batch's,
    size: np.ndarray  # its words,
    place: np.ndarray  # its first word among its text's,
    whole: np.ndarray  # and whether it is a whole long line, given beside its pieces

    @classmethod
    def of(cls, words: np.ndarray, sizes: np.ndarray, per_text: np.ndarray, least_words: int) -> Paragraphs:
        """Lines are paragraphs; a long line is given whole, and also cut at words whose hash is the least of those around.

        Where it is cut depends on a few words around the cut alone, so a passage that stands within two different lines is
        cut alike in both, apart from its ends. Paragraphs of fewer than ``least_words`` words are left out.
        """
        w, sizes = words.astype(np.uint64), sizes.astype(np.int64)
        stops = np.cumsum(sizes)
        ends = np.repeat(sizes > LONG_LINE, sizes)
        line = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        x = w * _TIMES[0]
        x[1:] += w[:-1] * _TIMES[1]
        x = _mixed(x)
        for k in range(1, REACH + 1):
            same = line[k:] == line[:-k]
            ends[k:] &= ~same | (x[k:] < x[:-k])
            ends[:-k] &= ~same | (x[:-k] <= x[k:])
        ends[stops - 1] = True
        stop = np.flatnonzero(ends) + 1
        start = np.concatenate((np.zeros(min(1, len(stop)), np.int64), stop[:-1]))
        parts = np.where(stop - start > LONGEST, -(-(stop - start) // STRIDE), 1)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        stop, start = np.repeat(stop, parts), np.repeat(start, parts) + nth * STRIDE
        stop = np.where(nth < np.repeat(parts, parts) - 1, start + STRIDE, stop)
        long = sizes > LONG_LINE
        start, stop = np.concatenate(((stops - sizes)[long], start)), np.concatenate((stops[long], stop))
        whole = np.arange(len(start)) < long.sum()
        first = np.cumsum(per_text) - per_text
        text = np.searchsorted(first, start, "right") - 1
        enough = stop - start >= least_words
        return cls(w, text[enough], start[enough], (stop - start)[enough], start[enough] - first[text[enough]], whole[enough])

    @classmethod
    def of_batch(cls, batch: pa.RecordBatch, least_words: int) -> Paragraphs:
        words, lines = (batch.column(c).to_pylist() for c in ("words", "lines"))
        per_text = np.array([len(w) // 4 for w in words], np.int64)
        return cls.of(np.frombuffer(b"".join(words), np.uint32), np.frombuffer(b"".join(lines), np.uint32), per_text, least_words)

    def take(self, which: np.ndarray) -> Paragraphs:
        return Paragraphs(self.words, self.text[which], self.start[which], self.size[which], self.place[which], self.whole[which])

    def contents(self, columns: int = 2) -> np.ndarray:
        """64 bits a column of each paragraph's words and their order."""
        at = np.arange(len(self.words), dtype=np.uint64)
        out = []
        a, b = self.start, self.start + self.size
        for times in _TIMES[:columns]:
            mixed = _mixed(self.words + times)
            order = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * at, dtype=np.uint64)))
            base = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
            total = base[b] - base[a]
            placed = (order[b] - order[a]) - total * a.astype(np.uint64)
            out.append(_mixed(_mixed(total * times) ^ _mixed(placed + self.size.astype(np.uint64))))
        return np.column_stack(out).view(np.int64) if len(self.start) else np.empty((0, columns), np.int64)

    def shingles(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``words`` words of all paragraphs, one after another, and where each paragraph's begin."""
        n = np.maximum(self.size - words + 1, 0)
        offsets = np.cumsum(n) - n
        if not n.sum():
            return np.empty(0, np.uint64), offsets
        runs = len(self.words) - words + 1
        total = np.zeros(runs, np.uint64)
        for k in range(words):
            total += self.words[k : k + runs] * _TIMES[2 + k]
        return _mixed(total)[np.repeat(self.start - offsets, n) + np.arange(n.sum())], offsets


def band_keys(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each set (none is empty) and band: ``rows`` minima under as many hash functions."""
    keys = np.empty((len(offsets), bands), np.uint64)
    for band in range(bands if len(offsets) else 0):
        key = np.full(len(offsets), 8 * rows + band, np.uint64) * _TIMES[63]
        for k in range(band * rows, (band + 1) * rows):
            key = _mixed(key ^ np.minimum.reduceat(_mixed(hashes * _TIMES[16 + k]), offsets))
        keys[:, band] = key
    return keys.view(np.int64)


def closest(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Least index of each set's class, links being pairs of at least that Jaccard similarity.

    Sets come by size, so only those of a fitting size are compared, and two that chains of links have joined are not.
    """
    label = list(range(len(sets)))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    members = [set(s.tolist()) for s in sets]
    for n, i in enumerate(order):
        for j in reversed(order[:n]):
            if len(members[j]) < similarity * len(members[i]):
                break
            a, b = root(i), root(j)
            if a != b:
                both = len(members[i] & members[j])
                if both >= similarity * (len(members[i]) + len(members[j]) - both):
                    label[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(sets))], np.int64)


def _slices(texts: DataFrame, wanted: DataFrame, beside: int, columns: list[str]) -> DataFrame:
    """``wanted`` (doc_id, text_key, start, n_words and other ``columns``) with ``w``: its words' hashes, and ``beside`` more on either side."""
    kinds = {f.name: f.dataType for f in wanted.schema.fields}
    taken = ["start", "n_words", *columns]
    listed = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*taken)).alias("wanted"))
    rows = texts.select("doc_id", "text_key", "words").join(listed, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("doc_id", "text_key", *taken)] + [T.StructField("w", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("wanted")
            row = np.repeat(np.arange(batch.num_rows), np.diff(of.offsets.to_numpy()))
            flat = of.flatten()
            start, size = (flat.field(c).to_numpy() for c in ("start", "n_words"))
            words = batch.column("words").to_pylist()
            cut = [words[r][4 * max(0, a - beside) : 4 * (a + n + beside)] for r, a, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            own = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([*own, *(flat.field(c) for c in taken), pa.array(cut, pa.binary())], schema.names)

    return rows.mapInArrow(each, schema)


def paragraph_clusters(texts: DataFrame, words: int = 5, similarity: float = 0.8, least_words: int = 8) -> DataFrame:
    """Every paragraph of ``texts`` (of ``hashed_texts``) that has an equal or near-equal one elsewhere, with the keeper of its class.

    Columns: doc_id, no_id, text_key, start and n_words (in words of the text), whole, keeper (doc_id, no_id, text_key,
    start, n_words), kept. Long lines are compared whole as well as in pieces; a piece of its own keeper is kept.
    Paragraphs of fewer than ``least_words`` words are left alone.

    Equal paragraphs (by 128 bits of their words' hashes) are one content, however many documents have it. Contents
    whose minima agree in a band collide; the Jaccard similarity of their shingles is then computed exactly, and
    classes are components of the links. The first paragraph of a class, by document and place, is its keeper.
    """
    if least_words < words:
        raise ValueError("a paragraph needs a shingle")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Paragraphs.of_batch(batch, least_words)
            if not len(found.start):
                continue
            content, first, times = np.unique(found.contents(1)[:, 0], return_index=True, return_counts=True)
            out: list[tuple[np.ndarray, ...]] = []
            for whole, (bands, rows) in ((True, LINE_BANDS), (False, PIECE_BANDS)):
                own = found.whole[first] == whole
                key = band_keys(*found.take(first[own]).shingles(words), bands, rows)
                n = np.zeros(key.shape, np.int32)
                n[:, 0] = times[own]
                out.append((key.ravel(), np.repeat(content[own], bands), n.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "h1", "n"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Paragraphs.of_batch(batch, least_words)
            content, take = found.contents(), pa.array(found.text)
            own = [batch.column(c).take(take) for c in ("doc_id", "text_key", "no_id")]
            yield pa.RecordBatch.from_arrays([pa.array(content[:, 0]), pa.array(content[:, 1]), *own, *(pa.array(x.astype(np.int32)) for x in (found.place, found.size)), pa.array(found.whole)], ["h1", "h2", "doc_id", "text_key", "no_id", "start", "n_words", "whole"])

    # One shuffle of (band, content) rows tells contents that collide, and contents that occur again (n counts them at
    # their first band). Copies are summed within a batch before; a key's contents are told apart by their least and
    # greatest, so no bucket is gathered.
    of_key = Window.partitionBy("key")
    banded = texts.select("words", "lines").mapInArrow(keys, "key long, h1 long, n int").repartition("key")
    banded = banded.withColumn("copies", F.sum("n").over(of_key)).withColumn("low", F.min("h1").over(of_key)).withColumn("high", F.max("h1").over(of_key))
    told = written(banded.where("low <> high or copies > 1").select("key", "h1", (F.col("low") != F.col("high")).alias("collides")).distinct())
    found = texts.mapInArrow(places, "h1 long, h2 long, doc_id long, text_key long, no_id boolean, start int, n_words int, whole boolean")
    several = written(told.select("h1").distinct())  # a table, so that the join may split a hot content
    found = written(found.join(several, "h1", "left_semi"))
    place = F.struct("doc_id", "no_id", "text_key", "start", "n_words")
    contents = written(found.groupBy("h1", "h2").agg(F.min(place).alias("one"), F.max(place).alias("last")))

    colliding = told.where("collides").select("key", "h1").join(contents.select("h1", "h2"), "h1")
    wanted = colliding.select("h1", "h2").distinct().join(contents, ["h1", "h2"]).select("h1", "h2", "one.doc_id", "one.text_key", "one.start", "one.n_words")
    sets = _slices(texts, wanted, 0, ["h1", "h2"]).select("h1", "h2", "w")
    buckets = in_blocks(colliding, told.where("collides"), ["h1", "h2"], BLOCK).join(sets, ["h1", "h2"]).repartition("key", "block").sortWithinPartitions("key", "block")
    kind = "struct<h1: bigint, h2: bigint>"

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held = None, [], []
        as_id = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])

        def links() -> list[tuple[dict, dict]]:
            if len(held) < 2:
                return []
            sizes = np.array([len(w) // 4 for w in held], np.int64)
            start = np.cumsum(sizes) - sizes
            hashes, offsets = Paragraphs(np.frombuffer(b"".join(held), np.uint32).astype(np.uint64), start, start, sizes, start, start).shingles(words)
            label = closest(np.split(hashes, offsets[1:]), similarity)
            return [(ids[i], ids[r]) for i, r in enumerate(label) if r != i]

        def pairs_of(pairs: list[tuple[dict, dict]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), as_id) for c in zip(*pairs, strict=True)], ["a", "b"])

        for batch in batches:
            pairs: list[tuple[dict, dict]] = []
            for *k, h1, h2, w in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "h1", "h2", "w")), strict=True):
                if k != key:
                    pairs += links()
                    key, ids, held = k, [], []
                ids.append({"h1": h1, "h2": h2})
                held.append(w)
            if pairs:
                yield pairs_of(pairs)
        if pairs := links():
            yield pairs_of(pairs)

    links = buckets.select("key", "block", "h1", "h2", "w").mapInArrow(link, f"a {kind}, b {kind}").distinct()
    parts = connected_components(links)
    own = F.struct("h1", "h2")
    classes = contents.join(parts, own == parts.node, "left").where("component is not null or one <> last").select("h1", "h2", "one", F.coalesce("component", own).alias("class"))
    keepers = classes.groupBy("class").agg(F.min("one").alias("keeper"))
    members = classes.join(keepers, "class").select("h1", "h2", "keeper")
    # Distinct at the end, for repeated rows: a shuffle by all columns, which no hot content makes uneven.
    out = found.join(members, ["h1", "h2"]).drop("h1", "h2").distinct()
    kept = (F.struct("doc_id", "no_id", "text_key") == F.struct("keeper.doc_id", "keeper.no_id", "keeper.text_key")) & (F.col("start") < F.col("keeper.start") + F.col("keeper.n_words"))
    clusters = written(out.withColumn("kept", kept))
    released(told, several, found, contents)
    return clusters


def alike_beside(own: np.ndarray, at: int, size: int, other: np.ndarray, other_at: int, other_size: int) -> tuple[int, int]:
    """How many words before and after a piece are those beside its near copy, their starts or their ends being aligned."""
    before = after = 0
    for shift in {other_at - at, other_at + other_size - at - size}:
        n = min(at, at + shift) if 0 <= at + shift <= len(other) else 0
        if n > 0:
            apart = np.flatnonzero(own[at - n : at] != other[at + shift - n : at + shift])
            before = max(before, n - 1 - int(apart[-1]) if len(apart) else n)
        end = at + size
        n = min(len(own) - end, len(other) - end - shift) if end + shift >= 0 else 0
        if n > 0:
            apart = np.flatnonzero(own[end : end + n] != other[end + shift : end + shift + n])
            after = max(after, int(apart[0]) if len(apart) else n)
    return before, after


def shared_beside(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_key, start, n_words, keeper) with before and after: how many words beside the piece and
    beside its keeper are the same, up to about BESIDE. In the keeper's own text, its words stay."""
    names = ["doc_id", "text_key", "start", "n_words"]
    wanted = rows.select(*names).unionByName(rows.select(*[f"keeper.{c}" for c in names])).distinct()
    beside = written(_slices(texts, wanted, BESIDE, []))
    of_keeper = beside.select(*(F.col(c).alias(f"k_{c}") for c in (*names, "w")))
    both = rows.join(beside, names).join(of_keeper, [F.col(f"keeper.{c}") == F.col(f"k_{c}") for c in names])
    columns = rows.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = ("w", "start", "n_words", "k_w", "k_start", "k_n_words")
        for batch in batches:
            found = [alike_beside(np.frombuffer(o, np.uint32), min(s, BESIDE), n, np.frombuffer(k, np.uint32), min(ks, BESIDE), kn) for o, s, n, k, ks, kn in zip(*(batch.column(c).to_pylist() for c in taken), strict=True)]
            ends = [pa.array([x[c] for x in found], pa.int32()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *ends], [*columns, "before", "after"])

    schema = T.StructType([*rows.schema.fields, T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())])
    both = both.select(*columns, "w", "k_w", "k_start", "k_n_words").mapInArrow(compare, schema)
    within = (F.col("doc_id") == F.col("keeper.doc_id")) & (F.col("no_id") == F.col("keeper.no_id")) & (F.col("text_key") == F.col("keeper.text_key"))
    room = F.when(within, F.col("start") - F.col("keeper.start") - F.col("keeper.n_words")).otherwise(F.col("before"))
    return both.withColumn("before", F.greatest(F.lit(0), F.least("before", room)))


def repeated_paragraphs(docs: DataFrame, words: int = 5, similarity: float = 0.8, least_run: int = 25, least_words: int = 8) -> DataFrame:
    """(doc_id, start, n_words, keeper_doc_id, keeper_start): ranges to remove, in words of their text, none twice.

    What counts as a passage is a stretch of at least ``least_run`` words that near copies cover, be they lines or pieces
    of them: neighbouring ones make one stretch, and those that are kept count to its length. So the same words are a
    passage however they are laid out in lines; of a near copy of a long line the whole line goes. Shorter repeats, such as headings and common phrases, are no passage and stay
    (``least_run=0`` takes them too). Each piece takes along the words beside it that its keeper has beside it as well,
    so a passage goes from end to end.

    A null or empty text has no paragraphs. Rows that agree in doc_id and text count as one document; a null doc_id is
    kept. Other columns are ignored. An empty table gives no rows.
    """
    texts = hashed_texts(docs.select("doc_id", "text"))
    clusters = paragraph_clusters(texts, words, similarity, least_words)
    text = ["doc_id", "no_id", "text_key"]
    end = F.col("start") + F.col("n_words")
    rows = clusters.where("not kept").select(*text, "start", "n_words", "whole", "keeper")
    ordered = Window.partitionBy(*text).orderBy("start", F.desc("n_words"))
    covered = F.max(F.when(F.col("whole"), end)).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("covered", F.coalesce(covered, F.lit(0))).where("start >= covered").drop("covered")
    rows = rows.withColumn("next", F.lead("start").over(ordered)).withColumn("last", F.lag(end).over(ordered))
    rows = written(rows)
    # Whole lines end where they end, and pieces between removed neighbours have nothing beside them.
    open_end = ~F.col("whole") & (F.coalesce(F.col("next") > end, F.lit(True)) | F.coalesce(F.col("last") < F.col("start"), F.lit(True)))
    grown = shared_beside(texts, rows.where(open_end)).unionByName(rows.where(~open_end).withColumns({"before": F.lit(0), "after": F.lit(0)}))
    grown = grown.withColumn("end", F.least(end + F.col("after"), F.coalesce("next", F.lit((1 << 31) - 1))))
    grown = grown.withColumn("begin", F.greatest(F.col("start") - F.col("before"), F.coalesce(F.lag("end").over(ordered), F.lit(0))))
    grown = grown.select(*text, "begin", "end", "whole", "keeper", (F.col("keeper.start") - (F.col("start") - F.col("begin"))).alias("keeper_start"))
    held = clusters.where("kept").select(*text, F.col("start").alias("begin"), end.alias("end"), "whole", F.lit(None).cast(rows.schema["keeper"].dataType).alias("keeper"), F.lit(None).cast("int").alias("keeper_start"))
    by_place = Window.partitionBy(*text).orderBy("begin", "end")
    reached = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    # Paragraphs that are too short to be compared may stand between those of a stretch.
    opens = F.coalesce(F.col("begin") >= reached + least_words, F.lit(True)).cast("int")
    stretch = Window.partitionBy(*text, "stretch")
    both = grown.unionByName(held).withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("length", F.max("end").over(stretch) - F.min("begin").over(stretch)).where((F.col("length") >= least_run) & F.col("keeper").isNotNull())
    real = lambda no_id, doc: F.when(~F.col(no_id), F.col(doc))
    return both.select(real("no_id", "doc_id").alias("doc_id"), F.col("begin").alias("start"), (F.col("end") - F.col("begin")).alias("n_words"), real("keeper.no_id", "keeper.doc_id").alias("keeper_doc_id"), "keeper_start")
