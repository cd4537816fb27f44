"""Benchmark items found in documents, by SimHash of item-sized windows and exact shingle similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiloom.llm.common import text_key, written

#: Items' shingles and blocks are broadcast up to this count; beyond it they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_array(words: Column, size: int) -> Column:
    """XXH64 of every run of ``size`` words."""
    n = F.size(words) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[words[i + k] for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def window_fingerprint(shingles: Column) -> Column:
    """64-bit SimHash: a bit is set if over half of the shingles, repeats counted, have it."""
    bit = lambda b: F.aggregate(shingles, F.lit(0).cast("long"), lambda s, h: s + F.call_function("shiftrightunsigned", h, b).bitwiseAND(1)) * 2 > F.size(shingles)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.when(bit(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


#: A fingerprint is four blocks of 16 bits; a window's keys stand for values up to so many bits away, an item's for the rest.
BLOCKS, WINDOW_BITS = 4, 1


def block_masks(bits: int) -> list[int]:
    """All values of a block with at most ``bits`` bits set."""
    size = 64 // BLOCKS
    return [sum(1 << i for i in chosen) for n in range(bits + 1) for chosen in combinations(range(size), n)]


def hamming_keys(fingerprint: Column, bits: int) -> Column:
    """The values up to ``bits`` bits away from each block, each with the block's number.

    Of two fingerprints that differ in at most r bits some block differs in at most r // 4. So the keys of one side
    for w bits and of the other for r // 4 - w have one in common.
    """
    size = 64 // BLOCKS
    of = lambda i: F.shiftrightunsigned(fingerprint, i * size).bitwiseAND(F.lit((1 << size) - 1)).bitwiseOR(F.lit(i << size).cast("long"))
    around = lambda block: F.transform(F.lit(block_masks(bits)), lambda m: block.bitwiseXOR(m.cast("long")))
    return F.flatten(F.array(*[around(of(i)) for i in range(BLOCKS)]))


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 19) -> DataFrame:
    """(doc_id, text_key, item_id, start, similarity): the best window of each document for each item it holds.

    Words are runs of letters and digits, lower-cased. Windows have as many words as an item. Fingerprinting a window
    at every word for every size would cost sizes times words fingerprints, and a window without a shingle of the
    benchmark (``words`` words, or a whole shorter item) has similarity zero to all items; so windows stand where such
    a shingle puts an item's begin. Each is fingerprinted by SimHash once, whichever items its shingles come from.

    An index over four blocks of 16 bits then finds, among the items of the window's size, every fingerprint within the
    radius: it holds, for each block of an item, all values up to ``radius // 4 - 1`` bits away, and a window asks for
    those one bit away. The weighted Jaccard similarity of the shingles, weighted by how often each occurs, decides. At
    0.8 about 9.4 of 64 bits differ, with a deviation of 2.8: a radius of 19 keeps 998 in 1,000 windows that are exactly
    that similar, and all but a few in a million that are 0.9.

    Null and empty texts and items without words match nothing. Repeated documents (same id and text) count once and
    get one row for each item; a null doc_id is kept. Repeated items give rows for each item_id. Other columns are
    ignored. An empty table on either side gives no rows.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    items = items.withColumn("size", F.size("w")).withColumn("k", F.least("size", F.lit(words)))
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # of 1 to ``words``
    if not lengths:
        lengths = [words]
    by_length = lambda w: F.coalesce(*[F.when(F.col("k") == k, shingle_array(w, k)) for k in lengths])
    items = written(items.withColumn("s", by_length(F.col("w"))).withColumn("fp", window_fingerprint(F.col("s"))).drop("w"))
    shingles = items.select("size", "k", F.posexplode("s").alias("at", "shingle")).distinct()
    of_item = items.select("item_id", F.col("size").alias("i_size"), F.col("k").alias("i_k"), F.col("fp").alias("i_fp"), F.explode(hamming_keys(F.col("fp"), radius // BLOCKS - WINDOW_BITS)).alias("block"))
    if (items.agg(F.sum(F.size("s") + BLOCKS * len(block_masks(radius // BLOCKS - WINDOW_BITS)))).first()[0] or 0) <= MOST_BROADCAST:
        shingles, of_item = F.broadcast(shingles), F.broadcast(of_item)

    texts = docs.select("doc_id", text_key().alias("text_key"), words_of(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    marked = lambda k: F.transform(shingle_array(F.col("w"), k), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), h.alias("shingle")))
    every = F.flatten(F.array(*map(marked, lengths)))
    placed = texts.select("doc_id", "text_key", "n", F.explode(every).alias("x")).select("doc_id", "text_key", "n", "x.*")
    begin = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("n") - F.col("size")))
    windows = written(placed.join(shingles, ["k", "shingle"]).select("doc_id", "text_key", "size", "k", begin.alias("begin")).distinct())

    found = windows.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("size", "k", "begin")).alias("windows"))
    found = found.select(F.col("doc_id").alias("f_doc"), F.col("text_key").alias("f_key"), "windows")
    held = docs.select("doc_id", "text")
    held = held.join(found, held.doc_id.eqNullSafe(found.f_doc) & (text_key(held.text) == found.f_key)).dropDuplicates(["f_doc", "f_key"])
    cut = held.select("doc_id", F.col("f_key").alias("text_key"), words_of(F.col("text")).alias("all"), F.explode("windows").alias("x")).select("doc_id", "text_key", "x.*", F.slice("all", F.col("x.begin") + 1, F.col("x.size")).alias("w"))
    cut = written(cut.withColumn("s", by_length(F.col("w"))).drop("w").withColumn("fp", window_fingerprint(F.col("s"))))

    asked = cut.select("size", "k", "fp").distinct().withColumn("block", F.explode(hamming_keys(F.col("fp"), WINDOW_BITS)))
    near = asked.join(of_item, (asked["size"] == of_item.i_size) & (asked.k == of_item.i_k) & (asked.block == of_item.block)).drop(asked.block)
    near = written(near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("i_fp"))) <= radius).select("size", "k", "fp", "item_id", "i_fp").distinct())
    near = cut.join(near, ["size", "k", "fp"]).select("doc_id", "text_key", "item_id", "i_fp", "begin", "size", "s")
    near = near.join(items.select(F.col("item_id").alias("of_id"), F.col("size").alias("of_size"), F.col("fp").alias("of_fp"), F.col("s").alias("i_s")), F.col("item_id").eqNullSafe(F.col("of_id")) & (F.col("size") == F.col("of_size")) & (F.col("i_fp") == F.col("of_fp")))

    weight = lambda s, h: F.size(F.filter(s, lambda x: x == h))
    shared = F.aggregate(F.array_distinct("i_s"), F.lit(0), lambda t, h: t + F.least(weight(F.col("s"), h), weight(F.col("i_s"), h)))
    sized = near.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("s") + F.size("i_s") - F.col("shared")))
    best = sized.where(F.col("similarity") >= similarity).groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("begin")).alias("less"))).alias("best"))
    return best.select("doc_id", "text_key", "item_id", (-F.col("best.less")).alias("start"), F.col("best.similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` in which no item is found, columns as they are."""
    bad = contaminated(docs.select("doc_id", "text"), benchmark, words, similarity).select(F.col("doc_id").alias("b_doc"), F.col("text_key").alias("b_key")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.b_doc) & (text_key(docs.text) == bad.b_key), "left_anti")
