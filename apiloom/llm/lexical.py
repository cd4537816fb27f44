"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners by how rare they are, the rarest to the first. Every item sends a bundle to every block of
documents: its terms, and the scores gathered so far (sparse accumulators). A stage is one owner: its postings meet the
bundles by cogroup on (block, group of items), the integer contributions of its terms are added, and the bundle goes on
to the next owner. After the last one the best of each block are merged.

What an item's remaining terms can still add is known, and so is a score that ten documents already have. A document
that cannot reach it leaves the bundle, and once no new document can, later owners only add to those inside. Both tests
are exact, ties included, so nothing is lost. Blocks split every list of postings, so no frequent term lands in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apiloom.llm.common import released, small_batches, written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Owners by rarity: the first has terms in less than one of 256 documents, and so on; the last those in over a quarter.
OWNERS = (256, 64, 16, 4)
#: Postings in a block of documents, and items in a group, on average.
BLOCK_POSTINGS, GROUP_ITEMS = 250_000, 512

_BUNDLE = "block long, part int, item long, docs array<long>, ids array<long>, scores array<long>, best array<long>"


def term_counts(rows: DataFrame, id_: str) -> DataFrame:
    """(row, id, n, term, tf) of each text's terms; ``row`` tells rows apart, and the empty term stands once for each text with terms."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for of, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = TERM.findall((text or "").translate(_LOWER))
                counts = Counter(found) | {"": 1} if found else {}
                ids.append(of)
                ns.append(len(found))
                terms.append(list(counts))
                tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"])

    counted = rows.select(F.col(id_).cast("long").alias("id"), "text").mapInArrow(each, "id long, n long, terms array<string>, tfs array<long>")
    return counted.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "n", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))


def _adder(k: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One owner's stage for the bundles of a block: postings (row, id, term, gain) added to the accumulators."""

    def add(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        row, id_, term, gain = (postings.column(c).to_numpy() for c in ("row", "id", "term", "gain"))
        held = [(b["docs"], b["ids"], b["scores"]) for b in bundles.select(["docs", "ids", "scores"]).to_pylist()]
        docs, first = np.unique(np.concatenate([row, *(np.array(d, np.int64) for d, _, _ in held)]), return_index=True)
        ids = np.concatenate([id_, *(np.array(i, np.int64) for _, i, _ in held)])[first]
        by_term = np.argsort(term, kind="stable")
        at, gain, term = np.searchsorted(docs, row[by_term]), gain[by_term], term[by_term]
        out = {"docs": [], "ids": [], "scores": [], "best": []}
        for (inside, _, scores), terms, now, after, bound in zip(held, *(bundles.column(c).to_pylist() for c in ("terms", "reach_now", "reach_after", "bound")), strict=True):
            total, known = np.zeros(len(docs), np.int64), np.searchsorted(docs, np.array(inside, np.int64))
            total[known] = scores
            for t in terms or ():
                these = slice(*np.searchsorted(term, (t, t + 1)))
                total[at[these]] += gain[these]
            kept = np.flatnonzero(total) if now >= bound else known
            if len(kept) > k:
                bound = max(bound, int(np.partition(total[kept], len(kept) - k)[len(kept) - k]))
            kept = kept[total[kept] + after >= bound]
            order = np.lexsort((docs[kept], ids[kept], -total[kept]))[:k] if last else np.argsort(-total[kept], kind="stable")[:k]
            out["best"].append(total[kept[order]].tolist())
            kept = kept[order] if last else kept
            for c, values in (("docs", docs), ("ids", ids), ("scores", total)):
                out[c].append(values[kept])
        arrays = [bundles.column(c) for c in ("block", "part", "item")] + [pa.array(out[c], pa.list_(pa.int64())) for c in ("docs", "ids", "scores", "best")]
        return pa.Table.from_arrays(arrays, ["block", "part", "item", "docs", "ids", "scores", "best"])

    return add


def _best_of(rows: DataFrame, k: int, salt: int, order: Sequence[Column]) -> DataFrame:
    """The k first rows of each item, in two steps, so that no task gets all blocks of an item at once."""
    for keys in (["item", F.pmod("block", F.lit(salt))], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return rows


def search(documents: DataFrame, items: DataFrame, k: int = 10, owners: Sequence[int] = OWNERS, block_postings: int = BLOCK_POSTINGS, group_items: int = GROUP_ITEMS, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, equal scores by ascending doc_id.

    ``documents``: (doc_id, text), ``items``: (item_id, text). Terms are runs of letters and digits, A-Z lower-cased. A
    term that df of N documents hold weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document with n of all L terms
    has m = 10 + 90 n N div L; its score sums w * (1000000000 tf div (1000 tf + 8 m)) over the item's distinct terms.
    Only scores above 0 count. ``report`` is called with each stage's number and its accumulators.

    A null text has no terms. Every row is a document or item of its own, repeated ones and equal ids too; documents
    without an id come last among equals, and equal ids in an arbitrary but fixed order. Other columns are dropped;
    empty tables give no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    wanted = written(term_counts(items, "item_id").where("term <> ''").select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term"))
    words = wanted.select("term").distinct().withColumn("no", F.monotonically_increasing_id()).unionByName(spark.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("no")))
    words = written(words)
    postings = written(term_counts(documents, "doc_id").join(words, "term").select("row", "id", "n", F.col("no").alias("term"), "tf"))
    total = postings.agg(F.count(F.when(F.col("term") < 0, 1)).alias("n"), F.sum(F.when(F.col("term") < 0, F.col("n"))).alias("l"), F.count("*").alias("postings")).first()
    n_items = wanted.select("item").distinct().count()
    if not total.n or not n_items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks, parts = -(-total.postings // block_postings), -(-n_items // group_items)

    m = F.expr(f"100 - 90 + ((90 * n * {total.n}L) div {total.l}L)")
    held = postings.where("term >= 0").withColumn("m", m).withColumn("gain", F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)"))
    df = F.col("df").cast("double")
    told = held.groupBy("term").agg(F.count("*").alias("df"), F.max("gain").alias("most"))
    told = told.withColumn("w", F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * total.n + 2) / (2 * df + 1))))
    told = written(told.withColumn("owner", sum((F.lit(total.n) < F.lit(b) * F.col("df")).cast("int") for b in owners) if owners else F.lit(0)))
    part = F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")
    routes = wanted.join(words, "term").select("item", "item_id", F.col("no").alias("term")).join(told, "term").withColumn("part", part)
    routes = written(routes.select("item", "item_id", "part", "term", "owner", "w", (F.col("w") * F.col("most")).alias("most")))
    owned = routes.select("term", "part", "owner", "w").distinct()
    of = routes.groupBy("item", "part").agg(*[F.collect_list(F.when(F.col("owner") == s, F.col("term"))).alias(f"terms_{s}") for s in range(len(owners) + 1)], *[F.sum(F.when(F.col("owner") >= s, F.col("most")).otherwise(0)).alias(f"reach_{s}") for s in range(len(owners) + 2)])
    of = written(of)
    none = F.array().cast("array<long>")
    state = of.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "part", "item", none.alias("docs"), none.alias("ids"), none.alias("scores"), none.alias("best"))
    salt = max(1, int(blocks**0.5))
    for s in range(len(owners) + 1):
        leading = state.select("item", "block", F.explode("best").alias("score"))
        bound = _best_of(leading, k, salt, [F.desc("score")]).where(F.col("rank") == k).select("item", F.col("score").alias("bound"))
        sent = state.drop("best").join(of.select("item", F.col(f"terms_{s}").alias("terms"), F.col(f"reach_{s}").alias("reach_now"), F.col(f"reach_{s + 1}").alias("reach_after")), "item")
        sent = sent.join(bound, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(1).cast("long"))) if s else sent.withColumn("bound", F.lit(1).cast("long"))
        gains = held.join(owned.where(F.col("owner") == s), "term").select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "part", "row", F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "term", (F.col("w") * F.col("gain")).alias("gain"))
        before, state = state, written(sent.groupBy("block", "part").cogroup(gains.groupBy("block", "part")).applyInArrow(_adder(k, s == len(owners)), _BUNDLE))
        if s:
            released(before)
        if report:
            report(s, state.agg(F.sum(F.size("docs"))).first()[0])
    found = state.select("item", "block", F.inline(F.arrays_zip(F.col("docs").alias("row"), F.col("ids").alias("at"), F.col("scores").alias("score"))))
    found = _best_of(found, k, salt, [F.desc("score"), F.col("at"), F.col("row")]).select("item", "row", "rank", "score")
    named = found.join(postings.where("term < 0").select("row", F.col("id").alias("doc_id")), "row").join(routes.select("item", "item_id").distinct(), "item")
    out = written(named.select("item_id", "rank", "doc_id", "score"))
    released(wanted, words, postings, told, routes, of, state)
    return out


SEARCH_SQL = r"""
    WITH low AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
    d AS (SELECT r, doc_id, len(t) AS n, t FROM low WHERE len(t) > 0),
    k AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
    p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, k GROUP BY term, docs),
    i AS (SELECT DISTINCT q, item_id, term FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL)),
    s AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
          FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), k GROUP BY q, item_id, r, doc_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10"""
