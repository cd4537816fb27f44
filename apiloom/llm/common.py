"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.sources.shared import released, shared_dir, written

__all__ = ["in_blocks", "keyed", "read_table", "released", "shared_dir", "small_batches", "text_key", "written"]

#: What one Arrow batch that goes to a Python worker holds, unless a single row is larger.
BATCH_BYTES = 8 << 20
_BATCH_OPTION = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, reduced to the named columns."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def text_key(text: str | Column = "text") -> Column:
    """64-bit key of a text. Only ever used next to the document's id, so two texts would have to share that as well."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, no_id): null ids become 0, which the key of the text tells from a real 0."""
    no_id = F.col("doc_id").isNull()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.xxhash64(no_id, F.col("text")).alias("text_key"), "text", no_id.alias("no_id"))


def in_blocks(rows: DataFrame, sizes: DataFrame, ids: list[str], most: int, weight: Column | None = None, heaviest: int = 1) -> DataFrame:
    """``rows`` (key, ids ...) with ``block``: rows of a key meet within a block.

    A key that has more than ``most`` rows in ``sizes`` (key), or rows of more than ``heaviest`` in the sum of their
    ``weight``, is dealt into parts, and a block is a pair of parts; so no block grows beyond about twice ``most`` rows or
    twice ``heaviest`` (or one row, if that is heavier), and every two rows of a key meet in one block at least.
    """
    share = F.count("*") / most
    if weight is not None:
        share = F.greatest(share, F.sum(weight) / heaviest)
    large = sizes.groupBy("key").agg(F.ceil(share).cast("int").alias("parts")).where("parts > 1")
    dealt = rows.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64(*ids), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("block", F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).drop("parts", "part", "other")


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by its bytes, the same for all operators; a lower bound that the session has stays."""
    found = (spark.conf.get(_BATCH_OPTION) or "").rstrip("bB")
    if not found.isdigit() or int(found) > BATCH_BYTES:
        spark.conf.set(_BATCH_OPTION, BATCH_BYTES)
