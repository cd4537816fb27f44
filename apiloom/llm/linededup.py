"""Removal of repeated runs of lines across a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiloom.llm.common import text_key, written


def line_windows(docs: DataFrame, lines: int = 3) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2) for each run of ``lines`` consecutive lines; 128 bits name its content."""
    parts = docs.select("doc_id", text_key().alias("text_key"), F.split("text", "\n").alias("l")).where(F.size("l") >= lines)
    run = lambda i: [F.col("l")[i + k] for k in range(lines)]
    hashed = F.transform(F.sequence(F.lit(0), F.size("l") - lines), lambda i: F.struct(F.xxhash64(*run(i)).alias("h1"), F.xxhash64(F.lit("second"), *run(i)).alias("h2")))
    return parts.select("doc_id", "text_key", F.posexplode(hashed).alias("pos", "h")).select("doc_id", "text_key", "pos", "h.h1", "h.h2")


def dedup_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """``docs`` with ``text`` cut, and n_lines, n_removed added.

    Every run of ``lines`` consecutive lines that also begins earlier (by doc_id, then text, then position) is removed;
    overlapping runs merge. Runs are found over the whole corpus: the first of each is a minimum, combined before the
    shuffle, so a run that a third of all rows hold costs a row for each task.

    A text of fewer lines has no run and stays as it is. A null text stays null, with no lines; an empty one has one
    empty line. Rows that agree in doc_id and text count as one document and get equal results; a null doc_id sorts
    first. Other columns pass through; one named n_lines or n_removed is replaced. An empty table gives no rows.
    """
    runs = line_windows(docs.select("doc_id", "text"), lines)
    # Texts under one id come in their own order: each has its place among them, 0 for all others.
    same = docs.select("doc_id", "text", text_key().alias("text_key")).where("text is not null")
    several = written(same.groupBy("doc_id").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select(F.col("doc_id").alias("s_doc")))
    ranked = same.join(several, same.doc_id.eqNullSafe(several.s_doc), "left_semi").distinct()
    ranked = written(ranked.withColumn("nth", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text"))).select(F.col("doc_id").alias("r_doc"), F.col("text_key").alias("r_key"), "nth"))
    runs = runs.join(ranked, runs.doc_id.eqNullSafe(ranked.r_doc) & (runs.text_key == ranked.r_key), "left").select(*runs.columns, F.coalesce("nth", F.lit(0)).alias("nth"))
    place = F.struct("doc_id", "nth", "text_key", "pos")
    first = runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = runs.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    cover = F.flatten(F.transform(F.collect_list("pos"), lambda p: F.sequence(p, p + (lines - 1))))
    cut = later.groupBy("doc_id", "text_key").agg(F.array_distinct(cover).alias("__cover")).withColumnsRenamed({"doc_id": "__doc", "text_key": "__text"})
    rows = docs.join(cut, docs.doc_id.eqNullSafe(cut["__doc"]) & (text_key(docs.text) == cut["__text"]), "left").drop("__doc", "__text")
    # A text is split once, by its own projection, and the lines that stay are taken by their places.
    rows = rows.withColumn("__lines", F.when(F.col("__cover").isNotNull(), F.split("text", "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__cover"))
    text = F.when(F.col("__cover").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n"))
    zero = F.lit(0).cast("long")
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    out = rows.withColumn("__text", text).withColumn("n_lines", F.when(F.col("text").isNull(), zero).otherwise(n_lines.cast("long")))
    out = out.withColumn("n_removed", F.when(F.col("__cover").isNull(), zero).otherwise(F.size("__cover").cast("long")))
    return out.withColumn("text", F.col("__text")).drop("__cover", "__text", "__lines")
