"""Facts kept up to date as files change: by comparing snapshots, and from a stream of file versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from apiloom.functions.names import content_hash
from apiloom.plans.build import build_graph
from apiloom.schemas import FACTS
from apiloom.sources.extract import extract_facts
from apiloom.sources.shared import released, written
from apiloom.sources.store import FILES, Store

FILE = ["project_id", "path"]


def plan_refresh(current: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(project_id, path, change): reuse, touched, changed, new or removed.

    ``current``: (project_id, path, mtime_ns, size, and sha1 or content). ``stored``: (project_id, path, mtime_ns,
    size, sha1). Same time and size: reuse. Else the same hash: touched, which keeps the facts. ``force`` makes every
    stored file changed. Nulls compare as equal to nulls.
    """
    sha1 = F.col("sha1") if "sha1" in current.columns else content_hash(F.col("content"))
    now = current.select(*FILE, F.col("mtime_ns").alias("m1"), F.col("size").alias("s1"), sha1.alias("h1"), F.lit(True).alias("here"))
    was = stored.select(*FILE, F.col("mtime_ns").alias("m0"), F.col("size").alias("s0"), F.col("sha1").alias("h0"), F.lit(True).alias("there")).dropDuplicates(FILE)
    same = F.col("m1").eqNullSafe(F.col("m0")) & F.col("s1").eqNullSafe(F.col("s0"))
    change = (
        F.when(F.col("here").isNull(), "removed").when(F.col("there").isNull(), "new").when(F.lit(force), "changed")
        .when(same, "reuse").when(F.col("h1").eqNullSafe(F.col("h0")), "touched").otherwise("changed")
    )
    return now.join(was, FILE, "full_outer").select(*FILE, change.alias("change"))


def removed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.select(*FILE).distinct().join(current.select(*FILE), FILE, "left_anti")


def refresh_facts(current: DataFrame, facts: DataFrame, plan: DataFrame) -> DataFrame:
    """Facts of the current files: those of changed and new files extracted, the rest of ``facts`` kept, removed ones gone."""
    again = current.join(plan.where("change in ('changed', 'new')").select(*FILE), FILE, "left_semi")
    kept = facts.join(plan.where("change in ('reuse', 'touched')").select(*FILE), FILE, "left_semi")
    return extract_facts(again).unionByName(kept.select(*extract_facts(again).columns))


def affected_projects(plan: DataFrame) -> DataFrame:
    """Projects whose graph must be built again."""
    return plan.where("change in ('changed', 'new', 'removed')").select("project_id").distinct()


def refresh_summary(plan: DataFrame) -> DataFrame:
    """(project_id, reparsed, reused, removed)."""
    count = lambda *kinds: F.count(F.when(F.col("change").isin(*kinds), 1))
    return plan.groupBy("project_id").agg(count("changed", "new").alias("reparsed"), count("reuse", "touched").alias("reused"), count("removed").alias("removed"))


def refresh_store(store: Store, current: DataFrame, force: bool = False) -> DataFrame:
    """Bring a store to the current files (``schemas.SOURCE_FILES``); returns the plan it went by.

    Only changed and new files are parsed, and only :func:`affected_projects` and projects whose stored graph is broken
    are linked again. What is written are the partitions that hold such a project (for a file that was merely touched,
    only its stored time), with the rows of the partition's other projects as they were.
    """
    current = current.withColumn("sha1", content_hash(F.col("content")))
    plan = written(plan_refresh(current.select(*FILES.names), store.table("files"), force))
    at = plan.select("change", store.part().alias("part")).where("change <> 'reuse'").distinct().collect()
    stale = sorted({r.part for r in at} | set(store.broken_parts()))
    changed = sorted({r.part for r in at if r.change != "touched"} | set(store.broken_parts()))
    if not stale:
        return plan
    here = lambda df, parts: df.where(store.part().isin(parts))
    files = here(current, stale).select(*FILES.names)
    if not changed:
        store.replace(stale, files=files)
        return plan
    facts = written(refresh_facts(here(current, changed), here(store.table("facts"), changed), here(plan, changed)))
    broken = here(facts, store.broken_parts()).select("project_id") if store.broken_parts() else facts.select("project_id").limit(0)
    again = written(affected_projects(plan).unionByName(broken).distinct())
    nodes, edges = build_graph(facts.join(again, "project_id", "left_semi"))
    kept = lambda name: here(store.table(name), changed).join(again, "project_id", "left_anti")
    nodes, edges = nodes.unionByName(kept("nodes")), edges.unionByName(kept("edges"))
    touched = sorted(set(stale) - set(changed))
    if touched:
        store.replace(touched, files=here(files, touched))
    store.replace(changed, files=here(files, changed), facts=facts, nodes=nodes, edges=edges)
    released(facts)
    return plan


def latest_versions(versions: DataFrame) -> DataFrame:
    """The last version of each file; one with ``deleted`` set takes the file away."""
    last = F.row_number().over(Window.partitionBy(*FILE).orderBy(F.desc("mtime_ns"), F.desc("size")))
    kept = versions.withColumn("n", last).where("n = 1").drop("n")
    return kept.where("not coalesce(deleted, false)").drop("deleted") if "deleted" in versions.columns else kept


#: Facts of a stream's store: with the version of their file. A file that is gone keeps one row of kind ``deleted``.
VERSIONED = T.StructType([*FACTS.fields, T.StructField("mtime_ns", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType())])
STREAM_PARTS = 64


def _stream_state(spark: SparkSession, facts_path: str) -> DataFrame:
    try:
        return spark.read.schema(VERSIONED).parquet(facts_path)
    except AnalysisException:
        return spark.createDataFrame([], VERSIONED)


def merge_versions(state: DataFrame, batch: DataFrame, number: int, parts: int = STREAM_PARTS) -> tuple[DataFrame, list[int]]:
    """(rows of the partitions that a batch of file versions changes, these partitions).

    Of a file the version of the latest ``mtime_ns`` stays, of equal ones that of the later batch, within a batch the
    larger one; so versions may come late or twice, and a batch that is run again changes nothing. Only versions that
    are newer than what is stored are parsed.
    """
    part = F.pmod(F.xxhash64("project_id"), F.lit(parts)).cast("int")
    last = F.row_number().over(Window.partitionBy(*FILE).orderBy(F.desc("mtime_ns"), F.desc("size")))
    files = batch.withColumn("n", last).where("n = 1").drop("n").withColumns({"part": part, "batch": F.lit(number).cast("long")})
    touched = [r.part for r in files.select("part").distinct().collect()]
    stored = state.where(F.col("part").isin(touched))
    known = stored.where("kind in ('module', 'deleted')").select(*FILE, F.struct("mtime_ns", "batch").alias("known"))
    newer = written(files.join(known, FILE, "left").where(F.col("known").isNull() | (F.struct("mtime_ns", "batch") > F.col("known"))).drop("known"))
    facts = extract_facts(newer.where("not coalesce(deleted, false)"))
    gone = newer.where("coalesce(deleted, false)").select(*[(F.lit("deleted") if c == "kind" else F.col(c) if c in FILE else F.lit(None)).cast(facts.schema[c].dataType).alias(c) for c in facts.columns])
    fresh = facts.unionByName(gone).join(newer.select(*FILE, "mtime_ns", "batch", "part"), FILE)
    changed = [r.part for r in newer.select("part").distinct().collect()]
    kept = stored.where(F.col("part").isin(changed)).join(newer.select(*FILE), FILE, "left_anti")
    return written(kept.select(*VERSIONED.names).unionByName(fresh.select(*VERSIONED.names))), changed


def stream_refresh(stream: DataFrame, facts_path: str, checkpoint: str, parts: int = STREAM_PARTS) -> StreamingQuery:
    """Facts of arriving file versions (project_id, path, mtime_ns, size, content, deleted), merged into one table.

    The table holds one version of each file, and a row for each file that was deleted, so that a late older version
    does not bring it back. A batch rewrites the partitions (by project) of the files it changes; what it costs to
    read the table does not depend on how many batches there were. :func:`stored_facts` reads it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows, _ = merge_versions(_stream_state(batch.sparkSession, facts_path), batch, number, parts)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(facts_path)
        released(rows)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_facts(spark: SparkSession, facts_path: str) -> DataFrame:
    """Current facts of a stream's store; none if nothing has arrived yet."""
    return _stream_state(spark, facts_path).where("kind <> 'deleted'").select(*FACTS.names)
