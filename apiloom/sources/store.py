"""A store of facts and graphs of many projects, kept up to date part by part."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiloom.schemas import EDGES, FACTS, NODES, SOURCE_FILES
from apiloom.sources.shared import deleted, made, written

#: Raised whenever the extractor changes what it says; what other versions stored is read by nobody.
EXTRACTOR_VERSION = 2
FILES = T.StructType([*[f for f in SOURCE_FILES.fields if f.name != "content"], T.StructField("sha1", T.StringType())])
SCHEMAS = {"files": FILES, "facts": FACTS, "nodes": NODES, "edges": EDGES}
#: What the rows of a table are bucketed by: the keys that refreshes and graph operators join on.
BUCKETED_BY = {"files": ("project_id", "path"), "facts": ("project_id", "path"), "nodes": ("project_id", "id"), "edges": ("project_id", "src")}
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
_COUNTS = "version int, name string, part int, n long"


class Store:
    """Files, facts, nodes and edges below one folder, partitioned by projects and bucketed by join keys.

    A project lies in one of ``parts`` partitions, so replacing what changed leaves the files of all other partitions
    as they are. Within them rows are bucketed alike, so two tables of a store join on their keys without a shuffle.

    A manifest says how many rows each partition has. A partition that does not read that many (a file that is no
    Parquet, is missing, or was half written) is left out, and so is everything of another extractor version: its
    files look new to :func:`apiloom.streaming.refresh.plan_refresh` and are parsed again.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, buckets: int = 4) -> None:
        self.spark, self.path, self.parts, self.buckets = spark, path.rstrip("/"), parts, buckets

    def part(self, project: str = "project_id") -> Column:
        """Partition of a project."""
        return F.pmod(F.xxhash64(project), F.lit(self.parts)).cast("int")

    def _name(self, table: str) -> str:
        return f"apiloom_store_{hashlib.sha1(self.path.encode()).hexdigest()}_{table}"

    def _open(self, table: str, checking: bool = False) -> DataFrame:
        name = self._name(table) + "_checked" * checking
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[table].fields)
            options = "OPTIONS ('ignoreCorruptFiles' 'true', 'ignoreMissingFiles' 'true')" if checking else ""
            made(self.spark, f"{self.path}/{table}")
            self.spark.sql(f"CREATE TABLE {name} ({columns}, part INT) USING parquet {options} PARTITIONED BY (part) CLUSTERED BY ({', '.join(BUCKETED_BY[table])}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
        self.spark.catalog.recoverPartitions(name)
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _manifest(self) -> dict[tuple[str, int], int]:
        """Rows of each table's partitions; none if there is no manifest of this version."""
        try:
            rows = self.spark.read.schema(_COUNTS).option("ignoreCorruptFiles", "true").parquet(f"{self.path}/manifest").where(F.col("version") == EXTRACTOR_VERSION).collect()
        except AnalysisException:
            return {}
        return {(r.name, r.part): r.n for r in rows}

    @cached_property
    def _sound(self) -> dict[str, list[int]]:
        """Partitions of each table that read whole. Files and facts stand or fall together, as do nodes and edges."""
        told = self._manifest()
        whole = set()
        for table in {name for name, _ in told}:
            counted = {r.part: r.n for r in self._open(table, checking=True).groupBy("part").agg(F.count(SCHEMAS[table].names[0]).alias("n")).collect()}
            whole |= {(table, part) for (name, part), n in told.items() if name == table and counted.get(part, 0) == n}
        both = lambda a, b: sorted(part for name, part in whole if name == a and (b, part) in whole)
        return {"files": both("files", "facts"), "facts": both("files", "facts"), "nodes": both("nodes", "edges"), "edges": both("nodes", "edges")}

    def table(self, name: str) -> DataFrame:
        """What the store holds of ``files``, ``facts``, ``nodes`` or ``edges``, broken partitions left out."""
        parts = self._sound[name]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self._open(name).where(F.col("part").isin(parts)).drop("part")

    def broken_parts(self) -> list[int]:
        """Partitions whose facts are sound and whose graph is not."""
        return sorted(set(self._sound["facts"]) - set(self._sound["nodes"]))

    def replace(self, parts: list[int], **tables: DataFrame) -> None:
        """All rows of some partitions, others stay untouched. A partition without a row is empty from now on."""
        told = {key: n for key, n in self._manifest().items() if not (key[0] in tables and key[1] in parts)}
        counts = []
        for name, rows in tables.items():
            self._open(name)
            keys = BUCKETED_BY[name]
            placed = written(rows.select(*SCHEMAS[name].names).withColumn("part", self.part()).where(F.col("part").isin(parts)))
            counts += [(EXTRACTOR_VERSION, name, r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()]
            dealt = placed.repartition(self.buckets, *keys).sortWithinPartitions("part", *keys)
            mode = self.spark.conf.get(_OVERWRITE)
            self.spark.conf.set(_OVERWRITE, "dynamic")
            try:
                dealt.write.insertInto(self._name(name), overwrite=True)
            finally:
                self.spark.conf.set(_OVERWRITE, mode)
        rows = [(EXTRACTOR_VERSION, name, part, n) for (name, part), n in told.items()] + counts
        self.spark.createDataFrame(rows, _COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")
        self.__dict__.pop("_sound", None)

    def drop(self) -> None:
        """Take the store away."""
        for name in SCHEMAS:
            for checking in (False, True):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}{'_checked' * checking}")
        deleted(self.spark, self.path)


def graph_to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, json): a row for each node and edge."""
    rows = nodes.select(F.lit("node").alias("what"), F.to_json(F.struct(*NODES.names)).alias("json"))
    return rows.unionByName(edges.select(F.lit("edge").alias("what"), F.to_json(F.struct(*EDGES.names)).alias("json")))


def graph_from_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    of = lambda what, schema: rows.where(F.col("what") == what).select(F.from_json("json", schema).alias("x")).select("x.*")
    return of("node", NODES), of("edge", EDGES)
