"""The cluster's shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN = "apiloom-"
#: How many bytes of rows a byte of Parquet holds, as Spark is told. Texts of facts and links repeat, so by its size on disk
#: a table of hundreds of MB would count as small and be sent through the driver to every executor.
COMPRESSION = 20.0
_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Shuffled bytes of a task. A join whose side has no more in any partition holds that side as a hash table instead of
#: sorting both by texts that begin alike; a larger or uneven one is sorted and split, as ever.
TASK_BYTES = 16 << 20
_TASK, _HASHED = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def hashed_joins(spark: SparkSession) -> None:
    """Joins of the session hold a side of small partitions as a hash table; see ``TASK_BYTES``."""
    spark.conf.set(_TASK, str(TASK_BYTES))
    spark.conf.set(_HASHED, str(TASK_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session (tests) gets an own folder; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage: an executor lost later costs no recomputation of what stands before this table.
    """
    spark = df.sparkSession
    if float(spark.conf.get(_FACTOR)) < COMPRESSION:
        spark.conf.set(_FACTOR, str(COMPRESSION))
    path = f"{shared_dir(spark).rstrip('/')}/{OWN}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for path in {p.rsplit("/", 1)[0] for p in table.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith(OWN):
                deleted(spark, path)


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def made(spark: SparkSession, path: str) -> None:
    """Make a folder, wherever Spark keeps it, if there is none."""
    where, system = _place(spark, path)
    system.mkdirs(where)


def deleted(spark: SparkSession, path: str) -> None:
    """Take a folder away."""
    where, system = _place(spark, path)
    system.delete(where, True)
