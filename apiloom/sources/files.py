"""Source files of many projects as a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no project sources.
EXCLUDED_DIRS = ("venv", ".venv", "env", ".env", ".git", "node_modules", "__pycache__", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "build", "dist", "site-packages")


def is_project_source(path: Column, excluded: tuple[str, ...] = EXCLUDED_DIRS) -> Column:
    """A path below a project's root is a Python file outside excluded folders."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return path.endswith(".py") & ~F.exists(folders, lambda d: d.isin(*excluded) | d.endswith(".egg-info"))


def decode_source(content: Column) -> Column:
    """UTF-8 text; bytes that are none become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def read_source_files(spark: SparkSession, roots: Mapping[str, str], excluded: tuple[str, ...] = EXCLUDED_DIRS) -> DataFrame:
    """(project_id, path, mtime_ns, size, content) of every Python file below each project's root.

    ``roots``: project_id to folder. Excluded folders are told by the path below the root alone, so a root may itself
    lie in one.
    """
    parts = []
    for project, root in roots.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(root)
        base = root.rstrip("/").split("://")[-1].removeprefix("file:")
        below = F.regexp_extract("path", rf"^(?:\w+:/*)?(?:/?\Q{base.lstrip('/')}\E)/+(.*)$", 1)
        rows = files.select(F.lit(project).alias("project_id"), below.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), "content")
        parts.append(rows.where(is_project_source(F.col("path"), excluded)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
