"""Schemas of source files, facts, nodes and edges, and the names of types."""

from __future__ import annotations

from pyspark.sql import types as T

# The types of nodes and edges.
NODE_TYPES = ("Module", "App", "Router", "Route", "Handler", "Dependency", "Middleware", "Function", "Schema", "ORMModel", "Class", "Table", "Template")
EDGE_TYPES = ("DEFINES", "INCLUDES", "HAS_ROUTE", "HANDLED_BY", "DEPENDS_ON", "ACCEPTS", "RETURNS", "CALLS", "USES", "QUERIES", "RENDERS", "MIDDLEWARE", "INHERITS", "MAPS_TO", "REFERENCES", "RELATES_TO", "MIRRORS")
FUNCTION_TYPES = ("Function", "Handler", "Dependency", "Middleware")
CLASS_TYPES = ("Class", "Schema", "ORMModel")
MODEL_TYPES = ("Schema", "ORMModel")
#: Types shown by default in an exported graph.
CORE_TYPES = tuple(t for t in NODE_TYPES if t not in ("Function", "Class", "Module"))

_TEXTS = T.ArrayType(T.StringType())
_ORDER = T.StructType([T.StructField("path", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])


def _schema(**columns: str | T.DataType) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(name, kinds[kind] if isinstance(kind, str) else kind) for name, kind in columns.items()])


SOURCE_FILES = _schema(project_id="string", path="string", mtime_ns="long", size="long", content="binary")

#: A fact a row. ``owner``: the function or class it belongs to; ``ref``: a dotted name as written; ``ord``: its place in the file.
FACTS = _schema(
    project_id="string", path="string", module="string", is_package="boolean", kind="string", owner="string", name="string",
    ref="string", value="string", extra="string", flag="boolean", line="int", ord="int",
)

NODES = _schema(
    project_id="string", id="string", type="string", name="string", module="string", file="string", line="int", is_async="boolean", external="boolean",
    prefix="string", method="string", path="string", full_paths=_TEXTS, mounted="boolean", response_model="string", fields=_TEXTS, tablename="string",
    param_sources=T.MapType(T.StringType(), T.StringType()), orm_base="boolean", middleware="boolean", error="string", ord=_ORDER,
)
EDGES = _schema(project_id="string", src="string", dst="string", type="string", prefix="string", via="string", param="string", ops=_TEXTS, confidence="double", ord=_ORDER)
