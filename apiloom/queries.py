"""Registered queries over the given tables, with the SQL that yields the same rows.

Two bindings: projects whose source text is written from customers and orders, parsed and linked by the library, with
SQL that derives the expected facts from the rows directly; and the tables' own keys as a graph.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.functions.names import content_hash, is_auth_name, is_likely_public, is_test_file, join_path, module_name, schema_stem, short_name
from apiloom.functions.sql import sql_tables
from apiloom.operators import audit, deps, graph, models, report, routes
from apiloom.plans.build import all_refs, build_graph, by_kind, class_ancestry
from apiloom.plans.paths import include_chains as include_chains_of
from apiloom.plans.resolve import find_module, module_index, resolve_refs
from apiloom.schemas import CLASS_TYPES, FUNCTION_TYPES, NODE_TYPES
from apiloom.sources.corpus import order_projects
from apiloom.sources.extract import dealt_by_size, extract_facts
from apiloom.sources.shared import deleted, shared_dir, written
from apiloom.sources.store import Store
from apiloom.streaming import refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_built: dict[tuple[str, str, str], object] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def once(what: str, spark: SparkSession, sf_dir: str, make: Callable[[], object]) -> object:
    """Tables that many queries share are made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once("sources", spark, sf_dir, lambda: written(order_projects(spark, sf_dir)))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once("facts", spark, sf_dir, lambda: written(by_kind(extract_facts(dealt_by_size(sources(spark, sf_dir))))))


def code_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return once("graph", spark, sf_dir, lambda: build_graph(facts(spark, sf_dir), grouped=True))


def graph_part(spark: SparkSession, sf_dir: str, node_types: tuple[str, ...], edge_types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The code graph if the session has it; else of all projects its nodes and edges of these types, for queries that need no others."""
    if (spark.sparkContext.applicationId, sf_dir, "graph") in _built:
        return code_graph(spark, sf_dir)
    return once(f"graph of {node_types}, {edge_types}", spark, sf_dir, lambda: build_graph(facts(spark, sf_dir), True, node_types, edge_types))


#: What tells of dependencies; and what a dependency or a function that is called may be.
_DEPENDENCY_EDGES = ("DEPENDS_ON", "HANDLED_BY", "HAS_ROUTE", "INCLUDES")
_DECLARED = ("App", "Router", *FUNCTION_TYPES, *CLASS_TYPES)


#: Nodes and edges that tell of routes' authentication.
_AUTH_PART = ((*_DECLARED, "Route"), (*_DEPENDENCY_EDGES, "CALLS"))
#: What summaries of routes name.
_SUMMARY_PART = ((*_DECLARED, "Route"), (*_DEPENDENCY_EDGES, "ACCEPTS"))
#: What tells which models are used: of the other edges none leads to a model, or none counts as use.
_MODEL_PART = (("ORMModel",), ("INHERITS", "ACCEPTS", "RETURNS", "USES", "DEPENDS_ON", "MIDDLEWARE", "HANDLED_BY", "QUERIES", "RENDERS", "MAPS_TO", "REFERENCES"))


def auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once("auth", spark, sf_dir, lambda: written(audit.route_auth(*graph_part(spark, sf_dir, *_AUTH_PART))))


def key_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows as nodes and foreign keys as edges."""

    def make() -> tuple[DataFrame, DataFrame]:
        kinds = (("region", "r_regionkey", "Table"), ("nation", "n_nationkey", "Schema"), ("customer", "c_custkey", "Class"), ("supplier", "s_suppkey", "Class"), ("orders", "o_orderkey", "Function"), ("part", "p_partkey", "Dependency"))
        node = lambda name, key: F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))
        nodes = [table(spark, sf_dir, name).select(F.lit("keys").alias("project_id"), node(name, key).alias("id"), F.lit(kind).alias("type"), node(name, key).alias("name")) for name, key, kind in kinds]
        links = (("nation", "nation", "n_nationkey", "region", "n_regionkey", "REFERENCES"), ("customer", "customer", "c_custkey", "nation", "c_nationkey", "USES"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "USES"), ("orders", "orders", "o_orderkey", "customer", "o_custkey", "DEPENDS_ON"), ("lineitem", "orders", "l_orderkey", "part", "l_partkey", "CALLS"))
        edges = [table(spark, sf_dir, name).select(F.lit("keys").alias("project_id"), node(a, ka).alias("src"), node(b, kb).alias("dst"), F.lit(kind).alias("type")) for name, a, ka, b, kb, kind in links]
        return written(reduce(DataFrame.unionByName, nodes)), written(reduce(DataFrame.unionByName, edges).distinct())

    return once("keys", spark, sf_dir, make)


# What the written projects hold, from the rows: f a file, h a handler.
_ROWS = """
WITH h AS (
    SELECT 'nation_' || c_nationkey AS project_id, c_custkey, o_orderkey AS k, 'app.routes.c' || c_custkey AS module,
           'app/routes/c' || c_custkey || '.py' AS file, 'h' || o_orderkey AS handler, '/o' || (o_orderkey % 40) AS local,
           'app.routes.c' || c_custkey || ':h' || o_orderkey AS fn,
           CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'DELETE' ELSE 'POST' END AS method,
           left(o_orderpriority, 1) AS pr, o_orderkey % 4 AS q, o_orderkey % 2 = 0 AS has_model, c_custkey % 10 <> 9 AS mounted,
           CASE WHEN c_custkey % 10 <> 9 THEN '/api' ELSE '' END || '/c' || c_custkey || '/o' || (o_orderkey % 40) AS path,
           o_orderstatus NOT IN ('F', 'O') AND left(o_orderpriority, 1) NOT IN ('2', '3') AS takes_body
    FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT DISTINCT project_id, c_custkey, module, file, mounted FROM h),
p AS (SELECT DISTINCT 'nation_' || c_nationkey AS project_id FROM customer)
"""
_AUTH = "CASE WHEN pr IN ('1', '2') THEN 'dependency' WHEN pr = '3' THEN 'header' WHEN pr = '4' THEN 'manual_call' ELSE 'none' END"
_BY = "CASE WHEN pr IN ('1', '2') THEN 'require_admin' WHEN pr = '3' THEN 'api_key' WHEN pr = '4' THEN 'verify_access' END"


@registered(_ROWS + "SELECT project_id, method, path, path AS full_paths, handler, file, FALSE AS is_async, mounted FROM h")
def list_routes(spark, sf_dir):
    return routes.list_routes(*code_graph(spark, sf_dir)).withColumn("full_paths", F.array_join("full_paths", " ")).drop("line")


@registered(_ROWS + "SELECT project_id, file, handler, method, local AS path, 'router' AS owner, CASE WHEN has_model THEN 'OrderPublic' END AS response_model FROM h")
def route_facts(spark, sf_dir):
    return facts(spark, sf_dir).where("kind = 'route'").select("project_id", F.col("path").alias("file"), F.col("owner").alias("handler"), F.col("name").alias("method"), F.col("value").alias("path"), F.col("ref").alias("owner"), F.col("extra").alias("response_model"))


@registered(_ROWS + """SELECT project_id, file, alias, target, attr FROM f, (VALUES ('APIRouter', 'fastapi', 'APIRouter'), ('Depends', 'fastapi', 'Depends'), ('Header', 'fastapi', 'Header'), ('Admin', 'app.deps', 'Admin'),
    ('require_admin', 'app.deps', 'require_admin'), ('verify_access', 'app.deps', 'verify_access'), ('OrderCreate', 'app.schemas', 'OrderCreate'), ('OrderPublic', 'app.schemas', 'OrderPublic')) AS i(alias, target, attr)""")
def import_facts(spark, sf_dir):
    """Of the files written from rows; the others are the same in every project."""
    rows = facts(spark, sf_dir).where("kind = 'import' and path like 'app/routes/%'")
    return rows.select("project_id", F.col("path").alias("file"), F.col("name").alias("alias"), F.col("ref").alias("target"), F.col("value").alias("attr"))


@registered(_ROWS + """SELECT project_id, file, handler AS owner, CASE pr WHEN '2' THEN 'admin' WHEN '3' THEN 'api_key' ELSE 'body' END AS name, CASE pr WHEN '3' THEN 'Header' END AS source,
    CASE pr WHEN '2' THEN 'Admin' WHEN '3' THEN 'str' ELSE 'OrderCreate' END AS type FROM h WHERE pr IN ('2', '3') OR takes_body""")
def param_facts(spark, sf_dir):
    """Of the files written from rows; the others are the same in every project."""
    rows = facts(spark, sf_dir).where("path like 'app/routes/%'")
    types = rows.where("kind = 'param_type'").select("project_id", "path", "owner", "name", F.col("ref").alias("type"))
    return rows.where("kind = 'param'").join(types, ["project_id", "path", "owner", "name"], "left").select("project_id", F.col("path").alias("file"), "owner", "name", F.col("value").alias("source"), "type")


@registered(_ROWS + "SELECT project_id, 'app.broken' AS module, 'app/broken.py' AS file, TRUE AS is_syntax_error FROM p")
def parse_errors(spark, sf_dir):
    rows = audit.parse_errors(code_graph(spark, sf_dir)[0])
    return rows.select("project_id", "module", "file", F.startswith("error", F.lit("SyntaxError: ")).alias("is_syntax_error"))


@registered(_ROWS + """, m AS (SELECT project_id, module FROM f UNION ALL SELECT project_id, x FROM p, (VALUES ('app'), ('app.routes'), ('app.deps'), ('app.models'), ('app.schemas'), ('app.broken'), ('app.main')) AS t(x))
    SELECT project_id, name, module AS found FROM (SELECT project_id, module AS name, module FROM m UNION ALL SELECT project_id, replace(module, 'app.', ''), module FROM m WHERE module LIKE 'app.%' UNION ALL
    SELECT project_id, replace(module, 'app.routes.', ''), module FROM m WHERE module LIKE 'app.routes.%')""")
def find_modules(spark, sf_dir):
    index = module_index(facts(spark, sf_dir))
    return find_module(index.select("project_id", "name"), index)


@registered(_ROWS + """SELECT DISTINCT project_id, module, ref, id FROM (SELECT project_id, module, 'router' AS ref, module || ':router' AS id FROM h UNION ALL SELECT project_id, module, 'require_admin', 'app.deps:require_admin' FROM h WHERE pr = '1'
    UNION ALL SELECT project_id, module, 'Admin', 'app.deps:Admin' FROM h WHERE pr = '2' UNION ALL SELECT project_id, module, 'verify_access', 'app.deps:verify_access' FROM h WHERE pr = '4'
    UNION ALL SELECT project_id, module, 'OrderCreate', 'app.schemas:OrderCreate' FROM h WHERE takes_body UNION ALL SELECT project_id, module, 'OrderPublic', 'app.schemas:OrderPublic' FROM h WHERE has_model)""")
def resolved_refs(spark, sf_dir):
    """Of the files written from rows; the others are the same in every project, and ``site_reexports`` has chains."""
    known = facts(spark, sf_dir)
    return resolve_refs(all_refs(known.where("path like 'app/routes/%'")), known).where("kind = 'symbol'").select("project_id", "module", "ref", "id")


_FAMILIES = {
    "has_route": ("HAS_ROUTE", "SELECT project_id, module || ':router' AS src, 'route:' || method || ':' || fn AS dst FROM h", ()),
    "handled_by": ("HANDLED_BY", "SELECT project_id, 'route:' || method || ':' || fn AS src, fn AS dst FROM h", ()),
    "includes": ("INCLUDES", "SELECT project_id, 'app.main:app' AS src, module || ':router' AS dst, '/api' AS prefix FROM f WHERE mounted", ("prefix",)),
    "accepts": ("ACCEPTS", "SELECT project_id, fn AS src, 'app.schemas:OrderCreate' AS dst, 'body' AS param FROM h WHERE takes_body", ("param",)),
    "returns": ("RETURNS", "SELECT project_id, fn AS src, 'app.schemas:OrderPublic' AS dst, 'response_model' AS via FROM h WHERE has_model", ("via",)),
    "calls": ("CALLS", "SELECT project_id, fn AS src, 'app.deps:verify_access' AS dst FROM h WHERE pr = '4'", ()),
    "depends_on": ("DEPENDS_ON", """SELECT project_id, 'route:' || method || ':' || fn AS src, 'app.deps:require_admin' AS dst, 'decorator' AS via, NULL::VARCHAR AS param FROM h WHERE pr = '1'
        UNION ALL SELECT project_id, fn, 'app.deps:require_admin', 'annotated', 'admin' FROM h WHERE pr = '2' UNION ALL SELECT project_id, 'app.deps:require_admin', 'app.deps:get_user', 'param', 'user' FROM p
        UNION ALL SELECT project_id, 'app.deps:get_user', 'app.deps:get_db', 'param', 'db' FROM p""", ("via", "param")),
    "queries": ("QUERIES", """SELECT project_id, fn AS src, 'table:customer' AS dst, 'read' AS ops FROM h WHERE q = 0 UNION ALL SELECT project_id, fn, 'table:orders', CASE WHEN q = 3 THEN 'read' ELSE 'write' END FROM h WHERE q > 0
        UNION ALL SELECT project_id, fn, 'table:part', 'read' FROM h WHERE q = 3""", ("ops",)),
    "inherits": ("INHERITS", """SELECT project_id, src, dst FROM p, (VALUES ('app.models:Customer', 'app.models:Base'), ('app.models:Order', 'app.models:Base'), ('app.models:Archive', 'app.models:Base'), ('app.schemas:OrderCreate', 'app.schemas:OrderBase'),
        ('app.schemas:OrderPublic', 'app.schemas:OrderBase')) AS t(src, dst)""", ()),
    "maps_to": ("MAPS_TO", "SELECT project_id, src, dst FROM p, (VALUES ('app.models:Customer', 'table:customer'), ('app.models:Order', 'table:orders'), ('app.models:Archive', 'table:archive')) AS t(src, dst)", ()),
    "references": ("REFERENCES", "SELECT project_id, 'app.models:Order' AS src, 'table:customer' AS dst FROM p", ()),
    "relates_to": ("RELATES_TO", "SELECT project_id, 'app.models:Customer' AS src, 'app.models:Order' AS dst FROM p", ()),
    "uses": ("USES", "SELECT project_id, 'app.schemas:OrderList' AS src, 'app.schemas:OrderPublic' AS dst, 'field' AS via FROM p", ("via",)),
    "mirrors": ("MIRRORS", "SELECT project_id, src, 'app.models:Order' AS dst, c AS confidence FROM p, (VALUES ('app.schemas:OrderBase', 1.0::DOUBLE), ('app.schemas:OrderCreate', 0.67::DOUBLE), ('app.schemas:OrderPublic', 1.0::DOUBLE)) AS t(src, c)", ("confidence",)),
    "defines": ("DEFINES", """SELECT project_id, 'module:' || module AS src, fn AS dst FROM h UNION ALL SELECT project_id, 'module:' || module, module || ':router' FROM f UNION ALL SELECT project_id, src, dst FROM p, (VALUES ('module:app.main', 'app.main:app'),
        ('module:app.deps', 'app.deps:get_db'), ('module:app.deps', 'app.deps:get_user'), ('module:app.deps', 'app.deps:require_admin'), ('module:app.deps', 'app.deps:verify_access'), ('module:app.models', 'app.models:Base'), ('module:app.models', 'app.models:Customer'),
        ('module:app.models', 'app.models:Order'), ('module:app.models', 'app.models:Archive'), ('module:app.schemas', 'app.schemas:OrderBase'), ('module:app.schemas', 'app.schemas:OrderCreate'), ('module:app.schemas', 'app.schemas:OrderPublic'),
        ('module:app.schemas', 'app.schemas:OrderList'), ('module:app.schemas', 'app.schemas:Unused'), ('app.schemas:OrderCreate', 'app.schemas:OrderCreate.check_note')) AS t(src, dst)""", ()),
}


def _family(name: str, kind: str, attributes: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = graph.select_edges(code_graph(spark, sf_dir)[1], [kind])
        return edges.select("project_id", "src", "dst", *[F.array_join(a, " ").alias(a) if a == "ops" else a for a in attributes])

    query.__name__ = f"edges_{name}"
    return query


for _name, (_kind, _sql, _attributes) in _FAMILIES.items():
    registered(_ROWS + _sql)(_family(_name, _kind, _attributes))


@registered(_ROWS + """SELECT project_id, type, count(*) AS n FROM (SELECT project_id, 'Route' AS type FROM h UNION ALL SELECT project_id, 'Handler' FROM h UNION ALL SELECT project_id, 'Module' FROM f UNION ALL SELECT project_id, 'Router' FROM f
    UNION ALL SELECT project_id, t FROM p, (VALUES ('Module'), ('Module'), ('Module'), ('Module'), ('Module'), ('Module'), ('Module'), ('App'), ('Dependency'), ('Dependency'), ('Class'), ('ORMModel'), ('ORMModel'), ('ORMModel'), ('Schema'), ('Schema'), ('Schema'),
    ('Schema'), ('Schema'), ('Function'), ('Function'), ('Table'), ('Table'), ('Table')) AS t(t) UNION ALL SELECT DISTINCT project_id, 'Table' FROM h WHERE q = 3 UNION ALL SELECT project_id, CASE WHEN count(*) FILTER (pr IN ('1', '2')) > 0 THEN 'Dependency' ELSE 'Function' END FROM h GROUP BY 1
    ) GROUP BY ALL""")
def node_type_counts(spark, sf_dir):
    """``require_admin`` is a dependency in projects of which a route uses it, else a function."""
    return code_graph(spark, sf_dir)[0].groupBy("project_id", "type").agg(F.count("*").alias("n"))


@registered(_ROWS + f"SELECT project_id, 'route:' || method || ':' || fn AS route, {_AUTH} AS kind, {_BY} AS by FROM h")
def route_auth(spark, sf_dir):
    return auth(spark, sf_dir)


@registered(_ROWS + f"SELECT project_id, {_AUTH} AS kind, count(*) AS n FROM h GROUP BY ALL")
def auth_kind_counts(spark, sf_dir):
    return audit.auth_kind_counts(auth(spark, sf_dir))


@registered(_ROWS + "SELECT project_id, 'route:' || method || ':' || fn AS route, method || ' ' || path AS name, fn AS handler, FALSE AS likely_public FROM h WHERE pr = '5' AND method <> 'GET'")
def unprotected_write_routes(spark, sf_dir):
    return audit.unprotected_write_routes(*graph_part(spark, sf_dir, *_AUTH_PART), auth(spark, sf_dir))


@registered(_ROWS + "SELECT project_id, method, path, array_to_string(list_sort(list('route:' || method || ':' || fn)), ' ') AS routes FROM h GROUP BY ALL HAVING count(*) > 1")
def duplicate_routes(spark, sf_dir):
    return audit.duplicate_routes(code_graph(spark, sf_dir)[0]).withColumn("routes", F.array_join("routes", " "))


@registered(_ROWS + "SELECT project_id, 'route:' || method || ':' || fn AS id, method || ' ' || path AS name, file FROM h WHERE NOT mounted")
def unmounted_routes(spark, sf_dir):
    return audit.unmounted_routes(code_graph(spark, sf_dir)[0]).drop("line")


@registered(_ROWS + """SELECT project_id, 'app.schemas:' || n AS id, n AS name FROM (SELECT project_id, n FROM p, (VALUES ('Unused'), ('OrderList')) AS t(n) UNION ALL
    SELECT project_id, 'OrderCreate' FROM p WHERE project_id NOT IN (SELECT project_id FROM h WHERE takes_body))""")
def unused_schemas(spark, sf_dir):
    return audit.unused_schemas(*code_graph(spark, sf_dir))


@registered(_ROWS + """SELECT project_id, 'app.models:Archive' AS id, 'Archive' AS name FROM p UNION ALL SELECT project_id, 'app.models:Customer', 'Customer' FROM p WHERE project_id NOT IN (SELECT project_id FROM h WHERE q = 0)
    UNION ALL SELECT project_id, 'app.models:Order', 'Order' FROM p WHERE project_id NOT IN (SELECT project_id FROM h WHERE q > 0)""")
def unreferenced_orm_models(spark, sf_dir):
    return audit.unreferenced_orm_models(*graph_part(spark, sf_dir, *_MODEL_PART))


@registered(_ROWS + f""", d AS (SELECT project_id, count(*) AS n FROM (SELECT project_id FROM h GROUP BY project_id, method, path HAVING count(*) > 1) GROUP BY 1)
    SELECT p.project_id, count(k) AS routes, count(*) FILTER ({_AUTH} = 'dependency') AS auth_dependency, count(*) FILTER ({_AUTH} = 'header') AS auth_header, count(*) FILTER ({_AUTH} = 'manual_call') AS auth_manual_call,
    count(*) FILTER (k IS NOT NULL AND {_AUTH} = 'none') AS auth_none, count(*) FILTER (pr = '5' AND method <> 'GET') AS unprotected_write_routes, coalesce(any_value(d.n), 0) AS duplicate_routes, count(*) FILTER (NOT mounted) AS unmounted_routes,
    2 + CAST(count(*) FILTER (takes_body) = 0 AS BIGINT) AS unused_schemas, 1 + CAST(count(*) FILTER (q = 0) = 0 AS BIGINT) + CAST(count(*) FILTER (q > 0) = 0 AS BIGINT) AS unreferenced_orm_models, 0::BIGINT AS dependency_cycles, 1::BIGINT AS parse_errors
    FROM p LEFT JOIN h USING (project_id) LEFT JOIN d ON d.project_id = p.project_id GROUP BY p.project_id""")
def audit_summary(spark, sf_dir):
    return audit.audit_summary(*code_graph(spark, sf_dir), auth=auth(spark, sf_dir))


@registered(_ROWS + """SELECT project_id, fn AS id, 'app.deps:require_admin' AS dep, 1 AS pos FROM h WHERE pr IN ('1', '2') UNION ALL SELECT project_id, 'app.deps:require_admin', 'app.deps:get_user', 1 FROM p
    UNION ALL SELECT project_id, 'app.deps:get_user', 'app.deps:get_db', 1 FROM p UNION ALL SELECT project_id, 'route:' || method || ':' || fn, 'app.deps:require_admin', 1 FROM h WHERE pr = '1'""")
def direct_dependencies(spark, sf_dir):
    return deps.direct_dependencies(graph_part(spark, sf_dir, (), _DEPENDENCY_EDGES)[1])


@registered(_ROWS + "SELECT project_id, 'route:' || method || ':' || fn AS route, 'app.deps:require_admin' AS dep, 1 AS pos FROM h WHERE pr = '1'")
def route_level_dependencies(spark, sf_dir):
    return deps.route_level_dependencies(code_graph(spark, sf_dir)[1])


@registered(_ROWS + """SELECT project_id, fn AS root, fn AS id, handler AS name, 0 AS depth, '' AS place, FALSE AS circular FROM h UNION ALL SELECT project_id, fn, id, name, depth, place, FALSE FROM h,
    (VALUES ('app.deps:require_admin', 'require_admin', 1, '1'), ('app.deps:get_user', 'get_user', 2, '1 1'), ('app.deps:get_db', 'get_db', 3, '1 1 1')) AS t(id, name, depth, place) WHERE pr IN ('1', '2')""")
def dependency_trees(spark, sf_dir):
    nodes, edges = graph_part(spark, sf_dir, _DECLARED, _DEPENDENCY_EDGES)
    return deps.dependency_tree(nodes, edges, graph.select_nodes(nodes, ["Handler"])).withColumn("place", F.array_join("place", " ")).drop("path")


@registered(_ROWS + """SELECT project_id, file, method, path, local AS local_path, handler, CASE WHEN takes_body THEN 'OrderCreate' ELSE '' END AS input_models, CASE WHEN pr IN ('1', '2') THEN 'require_admin' ELSE '' END AS dependencies,
    CASE WHEN has_model THEN 'OrderPublic' END AS response_model FROM h""")
def route_summary(spark, sf_dir):
    rows = routes.route_summary(*graph_part(spark, sf_dir, *_SUMMARY_PART))
    return rows.withColumns({c: F.array_join(c, " ") for c in ("input_models", "dependencies")}).drop("line")


@registered(_ROWS + """SELECT project_id, id, name, models, callers FROM (SELECT project_id, 'table:archive' AS id, 'archive' AS name, 'Archive' AS models, 0::BIGINT AS callers FROM p
    UNION ALL SELECT p.project_id, 'table:customer', 'customer', 'Customer', count(*) FILTER (q = 0) FROM p LEFT JOIN h USING (project_id) GROUP BY 1 UNION ALL SELECT p.project_id, 'table:orders', 'orders', 'Order', count(*) FILTER (q > 0) FROM p LEFT JOIN h USING (project_id) GROUP BY 1
    UNION ALL SELECT project_id, 'table:part', 'part', '', count(*) FROM h WHERE q = 3 GROUP BY 1)""")
def table_usage(spark, sf_dir):
    return report.table_usage(*code_graph(spark, sf_dir)).withColumn("models", F.array_join("models", " "))


@registered(_ROWS + "SELECT project_id, 'app/schemas.py' AS path, n AS name FROM p, (VALUES ('OrderBase'), ('OrderCreate'), ('OrderPublic'), ('OrderList'), ('Unused')) AS t(n)")
def list_models(spark, sf_dir):
    return models.list_models(facts(spark, sf_dir))


@registered(_ROWS + """SELECT project_id, 'OrderCreate' AS model, 'customer_id:int: note:str:''''' AS fields, 'check_note:note' AS validators, NULL::VARCHAR AS error FROM p UNION ALL
    SELECT project_id, 'Missing', '', '', 'Model ''Missing'' not found in app/schemas.py' FROM p""")
def inspect_model(spark, sf_dir):
    asked = sources(spark, sf_dir).select("project_id").distinct().select("project_id", F.lit("app/schemas.py").alias("path"), F.explode(F.array(F.lit("OrderCreate"), F.lit("Missing"))).alias("model"))
    rows = models.inspect_model(facts(spark, sf_dir), asked)
    joined = lambda c, *parts: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[F.coalesce(x[p], F.lit("")) for p in parts])), " "), F.lit(""))
    return rows.select("project_id", "model", joined("fields", "name", "type", "default").alias("fields"), joined("validators", "function", "field").alias("validators"), "error")


@registered(_ROWS + "SELECT project_id, 'OrderCreate' AS model, file AS path, handler AS function FROM h WHERE takes_body")
def find_model_usages(spark, sf_dir):
    asked = sources(spark, sf_dir).select("project_id", F.lit("OrderCreate").alias("model")).distinct()
    return models.find_model_usages(facts(spark, sf_dir), asked).drop("line")


@registered(_ROWS + "SELECT project_id, file AS path, method, local AS route_path, handler FROM h WHERE NOT has_model")
def validate_response_models(spark, sf_dir):
    return models.validate_response_models(facts(spark, sf_dir)).drop("line")


@registered(_ROWS + "SELECT project_id, 'Order' AS orm_model, 'OrderCreate' AS schema_model, 'note' AS in_schema_not_in_orm, 'id' AS in_orm_not_in_schema, 'customer_id total' AS matching_fields FROM p")
def schema_orm_diff(spark, sf_dir):
    pairs = sources(spark, sf_dir).select("project_id", F.lit("app/models.py").alias("orm_file"), F.lit("Order").alias("orm_model"), F.lit("app/schemas.py").alias("schema_file"), F.lit("OrderCreate").alias("schema_model")).distinct()
    rows = models.schema_orm_diff(facts(spark, sf_dir), pairs)
    return rows.withColumns({c: F.array_join(c, " ") for c in ("in_schema_not_in_orm", "in_orm_not_in_schema", "matching_fields")})


@registered(_ROWS + """, r AS (SELECT project_id, method || ' ' || path AS query, 'route:' || method || ':' || fn AS id FROM h) SELECT project_id, query, CASE WHEN count(*) = 1 THEN min(id) END AS id,
    CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list(id)), ' ') ELSE '' END AS candidates FROM r GROUP BY 1, 2 UNION ALL SELECT project_id, handler, fn, '' FROM h""")
def resolve_nodes(spark, sf_dir):
    nodes, _ = graph_part(spark, sf_dir, NODE_TYPES, ())
    asked = graph.select_nodes(nodes, ["Route", "Handler"]).select("project_id", F.col("name").alias("query"))
    return routes.resolve_node(nodes, asked).withColumn("candidates", F.array_join("candidates", " "))


@registered(_ROWS + "SELECT project_id, query, '''' || query || ''' is ambiguous' AS error FROM (SELECT project_id, method || ' ' || path AS query FROM h GROUP BY ALL HAVING count(*) > 1)")
def ambiguous_queries(spark, sf_dir):
    nodes, _ = code_graph(spark, sf_dir)
    asked = graph.select_nodes(nodes, ["Route"]).select("project_id", F.col("name").alias("query"))
    return routes.not_found(routes.resolve_node(nodes, asked)).drop("candidates")


@registered(_ROWS + "SELECT project_id, handler AS name, fn AS id FROM h")
def handler_nodes(spark, sf_dir):
    nodes, _ = code_graph(spark, sf_dir)
    return routes.handler_nodes(nodes, graph.select_nodes(nodes, ["Handler"]).select("project_id", "name"))


@registered(_ROWS + "SELECT project_id, 'route:' || method || ':' || fn AS id, method || ' ' || path || ' < ' || handler || ' < orders' AS via FROM h WHERE q > 0")
def impact_of_table(spark, sf_dir):
    """Routes that a change of the table orders reaches, with the chain."""
    nodes, edges = graph_part(spark, sf_dir, NODE_TYPES, (*graph.IMPACT_EDGES, "HAS_ROUTE", "INCLUDES"))
    roots = nodes.where("id = 'table:orders'").select("project_id", F.col("id").alias("root"))
    return graph.impact(nodes, edges, roots).where("type = 'Route'").select("project_id", "id", F.array_join("via", " < ").alias("via"))


@registered(_ROWS + """SELECT p.project_id, id, CASE WHEN id = 'app.deps:verify_access' THEN EXISTS (FROM h WHERE h.project_id = p.project_id AND pr = '4') ELSE core END AS core
    FROM p, (VALUES ('app.deps:verify_access', NULL), ('app.models:Base', TRUE), ('app.schemas:OrderCreate.check_note', FALSE)) AS t(id, core)
    UNION ALL SELECT project_id, 'app.deps:require_admin', TRUE FROM p WHERE project_id NOT IN (SELECT project_id FROM h WHERE pr IN ('1', '2'))""")
def core_nodes(spark, sf_dir):
    """Plain functions and classes: core where they touch a core node."""
    nodes, edges = code_graph(spark, sf_dir)
    plain = graph.select_nodes(nodes, ["Function", "Class"]).select("project_id", "id")
    return graph.core_nodes(nodes, edges).join(plain, ["project_id", "id"], "left_semi")


@registered(_ROWS + "SELECT project_id, 'app.routes.c' || c_custkey || ':router' AS owner, CASE WHEN mounted THEN '/api' ELSE '' END || '/c' || c_custkey AS prefix, mounted FROM f")
def include_chains(spark, sf_dir):
    return include_chains_of(*code_graph(spark, sf_dir))


@registered(_ROWS + "SELECT project_id, file AS path, handler FROM h")
def streamed_handlers(spark, sf_dir):
    """All files arrive as a stream; the routes of the stored facts."""
    folder = f"{shared_dir(spark).rstrip('/')}/apiloom-stream-{uuid.uuid4().hex}"
    sources(spark, sf_dir).withColumn("deleted", F.lit(False)).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    refresh.stream_refresh(stream, f"{folder}/facts", f"{folder}/checkpoint").awaitTermination()
    handlers = written(refresh.stored_facts(spark, f"{folder}/facts").where("kind = 'route'").select("project_id", "path", F.col("owner").alias("handler")))
    deleted(spark, folder)
    return handlers


@registered(_ROWS + """SELECT project_id, file AS path, CASE WHEN c_custkey % 5 = 0 THEN 'health' ELSE handler END AS handler FROM h WHERE c_custkey % 5 NOT IN (0, 1) UNION ALL SELECT project_id, file, 'health' FROM f WHERE c_custkey % 5 = 0""")
def streamed_versions(spark, sf_dir):
    """Three batches: all files; every fifth customer's file anew and every next one's gone; older versions of both, too late."""
    folder = f"{shared_dir(spark).rstrip('/')}/apiloom-stream-{uuid.uuid4().hex}"
    fifth = F.coalesce(F.regexp_extract("path", r"^app/routes/c(\d+)\.py$", 1).try_cast("long"), F.lit(2)) % 5
    files = sources(spark, sf_dir).withColumns({"mtime_ns": F.lit(2).cast("long"), "deleted": F.lit(False)})
    changed = files.where(fifth < 2).withColumns({"mtime_ns": F.lit(3).cast("long"), "deleted": fifth == 1, "content": _health()})
    late = files.where(fifth < 2).withColumns({"mtime_ns": F.lit(1).cast("long"), "content": F.lit("def late(): ...").cast("binary")})
    for batch in (files, changed, late):
        batch.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/in")
        refresh.stream_refresh(stream, f"{folder}/facts", f"{folder}/checkpoint").awaitTermination()
    handlers = written(refresh.stored_facts(spark, f"{folder}/facts").where("kind = 'route'").select("project_id", "path", F.col("owner").alias("handler")))
    deleted(spark, folder)
    return handlers


@registered(_ROWS + "SELECT project_id, count(*) + 2 AS lines FROM h GROUP BY 1")
def report_routes(spark, sf_dir):
    """Lines with a bar in each project's report: its routes, and the table's head."""
    text = report.report_text(*code_graph(spark, sf_dir))
    bars = F.filter(F.split("text", "\n"), lambda x: x.startswith("|"))
    return text.join(graph.select_nodes(code_graph(spark, sf_dir)[0], ["Route"]).select("project_id").distinct(), "project_id").select("project_id", F.size(bars).cast("long").alias("lines"))


def _payload_sql() -> str:
    """Every link's JSON text, from the families' rows, and of every node its id and type."""
    texts = {"prefix": """',"prefix":"' || prefix || '"'""", "ops": """',"ops":["' || ops || '"]'""", "confidence": "',\"confidence\":' || confidence", "via": """',"via":"' || via || '"'""", "param": """',"param":"' || param || '"'"""}
    links = []
    for kind, sql, attributes in _FAMILIES.values():
        more = "".join(f" || coalesce({text}, '')" for name, text in texts.items() if name in attributes)
        links.append(f"""SELECT project_id, 'edge' AS what, src || ' {kind} ' || dst AS id, '{{"from":"' || src || '","to":"' || dst || '","type":"{kind}"'{more} || '}}' AS payload FROM ({sql})""")
    fixed = {
        "Module": ("module:app", "module:app.routes", "module:app.deps", "module:app.models", "module:app.schemas", "module:app.broken", "module:app.main"), "App": ("app.main:app",), "Dependency": ("app.deps:get_db", "app.deps:get_user"),
        "Function": ("app.deps:verify_access", "app.schemas:OrderCreate.check_note"), "Class": ("app.models:Base",), "ORMModel": ("app.models:Customer", "app.models:Order", "app.models:Archive"),
        "Schema": tuple(f"app.schemas:{x}" for x in ("OrderBase", "OrderCreate", "OrderPublic", "OrderList", "Unused")), "Table": ("table:customer", "table:orders", "table:archive"),
    }
    values = ", ".join(f"('{i}', '{kind}')" for kind, ids in fixed.items() for i in ids)
    nodes = f"""SELECT project_id, id, type FROM p, (VALUES {values}) AS t(id, type) UNION ALL SELECT project_id, 'module:' || module, 'Module' FROM f UNION ALL SELECT project_id, module || ':router', 'Router' FROM f UNION ALL SELECT project_id, fn, 'Handler' FROM h
        UNION ALL SELECT project_id, 'route:' || method || ':' || fn, 'Route' FROM h UNION ALL SELECT DISTINCT project_id, 'table:part', 'Table' FROM h WHERE q = 3
        UNION ALL SELECT project_id, 'app.deps:require_admin', CASE WHEN count(*) FILTER (pr IN ('1', '2')) > 0 THEN 'Dependency' ELSE 'Function' END FROM h GROUP BY 1"""
    return _ROWS + " UNION ALL ".join([*links, f"""SELECT project_id, 'node', id, '{{"id":"' || id || '","type":"' || type || '"}}' FROM ({nodes})"""])


@registered(_payload_sql())
def export_payload(spark, sf_dir):
    """The payload of all links as text; of nodes, whose lines the rows do not tell, its id and type."""
    rows = report.export_payload(*code_graph(spark, sf_dir))
    part = F.to_json(F.struct(F.get_json_object("payload", "$.id").alias("id"), F.get_json_object("payload", "$.type").alias("type")))
    return rows.withColumn("payload", F.when(F.col("what") == "node", part).otherwise(F.col("payload")))


@registered(_ROWS + "SELECT project_id, 'app/routes/c' || c_custkey || '.py' AS path, 'app.routes.c' || c_custkey AS module, FALSE AS is_test FROM f")
def module_names(spark, sf_dir):
    rows = sources(spark, sf_dir).where("path like 'app/routes/c%'")
    return rows.select("project_id", "path", module_name(F.col("path")).alias("module"), is_test_file(F.col("path")).alias("is_test"))


_KEYS = """
WITH e AS (
    SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'REFERENCES' AS type FROM nation
    UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'USES' FROM customer
    UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'USES' FROM supplier
    UNION SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'DEPENDS_ON' FROM orders
    UNION SELECT 'orders:' || l_orderkey, 'part:' || l_partkey, 'CALLS' FROM lineitem)
"""


@registered(_KEYS + """, n AS (SELECT 'Table' AS t, count(*) AS n FROM region UNION ALL SELECT 'Schema', count(*) FROM nation UNION ALL SELECT 'Class', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
    UNION ALL SELECT 'Function', count(*) FROM orders UNION ALL SELECT 'Dependency', count(*) FROM part) SELECT 'keys' AS project_id, 'node_type' AS what, t AS name, n FROM n UNION ALL SELECT 'keys', 'node', '', CAST(sum(n) AS BIGINT) FROM n
    UNION ALL SELECT 'keys', 'edge_type', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'keys', 'edge', '', count(*) FROM e""")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(*key_graph(spark, sf_dir))


@registered(_KEYS + "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id")
def degree(spark, sf_dir):
    return graph.degree(key_graph(spark, sf_dir)[1]).drop("project_id")


@registered(_KEYS + """, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), r AS (SELECT *, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM d WHERE NOT starts_with(id, 'region:'))
    SELECT CAST(rank AS INTEGER) AS rank, id, degree FROM r WHERE rank <= 10""")
def hubs(spark, sf_dir):
    return graph.hubs(*key_graph(spark, sf_dir)).select("rank", "id", "degree")


@registered(_KEYS + """SELECT e.dst AS root, e.src AS id, e.type AS edge, 'in' AS direction, e.dst AS "from", 1 AS distance FROM e WHERE starts_with(dst, 'nation:') UNION ALL
    SELECT a.dst, b.src, b.type, 'in', a.src, 2 FROM e a JOIN e b ON b.dst = a.src WHERE starts_with(a.dst, 'nation:')""")
def neighbors(spark, sf_dir):
    """All that leads to each nation in two steps."""
    nodes, edges = key_graph(spark, sf_dir)
    roots = nodes.where("type = 'Schema'").select("project_id", F.col("id").alias("root"))
    return graph.neighbors(edges, roots, 2, None, "in", None).select("root", "id", "edge", "direction", "from", "distance")


_IMPACT = _KEYS + """, i AS (SELECT dst AS root, src AS id, 1 AS distance FROM e WHERE starts_with(dst, 'region:') UNION ALL SELECT a.dst, b.src, 2 FROM e a JOIN e b ON b.dst = a.src WHERE starts_with(a.dst, 'region:')
    UNION ALL SELECT a.dst, c.src, 3 FROM e a JOIN e b ON b.dst = a.src JOIN e c ON c.dst = b.src WHERE starts_with(a.dst, 'region:')),
    g AS (SELECT *, CASE split_part(id, ':', 1) WHEN 'nation' THEN 'schemas' WHEN 'orders' THEN 'functions' ELSE 'classes' END AS "group" FROM i)
"""


@registered(_IMPACT + 'SELECT root, id, "group", distance FROM g')
def impact(spark, sf_dir):
    nodes, edges = key_graph(spark, sf_dir)
    return graph.impact(nodes, edges, nodes.where("type = 'Table'").select("project_id", F.col("id").alias("root"))).select("root", "id", "group", "distance")


@registered(_IMPACT + 'SELECT root, "group", count(*) AS n FROM g GROUP BY ALL')
def impact_summary(spark, sf_dir):
    nodes, edges = key_graph(spark, sf_dir)
    return graph.impact_summary(graph.impact(nodes, edges, nodes.where("type = 'Table'").select("project_id", F.col("id").alias("root")))).drop("project_id")


@registered(_KEYS + """SELECT a.src AS source, b.dst AS target, TRUE AS directed, a.src || ' > ' || a.dst || ' > ' || b.dst AS path, a.type || ' > ' || b.type AS edges FROM e a JOIN e b ON b.src = a.dst WHERE starts_with(a.src, 'supplier:')
    UNION ALL SELECT b.dst, a.src, FALSE, b.dst || ' > ' || a.dst || ' > ' || a.src, b.type || ' (reversed) > ' || a.type || ' (reversed)' FROM e a JOIN e b ON b.src = a.dst WHERE starts_with(a.src, 'supplier:')""")
def shortest_paths(spark, sf_dir):
    """From each supplier to its region, and back against the edges' direction; orders stand on no such path."""
    _, edges = key_graph(spark, sf_dir)
    to_nation = edges.where("src like 'supplier:%'").select("project_id", F.col("src").alias("source"), F.col("dst").alias("mid"))
    pairs = to_nation.join(edges.where("src like 'nation:%'").select("project_id", F.col("src").alias("mid"), F.col("dst").alias("target")), ["project_id", "mid"]).select("project_id", "source", "target")
    pairs = pairs.unionByName(pairs.select("project_id", F.col("target").alias("source"), F.col("source").alias("target")))
    used = edges.where("src not like 'orders:%'")
    found = graph.shortest_paths(used, pairs, 1, 4)
    return found.select("source", "target", "directed", F.array_join("path", " > ").alias("path"), F.array_join("edges", " > ").alias("edges"))


@registered("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), w(a, b, k, path) AS (SELECT s_suppkey, (s_suppkey * 7 + 3) % n, 1, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier, n UNION ALL
    SELECT a, (b * 7 + 3) % n, k + 1, path || ' ' || lpad(CAST(b AS VARCHAR), 9, '0') FROM w, n WHERE b > a AND k < 40) SELECT path AS cycle FROM w WHERE a = b""")
def dependency_cycles(spark, sf_dir):
    """Cycles of the links from each supplier s to (7 s + 3) modulo their number."""
    suppliers = table(spark, sf_dir, "supplier")
    n = suppliers.count()
    node = lambda c: F.lpad(c.cast("string"), 9, "0")
    links = suppliers.select(F.lit("keys").alias("project_id"), node(F.col("s_suppkey")).alias("src"), node((F.col("s_suppkey") * 7 + 3) % n).alias("dst"), F.lit("DEPENDS_ON").alias("type"))
    return graph.dependency_cycles(links, None, 40).select(F.array_join("cycle", " ").alias("cycle"))


@registered("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), w(a, b, k) AS (SELECT s_suppkey % n, (s_suppkey * 7 + 3) % n, 1 FROM supplier, n UNION ALL SELECT a, (b * 7 + 3) % n, k + 1 FROM w, n WHERE a <> b AND k < n)
    SELECT lpad(CAST(x.a AS VARCHAR), 9, '0') AS id, lpad(CAST(max(y.b) AS VARCHAR), 9, '0') AS component FROM (SELECT a FROM w WHERE a = b) x JOIN w y ON x.a = y.a GROUP BY x.a""")
def circle_members(spark, sf_dir):
    """Each supplier on a circle of the links from s to (7 s + 3) modulo their number, however long, with the circle's largest."""
    suppliers = table(spark, sf_dir, "supplier")
    n = suppliers.count()
    node = lambda c: F.lpad((c % n).cast("string"), 9, "0")
    links = suppliers.select(F.lit("keys").alias("project_id"), node(F.col("s_suppkey")).alias("src"), node(F.col("s_suppkey") * 7 + 3).alias("dst"))
    return graph.strong_components(links).select("id", "component")


@registered(_ROWS + """SELECT project_id, fn AS root, fn AS id, handler AS name, CASE WHEN pr IN ('1', '2') THEN 'app.deps:require_admin' END AS dep, 1::BIGINT AS ways, FALSE AS circular FROM h UNION ALL SELECT project_id, fn, id, name, dep, 1, FALSE FROM h,
    (VALUES ('app.deps:require_admin', 'require_admin', 'app.deps:get_user'), ('app.deps:get_user', 'get_user', 'app.deps:get_db'), ('app.deps:get_db', 'get_db', NULL)) AS t(id, name, dep) WHERE pr IN ('1', '2')""")
def dependency_dags(spark, sf_dir):
    nodes, edges = graph_part(spark, sf_dir, _DECLARED, _DEPENDENCY_EDGES)
    return deps.dependency_dag(nodes, edges, graph.select_nodes(nodes, ["Handler"])).drop("pos")


@registered(_KEYS + "SELECT id, ancestor FROM (SELECT src AS id, dst AS ancestor FROM e WHERE type <> 'CALLS' UNION SELECT a.src, b.dst FROM e a JOIN e b ON b.src = a.dst WHERE a.type <> 'CALLS' UNION SELECT a.src, c.dst FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst WHERE a.type <> 'CALLS')")
def ancestry(spark, sf_dir):
    edges = key_graph(spark, sf_dir)[1].where("type <> 'CALLS'")
    return class_ancestry(edges.select("project_id", F.col("src").alias("id"), F.col("dst").alias("base"))).drop("project_id")


@registered(_KEYS + "SELECT 'part:' || p_partkey AS id FROM part WHERE 'part:' || p_partkey NOT IN (SELECT dst FROM e)")
def unlinked_parts(spark, sf_dir):
    """The anti join behind the audits of unused nodes, over parts that no order has."""
    nodes, edges = key_graph(spark, sf_dir)
    parts = graph.select_nodes(nodes, ["Dependency"])
    return parts.join(graph.in_edges(edges, parts).select("project_id", F.col("dst").alias("id")), ["project_id", "id"], "left_anti").select("id")


@registered("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'customer:write nation:read' WHEN 1 THEN 'orders_' || o_custkey || ':write' ELSE '' END AS tables FROM orders""")
def sql_table_uses(spark, sf_dir):
    key, name = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.when(key % 3 == 0, F.concat(F.lit("WITH x AS (SELECT 'from "), name, F.lit("' FROM nation) DELETE FROM customer USING x WHERE id = "), name)).when(key % 3 == 1, F.concat(F.lit("insert into Orders_"), name, F.lit("(id) values (1)"))).otherwise(F.concat(F.lit("update the list "), name))
    each = F.transform(sql_tables(text), lambda t: F.concat_ws(":", t["table"], t["op"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(each, " ").alias("tables"))


@registered("""SELECT p_partkey, regexp_extract('P' || p_partkey || s, '^(InDB|.+?)(?:Create|Update|Patch|Public|Private|Read|Out|In|InDB|DB|Base|Response|Request|Schema|Detail|Summary|List|Item)*$', 1) AS stem,
    '/' || p_brand || '/x' || p_partkey || '/' AS path, 'auth' || p_partkey LIKE '%auth%' AS is_auth, 'b' || p_partkey AS short, FALSE AS is_public FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'Create' WHEN 1 THEN 'UpdateInDB' WHEN 2 THEN 'ItemPublic' ELSE '' END AS s FROM part)""")
def scalar_functions(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    suffix = F.element_at(F.array(F.lit("Create"), F.lit("UpdateInDB"), F.lit("ItemPublic"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", schema_stem(F.concat(F.lit("P"), key, suffix)).alias("stem"), join_path(F.lit("/"), F.concat(F.lit("/"), "p_brand", F.lit("/")), F.concat(F.lit("x"), key, F.lit("/"))).alias("path"),
        is_auth_name(F.concat(F.lit("a.auth"), key)).alias("is_auth"), short_name(F.concat(F.lit("a.b"), key)).alias("short"), is_likely_public(F.concat(F.lit("x"), key)).alias("is_public"),
    )


_SNAPSHOTS = """WITH was AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS path, 1 AS m, n_chars AS s, text AS t FROM documents WHERE doc_id % 7 <> 0),
    now AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS m, n_chars AS s, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 11 <> 0),
    c AS (SELECT coalesce(now.project_id, was.project_id) AS project_id, coalesce(now.path, was.path) AS path, CASE WHEN now.path IS NULL THEN 'removed' WHEN was.path IS NULL THEN 'new' WHEN now.m = was.m AND now.s = was.s THEN 'reuse'
    WHEN now.t = was.t THEN 'touched' ELSE 'changed' END AS change FROM now FULL JOIN was ON now.project_id = was.project_id AND now.path = was.path) """


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of all documents: ids divisible by 7 are new, by 11 gone, by 5 touched, by 10 changed."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    files = docs.select("doc_id", F.col("source").alias("project_id"), key.cast("string").alias("path"), F.col("n_chars").alias("size"), "text")
    stored = files.where(key % 7 != 0).select("project_id", "path", F.lit(1).cast("long").alias("mtime_ns"), "size", content_hash(F.col("text").cast("binary")).alias("sha1"))
    now = files.where(key % 11 != 0).select("project_id", "path", F.when(key % 5 == 0, 2).otherwise(1).cast("long").alias("mtime_ns"), "size", F.when(key % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return refresh.plan_refresh(now, stored)


@registered(_SNAPSHOTS + "SELECT * FROM c")
def plan_refresh(spark, sf_dir):
    return _plan(spark, sf_dir)


@registered(_SNAPSHOTS + "SELECT project_id, count(*) FILTER (change IN ('changed', 'new')) AS reparsed, count(*) FILTER (change IN ('reuse', 'touched')) AS reused, count(*) FILTER (change = 'removed') AS removed FROM c GROUP BY 1")
def refresh_summary(spark, sf_dir):
    return refresh.refresh_summary(_plan(spark, sf_dir))


@registered(_SNAPSHOTS + "SELECT DISTINCT project_id FROM c WHERE change IN ('changed', 'new', 'removed')")
def affected_projects(spark, sf_dir):
    return refresh.affected_projects(_plan(spark, sf_dir))


def _health() -> F.Column:
    """A file with a single route."""
    return F.lit("from fastapi import APIRouter\nrouter = APIRouter()\n@router.get('/x')\ndef health():\n    pass\n").cast("binary")


@registered(_ROWS + """SELECT project_id, file AS path, CASE WHEN c_custkey % 3 = 0 THEN 'health' ELSE 'h' || CAST(k AS VARCHAR) END AS handler FROM h WHERE c_custkey % 3 <> 0 UNION ALL SELECT project_id, file, 'health' FROM f WHERE c_custkey % 3 = 0""")
def refreshed_handlers(spark, sf_dir):
    """Every third customer's file is replaced by one with a single route; only those are parsed again."""
    key = F.regexp_extract("path", r"^app/routes/c(\d+)\.py$", 1)
    again = (key != "") & (F.coalesce(key.try_cast("long"), F.lit(1)) % 3 == 0)
    was = sources(spark, sf_dir)
    now = was.withColumn("mtime_ns", F.when(again, 1).otherwise(F.col("mtime_ns"))).withColumn("content", F.when(again, _health()).otherwise(F.col("content")))
    plan = refresh.plan_refresh(now, was.withColumn("sha1", content_hash(F.col("content"))))
    return refresh.refresh_facts(now, facts(spark, sf_dir), plan).where("kind = 'route'").select("project_id", "path", F.col("owner").alias("handler"))


@registered(_ROWS + """, r AS (SELECT *, split_part(project_id, '_', 2)::INT % 4 = 1 AS edited, split_part(project_id, '_', 2)::INT % 4 = 2 AS gone FROM h),
    n AS (SELECT *, edited AND c_custkey % 3 = 0 AS again FROM r WHERE NOT gone)
    SELECT project_id, 'route:' || method || ':' || fn AS src, fn AS dst FROM n WHERE NOT again UNION ALL SELECT DISTINCT project_id, 'route:GET:' || module || ':health', module || ':health' FROM n WHERE again""")
def refreshed_store(spark, sf_dir):
    """A store of all projects brought to a snapshot in which every fourth project lost some handlers and every next one is gone."""
    store = Store(spark, f"{shared_dir(spark).rstrip('/')}/apiloom-store-{uuid.uuid4().hex}")
    was = sources(spark, sf_dir)
    refresh.refresh_store(store, was)
    fourth = F.regexp_extract("project_id", r"_(\d+)$", 1).cast("int") % 4
    again = (fourth == 1) & (F.coalesce(F.regexp_extract("path", r"^app/routes/c(\d+)\.py$", 1).try_cast("long"), F.lit(1)) % 3 == 0)
    now = was.where(fourth != 2).withColumns({"mtime_ns": F.when(again, 1).otherwise(F.col("mtime_ns")), "content": F.when(again, _health()).otherwise(F.col("content"))})
    refresh.refresh_store(store, now)
    handled = written(store.table("edges").where("type = 'HANDLED_BY'").select("project_id", "src", "dst"))
    store.drop()
    return handled
