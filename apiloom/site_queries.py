"""Registered queries over projects written from suppliers, which hold the deeper shapes of web-service code."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.operators import audit, deps, graph, models, report, routes
from apiloom.plans.build import all_refs, build_graph, by_kind
from apiloom.plans.resolve import resolve_refs
from apiloom.queries import key_graph, once, registered
from apiloom.sources.corpus import part_projects, supplier_projects
from apiloom.sources.extract import dealt_by_size, extract_facts
from apiloom.sources.shared import deleted, shared_dir, written
from apiloom.sources.store import Store, graph_from_json, graph_to_json
from apiloom.streaming.refresh import refresh_store


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once("site facts", spark, sf_dir, lambda: written(by_kind(extract_facts(dealt_by_size(supplier_projects(spark, sf_dir))))))


def site_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return once("site graph", spark, sf_dir, lambda: build_graph(facts(spark, sf_dir), grouped=True))


_ROWS = """
WITH s AS (SELECT 'site_' || s_nationkey AS project_id, s_nationkey AS nation, CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 7 AS t, 'yard.s' || s_suppkey AS m, 'yard/s' || s_suppkey || '.py' AS file FROM supplier),
p AS (SELECT DISTINCT project_id FROM s),
r AS (SELECT s.*, method, name, local, '/v' || nation || '/o' || k || '/n/i' || local AS path, m || ':' || name || k AS fn
      FROM s, (VALUES ('GET', 'weigh', '/w'), ('PUT', 'weigh', '/w'), ('WS', 'horn', '/h')) AS v(method, name, local))
"""


@registered(_ROWS + "SELECT project_id, method, path, path AS full_paths, name || k AS handler, file, name = 'horn' AS is_async, TRUE AS mounted FROM r")
def site_routes(spark, sf_dir):
    return routes.list_routes(*site_graph(spark, sf_dir)).withColumn("full_paths", F.array_join("full_paths", " ")).drop("line")


def _edges(spark: SparkSession, sf_dir: str, kind: str, *more: str) -> DataFrame:
    return graph.select_edges(site_graph(spark, sf_dir)[1], [kind]).select("project_id", "src", "dst", *more)


@registered(_ROWS + "SELECT project_id, m || ':gate' AS src, m || ':stamp' || k AS dst FROM s UNION ALL SELECT project_id, m || ':gate', 'external:Squeeze' FROM s")
def site_middleware(spark, sf_dir):
    return _edges(spark, sf_dir, "MIDDLEWARE")


@registered(_ROWS + "SELECT project_id, m || ':weigh' || k AS src, 'template:t' || t || '.html' AS dst FROM s")
def site_renders(spark, sf_dir):
    return _edges(spark, sf_dir, "RENDERS")


@registered(_ROWS + """SELECT project_id, m || ':inner' AS src, 'yard.deep:check_badge' AS dst, 'router' AS via FROM s UNION ALL SELECT project_id, m || ':horn' || k, 'yard.deep:check_badge', 'annotated' FROM s
    UNION ALL SELECT project_id, m || ':tick' || k, m || ':tock' || k, 'param' FROM s UNION ALL SELECT project_id, m || ':tock' || k, m || ':tick' || k, 'param' FROM s""")
def site_depends_on(spark, sf_dir):
    return _edges(spark, sf_dir, "DEPENDS_ON", "via")


@registered(_ROWS + "SELECT project_id, m || ':Bin' || k AS src, 'table:bin' || k AS dst FROM s UNION ALL SELECT project_id, m || ':Rack' || k, 'table:rack_' || k FROM s")
def site_maps_to(spark, sf_dir):
    return _edges(spark, sf_dir, "MAPS_TO")


@registered(_ROWS + "SELECT project_id, m AS module, 'check_badge' AS ref, 'yard.deep:check_badge' AS id FROM s")
def site_reexports(spark, sf_dir):
    known = facts(spark, sf_dir)
    return resolve_refs(all_refs(known), known).where("kind = 'symbol' and ref = 'check_badge' and module <> 'yard.deep'").select("project_id", "module", "ref", "id")


@registered(_ROWS + """SELECT project_id, m || ':' || c || k AS id, CASE c WHEN 'Shape' THEN 'Class' ELSE 'ORMModel' END AS type FROM s, (VALUES ('Bin'), ('Shape'), ('Rack')) AS v(c)""")
def site_classes(spark, sf_dir):
    return site_graph(spark, sf_dir)[0].where("type in ('Class', 'ORMModel', 'Schema')").select("project_id", "id", "type")


@registered(_ROWS + "SELECT project_id, m || ':again' || k AS id, 'Function' AS type, 'again' || k AS name, file, CAST(NULL AS VARCHAR) AS full_paths, FALSE AS external, TRUE AS is_async FROM s")
def site_redefined(spark, sf_dir):
    """Of a function defined twice there is one node, as the later definition says."""
    nodes, _ = site_graph(spark, sf_dir)
    told = routes.describe(nodes.where("name like 'again%'")).join(nodes.select("project_id", "id", "is_async"), ["project_id", "id"])
    return told.select("project_id", "id", "type", "name", "file", F.array_join("full_paths", " ").alias("full_paths"), F.coalesce("external", F.lit(False)).alias("external"), "is_async")


@registered(_ROWS + """SELECT project_id, m || ':tick' || k AS root, m || ':' || name || k AS id, CAST(depth AS INTEGER) AS depth, circular FROM s,
    (VALUES ('tick', 0, FALSE), ('tock', 1, FALSE), ('tick', 2, TRUE)) AS v(name, depth, circular)""")
def site_circles(spark, sf_dir):
    nodes, edges = site_graph(spark, sf_dir)
    return deps.dependency_tree(nodes, edges, nodes.where("name like 'tick%'").select("project_id", "id")).select("project_id", "root", "id", "depth", "circular")


@registered(_ROWS + "SELECT project_id, 'route:' || method || ':' || fn AS route, 'dependency' AS kind, 'check_badge' AS by FROM r")
def site_extra_auth(spark, sf_dir):
    return audit.route_auth(*site_graph(spark, sf_dir), ["check_badge"])


@registered(_ROWS + "SELECT project_id, 'route:' || method || ':' || fn AS route, 'none' AS kind, CAST(NULL AS VARCHAR) AS by FROM r")
def site_no_auth(spark, sf_dir):
    """Without calls to follow, and no dependency whose name tells."""
    return audit.route_auth(*site_graph(spark, sf_dir), call_depth=0)


_EDGE_COUNTS = """, e AS (SELECT project_id, 'HAS_ROUTE' AS type FROM r UNION ALL SELECT project_id, 'HANDLED_BY' FROM r UNION ALL SELECT project_id, 'INCLUDES' FROM s, range(2) UNION ALL SELECT project_id, 'MIDDLEWARE' FROM s, range(2)
    UNION ALL SELECT project_id, 'RENDERS' FROM s UNION ALL SELECT project_id, 'MAPS_TO' FROM s, range(2) UNION ALL SELECT project_id, 'DEPENDS_ON' FROM s, range(4))
    SELECT project_id, type, count(*) AS n FROM e GROUP BY ALL"""
_COUNTED = ("HAS_ROUTE", "HANDLED_BY", "INCLUDES", "MIDDLEWARE", "RENDERS", "MAPS_TO", "DEPENDS_ON")


@registered(_ROWS + _EDGE_COUNTS)
def stored_graph(spark, sf_dir):
    """Links of a graph that was stored, read, turned to JSON and back."""
    store = Store(spark, f"{shared_dir(spark).rstrip('/')}/apiloom-store-{uuid.uuid4().hex}")
    refresh_store(store, supplier_projects(spark, sf_dir))
    _, edges = graph_from_json(graph_to_json(store.table("nodes"), store.table("edges")))
    counts = written(edges.where(F.col("type").isin(*_COUNTED)).groupBy("project_id", "type").agg(F.count("*").alias("n")))
    store.drop()
    return counts


@registered(_ROWS + """SELECT project_id, '{"from":"' || m || ':weigh' || k || '","to":"template:t' || t || '.html","type":"RENDERS"}' AS payload FROM s
    UNION ALL SELECT project_id, '{"from":"' || m || ':outer","to":"' || m || ':inner","type":"INCLUDES","prefix":"/n"}' FROM s UNION ALL SELECT project_id, '{"from":"' || m || ':gate","to":"' || m || ':outer","type":"INCLUDES","prefix":"/v' || nation || '"}' FROM s""")
def site_payload(spark, sf_dir):
    """The payload of two families of links, as text."""
    rows = report.export_payload(*site_graph(spark, sf_dir)).where("what = 'edge'")
    return rows.where(F.get_json_object("payload", "$.type").isin("RENDERS", "INCLUDES")).select("project_id", "payload")


@registered(_ROWS + """SELECT project_id, '| ' || method || ' | `' || path || '` | `' || fn || '` | — |' AS line FROM r""")
def site_report(spark, sf_dir):
    """The route lines of the reports, as text."""
    return report.report_rows(*site_graph(spark, sf_dir)).where("section = '1 routes' and place not like ' %'").select("project_id", "line")


@registered(_ROWS + """SELECT project_id, '| ' || method || ' | `' || path || '` | `' || fn || '` | — |' AS line, 'report' AS what FROM r
    UNION ALL SELECT project_id, '{"from":"' || m || ':weigh' || k || '","to":"template:t' || t || '.html","type":"RENDERS"}', 'edge' FROM s""")
def site_files(spark, sf_dir):
    """Route lines and rendering links, read back from the report and payload files of all projects."""
    path = f"{shared_dir(spark).rstrip('/')}/apiloom-files-{uuid.uuid4().hex}"
    report.write_report(*site_graph(spark, sf_dir), f"{path}/report")
    report.write_payload(*site_graph(spark, sf_dir), f"{path}/payload")
    lines = report.read_lines(spark, f"{path}/report").where("line like '| %' and line not like '| Method%'").select("project_id", "line", F.lit("report").alias("what"))
    links = report.read_lines(spark, f"{path}/payload").where(F.get_json_object("line", "$.type") == "RENDERS").select("project_id", "line", "what")
    both = written(lines.unionByName(links))
    deleted(spark, path)
    return both


_PATHS = """
    WITH n AS (SELECT count(*) AS n FROM supplier), u AS (SELECT s_suppkey % n AS i, n FROM supplier, n),
    e AS (SELECT DISTINCT a, b FROM (SELECT i AS a, (i * 7 + 3) % n AS b FROM u UNION ALL SELECT i, (i + 1) % n FROM u UNION ALL SELECT i, (i * 5 + 1) % n FROM u)),
    """


@registered("WITH RECURSIVE " + _PATHS.split("WITH ", 1)[1] + """w AS (SELECT a AS s, b AS z, [a, b] AS path FROM e WHERE a % 5 = 0 AND a <> b UNION ALL SELECT s, b, list_append(path, b) FROM w JOIN e ON e.a = w.z WHERE len(path) < 6 AND NOT list_contains(path, b)),
    t AS (SELECT s, z, list_transform(path, lambda x: lpad(CAST(x AS VARCHAR), 9, '0')) AS path FROM w, n WHERE z = (s + 10) % n), r AS (SELECT *, row_number() OVER (PARTITION BY s, z ORDER BY len(path), path) AS rank FROM t)
    SELECT lpad(CAST(s AS VARCHAR), 9, '0') AS source, lpad(CAST(z AS VARCHAR), 9, '0') AS target, CAST(rank AS INTEGER) AS rank, array_to_string(path, ' ') AS path FROM r WHERE rank <= 3""")
def ranked_paths(spark, sf_dir):
    """The three shortest paths of at most five links from every fifth supplier to the tenth after it, each being linked to three others."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = rows.count()
    at = F.col("s_suppkey") % n
    node = lambda c: F.lpad((c % n).cast("string"), 9, "0")
    links = rows.select(F.lit("keys").alias("project_id"), node(at).alias("src"), F.explode(F.array(node(at * 7 + 3), node(at + 1), node(at * 5 + 1))).alias("dst"), F.lit("CALLS").alias("type")).where("src <> dst")
    pairs = rows.where(at % 5 == 0).select(F.lit("keys").alias("project_id"), node(at).alias("source"), node(at + 10).alias("target")).where("source <> target")
    found = graph.shortest_paths(links, pairs, 3, 5).where("directed")
    return found.select("source", "target", F.col("rank").cast("int").alias("rank"), F.array_join("path", " ").alias("path"))


@registered("""WITH n AS (SELECT 'nation:' || n_nationkey AS root, 'customer:' || c_custkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey
    UNION ALL SELECT 'nation:' || n_nationkey, 'supplier:' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey),
    k AS (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY id) AS rank, count(*) OVER (PARTITION BY root) AS n FROM n)
    SELECT root, id, CAST(rank AS INTEGER) AS rank, n >= 5 AS truncated FROM k WHERE rank <= 5""")
def limited_neighbors(spark, sf_dir):
    """The first five of each nation's customers and suppliers; truncated as soon as there are five."""
    nodes, edges = key_graph(spark, sf_dir)
    roots = nodes.where("id like 'nation:%'").select("project_id", F.col("id").alias("root"))
    return graph.neighbors(edges, roots, 1, ["USES"], "in", 5).select("root", "id", F.col("rank").cast("int").alias("rank"), "truncated")


def stock_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once("stock facts", spark, sf_dir, lambda: written(by_kind(extract_facts(dealt_by_size(part_projects(spark, sf_dir))))))


def stock_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return once("stock graph", spark, sf_dir, lambda: build_graph(stock_facts(spark, sf_dir), grouped=True))


# What the projects written from parts hold: k a part, z its size, m its remainder, f its module.
_PARTS = r"""WITH s AS (SELECT 'brand_' || regexp_extract(p_brand, '(\d+)$', 1) AS project_id, CAST(p_partkey AS VARCHAR) AS k, p_size AS z, p_partkey % 9 AS m, 'stock.p' || p_partkey AS f, 'stock/p' || p_partkey || '.py' AS file FROM part) """


@registered(_PARTS + """SELECT project_id, src, type, dst, confidence FROM (
    SELECT project_id, f || ':Item' || k AS src, 'INHERITS' AS type, f || ':Root' || k AS dst, NULL::DOUBLE AS confidence FROM s UNION ALL SELECT project_id, f || ':Peer' || k, 'INHERITS', f || ':Root' || k, NULL FROM s
    UNION ALL SELECT project_id, f || ':Item' || k || 'Update', 'INHERITS', f || ':Item' || k || 'Create', NULL FROM s UNION ALL SELECT project_id, f || ':Item' || k, 'MAPS_TO', 'table:item_' || k, NULL FROM s
    UNION ALL SELECT project_id, f || ':Peer' || k, 'MAPS_TO', 'table:peer_' || m, NULL FROM s UNION ALL SELECT project_id, f || ':Item' || k, 'REFERENCES', 'table:bin_' || z, NULL FROM s
    UNION ALL SELECT project_id, f || ':Item' || k, 'RELATES_TO', f || ':Peer' || k, NULL FROM s UNION ALL SELECT project_id, f || ':Page' || k, 'USES', f || ':Item' || k || 'Update', NULL FROM s
    UNION ALL SELECT project_id, f || ':Item' || k || 'Create', 'MIRRORS', f || ':Item' || k, 0.5 FROM s UNION ALL SELECT project_id, f || ':Item' || k || 'Update', 'MIRRORS', f || ':Item' || k, 0.33 FROM s
    UNION ALL SELECT project_id, f || ':stray' || k, 'DEPENDS_ON', 'external:outside' || m, NULL FROM s)""")
def stock_links(spark, sf_dir):
    """Links of the models and schemas of every part, and dependencies that no file defines."""
    kinds = ("INHERITS", "MAPS_TO", "REFERENCES", "RELATES_TO", "USES", "MIRRORS", "DEPENDS_ON")
    return graph.select_edges(stock_graph(spark, sf_dir)[1], kinds).select("project_id", "src", "type", "dst", "confidence")


@registered(_PARTS + "SELECT project_id, file AS path, name FROM (SELECT project_id, file, unnest(['Item' || k || 'Create', 'Item' || k || 'Update', 'Page' || k]) AS name FROM s)")
def stock_models(spark, sf_dir):
    return models.list_models(stock_facts(spark, sf_dir))


@registered(_PARTS + "SELECT project_id, file AS path, 'Item' || k || 'Create' AS model, 'size_' || z || ':int: note:str:''' || m || '''' AS fields FROM s")
def stock_fields(spark, sf_dir):
    asked = stock_facts(spark, sf_dir).where("kind = 'any_class' and name like 'Item%Create'").select("project_id", "path", F.col("name").alias("model"))
    rows = models.inspect_model(stock_facts(spark, sf_dir), asked)
    each = F.transform("fields", lambda x: F.concat_ws(":", x["name"], x["type"], F.coalesce(x["default"], F.lit(""))))
    return rows.select("project_id", "path", "model", F.array_join(each, " ").alias("fields"))


@registered(_PARTS + "SELECT project_id, 'Item' || k AS orm_model, 'Item' || k || 'Update' AS schema_model, 'extra note' AS in_schema_not_in_orm, 'bin_id id' AS in_orm_not_in_schema, 'size_' || z AS matching_fields FROM s")
def stock_diff(spark, sf_dir):
    """Each part's model beside the schema that inherits its fields."""
    named = stock_facts(spark, sf_dir).where("kind = 'any_class' and name rlike '^Item[0-9]+$'")
    pairs = named.select("project_id", F.col("path").alias("orm_file"), F.col("name").alias("orm_model"), F.col("path").alias("schema_file"), F.concat("name", F.lit("Update")).alias("schema_model"))
    rows = models.schema_orm_diff(stock_facts(spark, sf_dir), pairs)
    return rows.withColumns({c: F.array_join(c, " ") for c in ("in_schema_not_in_orm", "in_orm_not_in_schema", "matching_fields")})
