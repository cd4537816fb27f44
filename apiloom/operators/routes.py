"""Inventories of routes, and lookup of nodes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiloom.functions.names import short_name, split_route_query
from apiloom.operators.deps import direct_dependencies
from apiloom.schemas import FUNCTION_TYPES
from apiloom.sources.shared import written


def _handled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    handlers = nodes.select("project_id", F.col("id").alias("handler_id"), F.col("name").alias("handler"), F.col("line").alias("handler_line"), F.col("is_async").alias("handler_async"))
    routes = nodes.where("type = 'Route'").join(edges.where("type = 'HANDLED_BY'").select("project_id", F.col("src").alias("id"), F.col("dst").alias("handler_id")), ["project_id", "id"])
    return routes.join(handlers, ["project_id", "handler_id"])


def list_routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, method, path, full_paths, handler, line, file, is_async, mounted), in no order: see :func:`in_listing_order`."""
    rows = _handled(nodes, edges)
    return rows.select("project_id", "method", F.col("full_paths")[0].alias("path"), "full_paths", "handler", F.col("handler_line").alias("line"), "file", F.col("handler_async").alias("is_async"), "mounted")


def in_listing_order(routes: DataFrame) -> DataFrame:
    """Rows of :func:`list_routes` as a listing shows them: by file, line and method."""
    return routes.orderBy("project_id", "file", "line", "method", "handler")


def route_summary(nodes: DataFrame, edges: DataFrame, files: Iterable[str] | None = None) -> DataFrame:
    """(project_id, file, method, path, local_path, handler, input_models, dependencies, response_model, line) of each route.

    Dependencies are named in the order in which they run.
    """
    rows = _handled(nodes, edges)
    if files is not None:
        rows = rows.where(F.col("file").isin(*files))
    direct = written(direct_dependencies(edges).select("project_id", F.col("id").alias("handler_id"), "dep", "pos"))
    accepts = edges.where("type = 'ACCEPTS'").select("project_id", F.col("src").alias("handler_id"), F.col("dst").alias("dep"), "ord")
    asked = written(direct.select("project_id", "dep").unionByName(accepts.select("project_id", "dep")).distinct())  # many rows name few
    names = written(nodes.select("project_id", F.col("id").alias("dep"), F.col("name").alias("dep_name")).join(asked, ["project_id", "dep"], "left_semi"))
    listed = lambda df, by, what: df.join(names, ["project_id", "dep"]).groupBy("project_id", "handler_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "dep_name"))), lambda x: x["dep_name"]).alias(what))
    deps, taken = listed(direct, "pos", "dependencies"), listed(accepts, "ord", "input_models")
    rows = rows.join(deps, ["project_id", "handler_id"], "left").join(taken, ["project_id", "handler_id"], "left")
    none = F.array().cast("array<string>")
    return rows.select("project_id", "file", "method", F.col("full_paths")[0].alias("path"), F.col("path").alias("local_path"), "handler", F.coalesce("input_models", none).alias("input_models"), F.coalesce("dependencies", none).alias("dependencies"), "response_model", "line")


def describe(nodes: DataFrame) -> DataFrame:
    return nodes.select("project_id", "id", "type", "name", "file", "line", "full_paths", "external")


def resolve_node(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(project_id, query, id, candidates) of each query (project_id, query): an id, ``METHOD /path``, ``/path``, or a name.

    The first of these ways that finds anything counts. Names match whole or by their last segment, and modules only
    where nothing else does. ``id`` is set if one node is found, else ``candidates`` are all, sorted. A null query finds nothing.
    """
    asked = queries.select("project_id", F.trim("query").alias("query")).distinct()
    method, path = split_route_query(F.col("query"))
    asked = asked.withColumn("method", method).withColumn("path", path)
    by_id = asked.join(nodes.select("project_id", F.col("id").alias("query"), F.col("id").alias("hit")), ["project_id", "query"]).select("project_id", "query", "hit", F.lit(0).alias("way"))
    routes = nodes.where("type = 'Route'").select("project_id", F.col("id").alias("hit"), F.col("method").alias("of"), F.explode("full_paths").alias("path"))
    by_path = asked.where(F.startswith("path", F.lit("/"))).join(routes, ["project_id", "path"]).where("method = '' or method = of").select("project_id", "query", "hit", F.lit(1).alias("way"))
    named = nodes.select("project_id", F.explode(F.array_distinct(F.array("name", short_name(F.col("name"))))).alias("query"), F.col("id").alias("hit"), (F.lit(2) + (F.col("type") == "Module").cast("int")).alias("way"))
    by_name = asked.where(~F.startswith("path", F.lit("/"))).join(named, ["project_id", "query"]).select("project_id", "query", "hit", "way")
    hits = by_id.unionByName(by_path).unionByName(by_name)
    best = hits.groupBy("project_id", "query").agg(F.min("way").alias("best"), F.sort_array(F.collect_set(F.struct("way", "hit"))).alias("all"))
    of_best = F.transform(F.filter("all", lambda x: x["way"] == F.col("best")), lambda x: x["hit"])
    every = F.array_sort(F.array_distinct(F.transform("all", lambda x: x["hit"])))
    found = best.select("project_id", "query", F.when(F.size(of_best) == 1, of_best[0]).alias("id"), F.when(F.size(of_best) > 1, F.when(F.col("best") >= 2, every).otherwise(F.array_sort(of_best))).alias("candidates"))
    none = F.array().cast("array<string>")
    return asked.select("project_id", "query").join(found, ["project_id", "query"], "left").select("project_id", "query", "id", F.coalesce("candidates", none).alias("candidates"))


def not_found(resolved: DataFrame, shown: int = 20) -> DataFrame:
    """(project_id, query, error, candidates) of the queries that found no single node; the first ``shown`` candidates."""
    error = F.when(F.size("candidates") > 0, F.concat(F.lit("'"), "query", F.lit("' is ambiguous"))).otherwise(F.concat(F.lit("'"), "query", F.lit("' not found in the knowledge graph")))
    return resolved.where("id is null").select("project_id", "query", error.alias("error"), F.slice("candidates", 1, shown).alias("candidates"))


def handler_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(project_id, name, id): function nodes of each name (project_id, name); if just one of them is a handler, that one."""
    functions = nodes.where(F.col("type").isin(*FUNCTION_TYPES))
    keyed = functions.select("project_id", F.explode(F.array_distinct(F.array("id", "name", short_name(F.col("name"))))).alias("asked"), "id", "type")
    hits = names.select("project_id", F.col("name").alias("asked")).distinct().join(keyed, ["project_id", "asked"])
    mine = Window.partitionBy("project_id", "asked")
    exact, handlers = F.max((F.col("id") == F.col("asked")).cast("int")).over(mine), F.count(F.when(F.col("type") == "Handler", 1)).over(mine)
    hits = hits.withColumn("exact", exact).withColumn("handlers", handlers).where("exact = 0 or id = asked")
    return hits.where("handlers <> 1 or type = 'Handler'").select("project_id", F.col("asked").alias("name"), "id")
