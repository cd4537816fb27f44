"""Audits: authentication of routes, duplicates, what nothing uses, and their summary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiloom.functions.names import WRITE_METHODS, is_auth_header, is_auth_name, is_likely_public
from apiloom.operators.deps import direct_dependencies
from apiloom.operators.graph import dependency_cycles
from apiloom.sources.shared import written


def _guards(nodes: DataFrame, rows: DataFrame, key: str, extra_auth: Iterable[str]) -> DataFrame:
    """(project_id, ``key``, name, is_auth) of the nodes that ``rows`` name: many rows name few."""
    asked = written(rows.select("project_id", key).distinct())
    named = nodes.select("project_id", F.col("id").alias(key), "name").join(asked, ["project_id", key], "left_semi")
    return written(named.withColumn("is_auth", is_auth_name(F.col("name"), tuple(extra_auth))))


def auth_by_dependency(nodes: DataFrame, edges: DataFrame, extra_auth: Iterable[str] = ()) -> DataFrame:
    """(project_id, route, by): the guard among a route's transitive dependencies that a stack search meets first.

    Of each dependency only the least key is kept, the reversed ordinals of the way to it; keys are lowered until none
    changes (a way round a circle only makes a key greater), and nothing is searched beyond a guard.
    """
    direct = written(direct_dependencies(edges))
    guards = _guards(nodes, direct, "dep", extra_auth)
    handled = edges.where("type = 'HANDLED_BY'").select("project_id", F.col("src").alias("route"), F.col("dst").alias("id"))
    best = handled.join(direct, ["project_id", "id"]).groupBy("project_id", "route", "dep").agg(F.min(F.array(-F.col("pos"))).alias("key"))
    best = changed = written(best.join(guards, ["project_id", "dep"]))
    while True:
        more = changed.where("not is_auth").select("project_id", "route", F.col("dep").alias("id"), "key").join(direct, ["project_id", "id"])
        more = more.groupBy("project_id", "route", "dep").agg(F.min(F.concat("key", F.array(-F.col("pos")))).alias("new"))
        changed = more.join(best.select("project_id", "route", "dep", "key"), ["project_id", "route", "dep"], "left").where("key is null or new < key")
        changed = written(changed.select("project_id", "route", "dep", F.col("new").alias("key")).join(guards, ["project_id", "dep"]))
        if changed.isEmpty():
            break
        best = written(best.join(changed.select("project_id", "route", "dep"), ["project_id", "route", "dep"], "left_anti").unionByName(changed.select(*best.columns)))
    return best.where("is_auth").groupBy("project_id", "route").agg(F.min_by("name", "key").alias("by"))


def auth_by_header(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, route, by): a handler's first Header parameter whose name tells of authentication."""
    handled = edges.where("type = 'HANDLED_BY'").select("project_id", F.col("src").alias("route"), F.col("dst").alias("id"))
    params = nodes.where("param_sources is not null").select("project_id", "id", F.posexplode("param_sources").alias("at", "param", "source"))
    found = params.where("source = 'Header'").where(is_auth_header(F.col("param"))).join(handled, ["project_id", "id"])
    return found.groupBy("project_id", "route").agg(F.min_by("param", "at").alias("by"))


def auth_by_call(nodes: DataFrame, edges: DataFrame, extra_auth: Iterable[str] = (), call_depth: int = 2) -> DataFrame:
    """(project_id, route, by): the first function called, at most ``call_depth`` calls away, whose name tells of authentication."""
    calls = edges.where("type = 'CALLS'").select("project_id", F.col("src").alias("at"), F.col("dst").alias("callee"), "ord")
    guards = _guards(nodes, calls, "callee", extra_auth)
    handled = edges.where("type = 'HANDLED_BY'").select("project_id", F.col("src").alias("route"), F.col("dst").alias("at"))
    level = handled.select("project_id", "route", "at", F.array().cast(f"array<{calls.schema['ord'].dataType.simpleString()}>").alias("way"))
    seen, found = handled.select("project_id", "route", F.col("at").alias("callee")), level.select("project_id", "route", F.lit(None).cast("string").alias("name"), "way").limit(0)
    for _ in range(call_depth):
        step = level.join(calls, ["project_id", "at"]).join(seen, ["project_id", "route", "callee"], "left_anti")
        step = step.groupBy("project_id", "route", "callee").agg(F.min(F.concat("way", F.array("ord"))).alias("way"))
        step = written(step.join(guards, ["project_id", "callee"]))
        hit = step.where("is_auth").select("project_id", "route", "name", "way")
        found = found.unionByName(hit)
        seen = seen.unionByName(step.select("project_id", "route", "callee"))
        level = step.where("not is_auth").select("project_id", "route", F.col("callee").alias("at"), "way")
    return found.groupBy("project_id", "route").agg(F.min_by("name", F.struct(F.size("way"), "way")).alias("by"))


def route_auth(nodes: DataFrame, edges: DataFrame, extra_auth: Iterable[str] = (), call_depth: int = 2) -> DataFrame:
    """(project_id, route, kind, by) for every route: dependency, header, manual_call, or none, in this order."""
    out = nodes.where("type = 'Route'").select("project_id", F.col("id").alias("route"))
    ways = (("dependency", auth_by_dependency(nodes, edges, extra_auth)), ("header", auth_by_header(nodes, edges)), ("manual_call", auth_by_call(nodes, edges, extra_auth, call_depth)))
    for kind, rows in ways:
        out = out.join(rows.withColumnRenamed("by", kind), ["project_id", "route"], "left")
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k, _ in ways], F.lit("none"))
    return out.select("project_id", "route", kind.alias("kind"), F.coalesce(*[F.col(k) for k, _ in ways]).alias("by"))


def auth_kind_counts(auth: DataFrame) -> DataFrame:
    return auth.groupBy("project_id", "kind").agg(F.count("*").alias("n"))


def unprotected_write_routes(nodes: DataFrame, edges: DataFrame, auth: DataFrame) -> DataFrame:
    """(project_id, route, name, handler, likely_public): routes that write and have no authentication."""
    writes = nodes.where(F.col("type") == "Route").where(F.col("method").isin(*WRITE_METHODS)).select("project_id", F.col("id").alias("route"), "name")
    handled = edges.where("type = 'HANDLED_BY'").select("project_id", F.col("src").alias("route"), F.col("dst").alias("handler"))
    open_ = writes.join(auth.where("kind = 'none'"), ["project_id", "route"]).join(handled, ["project_id", "route"])
    return open_.select("project_id", "route", "name", "handler", (is_likely_public(F.col("name")) | is_likely_public(F.col("handler"))).alias("likely_public"))


def duplicate_routes(nodes: DataFrame) -> DataFrame:
    """(project_id, method, path, routes): method and path that more than one route answers."""
    each = nodes.where("type = 'Route'").select("project_id", "method", F.explode("full_paths").alias("path"), "id")
    return each.groupBy("project_id", "method", "path").agg(F.sort_array(F.collect_list("id")).alias("routes")).where(F.size("routes") > 1)


def unmounted_routes(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'Route' and not mounted").select("project_id", "id", "name", "file", "line")


def parse_errors(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'Module' and error is not null").select("project_id", F.col("name").alias("module"), "file", "error")


def _without(nodes: DataFrame, edges: DataFrame, kind: str, ignored: tuple[str, ...]) -> DataFrame:
    used = edges.where(~F.col("type").isin(*ignored)).select("project_id", F.col("dst").alias("id"))
    return nodes.where(F.col("type") == kind).join(used, ["project_id", "id"], "left_anti")


def unused_schemas(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, id, name): schemas that nothing but their definition links to."""
    return _without(nodes, edges, "Schema", ("DEFINES",)).select("project_id", "id", "name")


def unreferenced_orm_models(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, id, name): ORM models that nothing uses, whose tables no raw SQL queries."""
    queried = edges.where("type = 'QUERIES'").select("project_id", "dst").distinct()
    by_sql = edges.where("type = 'MAPS_TO'").join(queried, ["project_id", "dst"], "left_semi").select("project_id", F.col("src").alias("id"))
    return _without(nodes, edges, "ORMModel", ("DEFINES", "RELATES_TO", "MIRRORS")).join(by_sql, ["project_id", "id"], "left_anti").select("project_id", "id", "name")


def audit_summary(nodes: DataFrame, edges: DataFrame, extra_auth: Iterable[str] = (), auth: DataFrame | None = None) -> DataFrame:
    """One row a project: its routes by authentication, and how many of each finding."""
    auth = written(route_auth(nodes, edges, extra_auth)) if auth is None else auth
    kinds = auth.groupBy("project_id").agg(F.count("*").alias("routes"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"auth_{k}") for k in ("dependency", "header", "manual_call", "none")])
    out = nodes.select("project_id").distinct().join(kinds, "project_id", "left")
    found = {
        "unprotected_write_routes": unprotected_write_routes(nodes, edges, auth), "duplicate_routes": duplicate_routes(nodes), "unmounted_routes": unmounted_routes(nodes), "unused_schemas": unused_schemas(nodes, edges),
        "unreferenced_orm_models": unreferenced_orm_models(nodes, edges), "dependency_cycles": dependency_cycles(edges), "parse_errors": parse_errors(nodes),
    }
    for name, rows in found.items():
        out = out.join(rows.groupBy("project_id").agg(F.count("*").alias(name)), "project_id", "left")
    zero: Column = F.lit(0).cast("long")
    return out.select("project_id", *[F.coalesce(c, zero).alias(c) for c in out.columns if c != "project_id"])
