"""Reports and viewer payloads of whole graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.functions.names import html_safe, is_test_file
from apiloom.operators.audit import audit_summary, route_auth, unprotected_write_routes, unreferenced_orm_models, unused_schemas
from apiloom.operators.graph import core_nodes, degree, graph_stats, hubs
from apiloom.schemas import FUNCTION_TYPES
from apiloom.sources.shared import written

# Headings and labels of the report's format.
TITLE = "# Knowledge graph — "
ROUTES, HUBS, TABLES, AUDIT = "## Routes", "## Most connected symbols", "## Tables", "## Audit"
ROUTE_COLUMNS = ("| Method | Path | Handler | Auth |", "|---|---|---|---|")
OPEN_ROUTES = "Write routes without detected auth"
COUNTS = {
    "duplicate_routes": "Duplicate routes",
    "unmounted_routes": "Routes on routers never included",
    "unused_schemas": "Unused schemas",
    "unreferenced_orm_models": "Unreferenced ORM models",
    "dependency_cycles": "Dependency cycles",
    "parse_errors": "Files with syntax errors",
}


def table_usage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, id, name, models, callers): models mapped to each table, and how many functions and modules query it."""
    names = nodes.select("project_id", F.col("id").alias("src"), F.col("name").alias("model"))
    models = edges.where("type = 'MAPS_TO'").join(names, ["project_id", "src"]).groupBy("project_id", F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("model")).alias("models"))
    callers = edges.where("type = 'QUERIES'").groupBy("project_id", F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    tables = nodes.where("type = 'Table'").select("project_id", "id", "name")
    return tables.join(models, ["project_id", "id"], "left").join(callers, ["project_id", "id"], "left").select("project_id", "id", "name", F.coalesce("models", F.array().cast("array<string>")).alias("models"), F.coalesce("callers", F.lit(0).cast("long")).alias("callers"))


def report_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, section, place, line): the lines of each project's report, ordered by section and place."""
    auth = written(route_auth(nodes, edges))
    line = lambda df, section, place, text: df.select("project_id", F.lit(section).alias("section"), place.cast("string").alias("place"), text.alias("line"))
    code = lambda c: F.concat(F.lit("`"), F.col(c) if isinstance(c, str) else c, F.lit("`"))
    stats = graph_stats(nodes, edges)
    kinds = stats.where("what = 'node_type' and name <> 'Module'").groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["name"])), ", ").alias("kinds"))
    total = lambda what: stats.where(F.col("what") == what).select("project_id", F.col("n").alias(what))
    head = total("node").join(total("edge"), "project_id", "left").join(kinds, "project_id", "left")
    handled = edges.where("type = 'HANDLED_BY'").select("project_id", F.col("src").alias("route"), F.col("dst").alias("handler"))
    routes = nodes.where("type = 'Route'").select("project_id", F.col("id").alias("route"), "method", F.col("full_paths")[0].alias("at")).join(handled, ["project_id", "route"]).join(auth, ["project_id", "route"])
    shown = F.when(F.col("kind") == "none", F.lit("—")).otherwise(F.concat("kind", F.lit(": "), code("by")))
    tables = table_usage(nodes, edges)
    usage = F.concat(F.lit("- "), code("name"), F.when(F.size("models") > 0, F.concat(F.lit(" ← model "), F.array_join("models", ", "))).otherwise(""), F.when(F.col("callers") > 0, F.concat(F.lit(", raw SQL in "), F.col("callers").cast("string"), F.lit(" place(s)"))).otherwise(""))
    summary = written(audit_summary(nodes, edges, auth=auth))
    open_ = unprotected_write_routes(nodes, edges, auth)
    named = lambda df: df.groupBy("project_id").agg(F.concat(F.lit("  - "), F.array_join(F.array_sort(F.collect_list(code("name"))), ", ")).alias("line"))
    counts = [(f"{n}0", label, c) for n, (c, label) in enumerate(COUNTS.items(), 3)]
    counted: Column = F.format_string("%012d", F.col("rank"))
    fixed = lambda section, place, text: line(head, section, F.lit(place), F.lit(text))
    parts = [
        line(head, "0 head", F.lit("0"), F.concat(F.lit(TITLE), "project_id")), fixed("0 head", "1", ""),
        line(head, "0 head", F.lit("2"), F.concat(F.col("node").cast("string"), F.lit(" nodes, "), F.coalesce("edge", F.lit(0)).cast("string"), F.lit(" edges. "), F.coalesce("kinds", F.lit("")))),
        *[fixed("1 routes", f" {i}", text) for i, text in enumerate(("", ROUTES, "", *ROUTE_COLUMNS))],
        line(routes, "1 routes", F.concat("at", F.lit(" "), "method", F.lit(" "), "route"), F.concat(F.lit("| "), "method", F.lit(" | "), code("at"), F.lit(" | "), code("handler"), F.lit(" | "), shown, F.lit(" |"))),
        *[fixed("2 hubs", f" {i}", text) for i, text in enumerate(("", HUBS, ""))],
        line(hubs(nodes, edges), "2 hubs", counted, F.concat(F.lit("- "), code("id"), F.lit(" ("), "type", F.lit(", degree "), F.col("degree").cast("string"), F.lit(")"))),
        *[line(tables.select("project_id").distinct(), "3 tables", F.lit(f" {i}"), F.lit(text)) for i, text in enumerate(("", TABLES, ""))],
        line(tables, "3 tables", F.col("id"), usage),
        *[fixed("4 audit", f" {i}", text) for i, text in enumerate(("", AUDIT, ""))],
        line(summary, "4 audit", F.lit("10"), F.concat(F.lit(f"- {OPEN_ROUTES}: "), F.col("unprotected_write_routes").cast("string"))),
        line(open_, "4 audit", F.concat(F.lit("20 "), "route"), F.concat(F.lit("  - "), "name", F.when(F.col("likely_public"), " (likely public)").otherwise(""))),
        *[line(summary, "4 audit", F.lit(place), F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))) for place, label, c in counts],
        *[line(named(df), "4 audit", F.lit(place), F.col("line")) for place, df in (("51", unused_schemas(nodes, edges)), ("61", unreferenced_orm_models(nodes, edges)))],
    ]
    return reduce(DataFrame.unionByName, parts)


def report_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, text): a Markdown report for each project."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section", "place", "line"))), lambda x: x["line"])
    return report_rows(nodes, edges).groupBy("project_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def write_report(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Each project's report as text files in a folder ``project_id=...``; their lines in order, file after file by name.

    Lines are dealt to tasks by ranges of their order and sorted there, so no project is gathered in one task.
    """
    order = ["project_id", "section", "place", "line"]
    placed = written(report_rows(nodes, edges))
    placed.repartitionByRange(*order).sortWithinPartitions(*order).select("project_id", "line").write.mode("overwrite").partitionBy("project_id").text(path)


def write_payload(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Each project's payload as text files of a JSON object a line, below ``project_id=.../what=...``, by id."""
    order = ["project_id", "what", "id"]
    placed = written(export_payload(nodes, edges))
    placed.repartitionByRange(*order).sortWithinPartitions(*order).select("project_id", "what", "payload").write.mode("overwrite").partitionBy("project_id", "what").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, what if there is one, file, line) of files that were written so."""
    rows = spark.read.option("basePath", path).text(path)
    return rows.select(*[c for c in rows.columns if c != "value"], F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def export_payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, what, id, payload): a JSON object for each node and edge, safe inside HTML; absent attributes are left out."""
    typed = nodes.join(degree(edges), ["project_id", "id"], "left").join(core_nodes(nodes, edges), ["project_id", "id"])
    node = F.to_json(F.struct("id", F.col("name").alias("label"), "type", F.coalesce("degree", F.lit(0)).alias("degree"), "core", is_test_file(F.coalesce("file", F.lit(""))).alias("test"), F.coalesce("external", F.lit(False)).alias("external"), "file", "line", "full_paths", "method", "tablename", "fields", F.when(F.col("type").isin(*FUNCTION_TYPES) & F.col("is_async"), True).alias("async")))
    edge = F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "type", "prefix", "ops", "confidence", "via", "param"))
    rows = typed.select("project_id", F.lit("node").alias("what"), "id", html_safe(node).alias("payload"))
    return rows.unionByName(edges.select("project_id", F.lit("edge").alias("what"), F.concat("src", F.lit(" "), "type", F.lit(" "), "dst").alias("id"), html_safe(edge).alias("payload")))
