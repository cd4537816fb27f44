"""Full paths of routes, through every chain of included routers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiloom.functions.names import join_path
from apiloom.sources.shared import written


def include_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, owner, prefix, mounted): every chain of includes above each app and router that has routes.

    A chain ends at an app, or where nothing more includes it. Each round climbs one include of all chains; a router
    is not entered twice.
    """
    owners = nodes.where("type in ('App', 'Router')").select("project_id", "id", "type", F.when(F.col("type") == "Router", F.coalesce("prefix", F.lit(""))).otherwise(F.lit("")).alias("own"))
    includes = edges.where("type = 'INCLUDES'").select("project_id", F.col("dst").alias("top"), F.col("src").alias("parent"), F.coalesce("prefix", F.lit("")).alias("inc"))
    with_routes = edges.where("type = 'HAS_ROUTE'").select("project_id", F.col("src").alias("id")).distinct()
    live = owners.join(with_routes, ["project_id", "id"]).select("project_id", F.col("id").alias("owner"), F.col("id").alias("top"), F.col("own").alias("prefix"), F.col("type").alias("top_type"), F.array("id").alias("seen"))
    done = live.where("top_type = 'App'").select("project_id", "owner", "prefix", F.lit(True).alias("mounted"))
    live = live.where("top_type <> 'App'")
    parents = owners.select("project_id", F.col("id").alias("parent"), F.col("type").alias("parent_type"), F.col("own").alias("parent_own"))
    while not live.isEmpty():
        up = live.join(includes, ["project_id", "top"], "left").where("parent is null or not array_contains(seen, parent)")
        up = up.join(parents, ["project_id", "parent"], "left")
        grown = up.where("parent is not null").select("project_id", "owner", F.col("parent").alias("top"), F.concat("parent_own", "inc", "prefix").alias("prefix"), F.col("parent_type").alias("top_type"), F.concat("seen", F.array("parent")).alias("seen"))
        ends = up.where("parent is null").select("project_id", "owner", "prefix", F.lit(False).alias("mounted"))
        cyclic = live.join(up.select("project_id", "owner", "top", "seen").distinct(), ["project_id", "owner", "top", "seen"], "left_anti").select("project_id", "owner", "prefix", F.lit(False).alias("mounted"))
        grown = written(grown)
        reached = grown.where("top_type = 'App'").select("project_id", "owner", "prefix", F.lit(True).alias("mounted"))
        done = done.unionByName(ends).unionByName(cyclic).unionByName(reached)
        live = grown.where("top_type <> 'App'")
    return done


def chains_of_owners(chains: DataFrame) -> DataFrame:
    """(project_id, owner, above): the chains of each app and router, array<struct<prefix, mounted>>."""
    return chains.groupBy("project_id", "owner").agg(F.collect_set(F.struct("prefix", "mounted")).alias("above"))


def placed_routes(routes: DataFrame) -> DataFrame:
    """``routes`` with ``above``, the chains above them, get full_paths, mounted and name. One that no router has stands at its own path."""
    alone = F.array(F.struct(F.lit("").alias("prefix"), F.lit(False).alias("mounted")))
    above = F.when(F.size("above") > 0, F.col("above")).otherwise(alone)
    full = F.sort_array(F.array_distinct(F.transform(above, lambda c: join_path(F.coalesce(c["prefix"], F.lit("")), F.col("path")))))
    out = routes.withColumn("full_paths", full).withColumn("mounted", F.exists(above, lambda c: F.coalesce(c["mounted"], F.lit(False))))
    return out.withColumn("name", F.concat("method", F.lit(" "), F.col("full_paths")[0])).drop("above")


def compute_full_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with full_paths, mounted and name of every route, of a graph whose routes have none yet."""
    above = chains_of_owners(include_chains(nodes, edges))
    owned = edges.where("type = 'HAS_ROUTE'").select("project_id", F.col("src").alias("owner"), F.col("dst").alias("id")).join(above, ["project_id", "owner"])
    owned = owned.groupBy("project_id", "id").agg(F.flatten(F.collect_list("above")).alias("above"))
    routes = placed_routes(nodes.where("type = 'Route'").join(owned, ["project_id", "id"], "left"))
    return nodes.where("type <> 'Route'").unionByName(routes.select(*nodes.columns))
