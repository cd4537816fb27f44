"""Graph operators over any node table (project_id, id, type, name, ...) and edge table (project_id, src, dst, type, ...).

Iterative operators join a frontier with the edges once a level and write each level to the shared folder, so lineage
does not grow and a lost executor costs one level. All keys begin with the project.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apiloom.functions.names import is_test_file
from apiloom.schemas import CLASS_TYPES, CORE_TYPES, EDGE_TYPES, FUNCTION_TYPES
from apiloom.sources.shared import written

# Edges along which a change spreads, against their direction, and the groups it is reported in.
IMPACT_EDGES = ("CALLS", "USES", "ACCEPTS", "RETURNS", "DEPENDS_ON", "INHERITS", "HANDLED_BY", "MIRRORS", "MAPS_TO", "REFERENCES", "QUERIES", "RENDERS", "MIDDLEWARE")
IMPACT_GROUPS = {"Route": "routes", "Handler": "handlers", "Dependency": "dependencies", "Middleware": "middlewares", "Function": "functions", "Schema": "schemas", "ORMModel": "orm_models", "Class": "classes", "Table": "tables", "Router": "routers", "App": "apps"}


def _ord(edges: DataFrame) -> Column:
    """Order of edges: their own, else none."""
    return F.col("ord") if "ord" in edges.columns else F.lit(None).cast("int")


def select_nodes(nodes: DataFrame, types: Iterable[str]) -> DataFrame:
    return nodes.where(F.col("type").isin(*types))


def select_edges(edges: DataFrame, types: Iterable[str]) -> DataFrame:
    return edges.where(F.col("type").isin(*types))


def out_edges(edges: DataFrame, ids: DataFrame, types: Iterable[str] = EDGE_TYPES) -> DataFrame:
    """Edges that leave the nodes of ``ids`` (project_id, id)."""
    return select_edges(edges, types).join(ids.select("project_id", F.col("id").alias("src")).distinct(), ["project_id", "src"], "left_semi")


def in_edges(edges: DataFrame, ids: DataFrame, types: Iterable[str] = EDGE_TYPES) -> DataFrame:
    """Edges that reach the nodes of ``ids`` (project_id, id)."""
    return select_edges(edges, types).join(ids.select("project_id", F.col("id").alias("dst")).distinct(), ["project_id", "dst"], "left_semi")


def successors(edges: DataFrame, ids: DataFrame, types: Iterable[str] = EDGE_TYPES) -> DataFrame:
    return out_edges(edges, ids, types).select("project_id", F.col("src").alias("id"), F.col("dst").alias("successor")).distinct()


def predecessors(edges: DataFrame, ids: DataFrame, types: Iterable[str] = EDGE_TYPES) -> DataFrame:
    return in_edges(edges, ids, types).select("project_id", F.col("dst").alias("id"), F.col("src").alias("predecessor")).distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, what, name, n): counts of nodes, edges, and each type of both."""
    count = lambda df, what: df.groupBy("project_id", F.col("type").alias("name")).agg(F.count("*").alias("n")).select("project_id", F.lit(what).alias("what"), "name", "n")
    types = count(nodes, "node_type").unionByName(count(edges, "edge_type"))
    total = types.groupBy("project_id", F.regexp_replace("what", "_type", "").alias("what")).agg(F.sum("n").alias("n"))
    return types.unionByName(total.select("project_id", "what", F.lit("").alias("name"), "n"))


def degree(edges: DataFrame, skip: tuple[str, ...] = ("DEFINES",)) -> DataFrame:
    """(project_id, id, degree): edges in and out, a loop counting twice."""
    used = edges.where(~F.col("type").isin(*skip))
    return used.select("project_id", F.explode(F.array("src", "dst")).alias("id")).groupBy("project_id", "id").agg(F.count("*").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = 10, types: tuple[str, ...] = (*FUNCTION_TYPES, *CLASS_TYPES)) -> DataFrame:
    """(project_id, rank, id, type, degree): the most connected symbols of each project, no external ones or tests; ties by id."""
    kept = select_nodes(nodes, types)
    if "external" in nodes.columns:
        kept = kept.where(~F.coalesce("external", F.lit(False)))
    if "file" in nodes.columns:
        kept = kept.where(~is_test_file(F.coalesce("file", F.lit(""))))
    ranked = kept.select("project_id", "id", "type").join(degree(edges), ["project_id", "id"])
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("degree"), "id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= limit).select("project_id", "rank", "id", "type", "degree")


#: Parts of a root's level whose best rows are found before they meet.
RANK_PARTS = 32


def neighbors(edges: DataFrame, roots: DataFrame, depth: int = 1, edge_types: Iterable[str] | None = None, direction: str = "both", limit: int | None = 200) -> DataFrame:
    """(project_id, root, id, edge, direction, from, distance, rank, truncated): breadth-first neighbourhood of each root.

    ``roots``: (project_id, root). DEFINES edges are followed only if asked for; type names in any case; depth from 1
    to 5. A node is reported once, by the first step that reaches it: in the order of what was found before, out
    before in, then in the edges' order. At most ``limit`` are reported for a root; then ``truncated`` is true. Without a
    limit all are reported and ``rank`` is null.

    The order of a level is that of its nodes' ways (the steps from the root), so no level is ranked as a whole: with a
    limit each part of a root's level gives its best rows, of which at most ``RANK_PARTS`` times the limit meet.
    """
    wanted = [t.upper() for t in edge_types] if edge_types else [t for t in EDGE_TYPES if t != "DEFINES"]
    if unknown := set(wanted) - set(EDGE_TYPES):
        raise ValueError(f"unknown edge types: {sorted(unknown)}")
    if direction not in ("in", "out", "both"):
        raise ValueError("direction is in, out or both")
    used = edges.where(F.col("type").isin(*wanted))
    out = used.select("project_id", F.col("src").alias("from"), F.col("dst").alias("id"), F.col("type").alias("edge"), F.lit("out").alias("direction"), F.lit(0).alias("d"), _ord(edges).alias("o"))
    back = used.select("project_id", F.col("dst").alias("from"), F.col("src").alias("id"), F.col("type").alias("edge"), F.lit("in").alias("direction"), F.lit(1).alias("d"), _ord(edges).alias("o"))
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    step = F.struct("d", "o", "id", "edge")
    none = F.slice(F.array(F.struct(F.lit(0).alias("d"), F.lit(None).cast(steps.schema["o"].dataType).alias("o"), F.lit("").alias("id"), F.lit("").alias("edge"))), 1, 0)
    frontier = roots.select("project_id", "root", F.col("root").alias("from"), none.alias("way")).distinct()
    seen = roots.select("project_id", "root", F.col("root").alias("id")).distinct()
    columns = ["project_id", "root", "id", "edge", "direction", "from", "distance", "rank"]
    found = None
    for distance in range(1, max(1, min(depth, 5)) + 1):
        reached = frontier.join(steps, ["project_id", "from"]).join(seen, ["project_id", "root", "id"], "left_anti")
        first = reached.groupBy("project_id", "root", "id").agg(F.min(F.struct(F.concat("way", F.array(step)).alias("way"), "edge", "direction", "from")).alias("f"))
        level = first.select("project_id", "root", "id", "f.*", F.lit(distance).alias("distance"))
        if limit is None:
            level = level.withColumn("rank", F.lit(None).cast("int"))
        else:
            place = lambda *keys: F.row_number().over(Window.partitionBy("project_id", "root", *keys).orderBy("way"))
            level = level.withColumn("place", place(F.pmod(F.xxhash64("id"), F.lit(RANK_PARTS)))).where(F.col("place") <= limit)
            level = level.withColumn("place", place()).where(F.col("place") <= limit)
            before = found.groupBy("project_id", "root").agg(F.max("rank").alias("before")) if found is not None else None
            level = level.join(before, ["project_id", "root"], "left") if before is not None else level.withColumn("before", F.lit(0))
            level = level.withColumn("rank", F.col("place") + F.coalesce("before", F.lit(0))).where(F.col("rank") <= limit)
        level = written(level.select(*columns, "way"))
        if level.isEmpty():
            break
        found = level.select(*columns) if found is None else found.unionByName(level.select(*columns))
        seen = seen.unionByName(level.select("project_id", "root", "id"))
        frontier = level.select("project_id", "root", F.col("id").alias("from"), "way")
    if found is None:
        found = level.select(*columns)
    if limit is None:
        return found.withColumn("truncated", F.lit(False))
    full = found.groupBy("project_id", "root").agg((F.max("rank") >= limit).alias("truncated"))
    return found.join(full, ["project_id", "root"])


#: A frontier of so many rows at most is sent to the edges; a larger one meets them in a shuffle, where hubs can be split.
SMALL_FRONTIER = 20_000


def _sent(frontier: DataFrame, most: int) -> DataFrame:
    """The frontier, broadcast if it has been counted to be small; else joined by sorting, which Spark splits at hot keys."""
    return F.broadcast(frontier) if frontier.count() <= most else frontier.hint("merge")


def impact(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 6, small_frontier: int = SMALL_FRONTIER) -> DataFrame:
    """(project_id, root, id, type, name, group, distance, via): all that relies on each root, by breadth-first search.

    Edges of ``IMPACT_EDGES`` are followed backwards; from a router or app its routes and routers too; MIRRORS only
    from the root, unless another edge joins the two as well. Modules are passed through but not reported. ``via`` is
    the chain of names from a route to the root, null for other types.
    """
    typed = nodes.select("project_id", F.col("id").alias("at"), F.col("type").alias("at_type"), F.col("name").alias("at_name"))
    back = edges.where(F.col("type").isin(*IMPACT_EDGES)).groupBy("project_id", F.col("dst").alias("at"), F.col("src").alias("id")).agg(F.min(_ord(edges)).alias("o"), F.bool_and(F.col("type") == "MIRRORS").alias("mirror"))
    down = edges.where("type in ('HAS_ROUTE', 'INCLUDES')").groupBy("project_id", F.col("src").alias("at"), F.col("dst").alias("id")).agg(F.min(_ord(edges)).alias("o"))
    down = down.join(typed.where("at_type in ('Router', 'App')").select("project_id", "at"), ["project_id", "at"])
    steps = written(back.withColumn("side", F.lit(0)).unionByName(down.withColumn("mirror", F.lit(False)).withColumn("side", F.lit(1)).select("project_id", "at", "id", "o", "mirror", "side")))
    names = nodes.select("project_id", "id", "type", "name")
    start = roots.select("project_id", "root").distinct().join(typed.withColumnRenamed("at", "root"), ["project_id", "root"])
    # A node's way orders it among those of its distance: its parent's way, then side, order and id of the last step.
    step = F.struct("side", "o", "id")
    none = F.slice(F.array(F.struct(F.lit(0).alias("side"), F.lit(None).cast(steps.schema["o"].dataType).alias("o"), F.lit("").alias("id"))), 1, 0)
    frontier = start.select("project_id", "root", F.col("root").alias("at"), none.alias("way"), F.array("at_name").alias("chain"))
    seen = start.select("project_id", "root", F.col("root").alias("id"))
    found = None
    for distance in range(1, max_depth + 1):
        reached = steps.join(_sent(frontier, small_frontier), ["project_id", "at"]).where((F.lit(distance) == 1) | ~F.col("mirror")).join(seen, ["project_id", "root", "id"], "left_anti")
        first = reached.groupBy("project_id", "root", "id").agg(F.min(F.struct(F.concat("way", F.array(step)).alias("way"), "chain")).alias("first"))
        level = first.join(names, ["project_id", "id"])
        level = written(level.select("project_id", "root", "id", "type", "name", F.lit(distance).alias("distance"), "first.way", F.concat(F.array("name"), "first.chain").alias("chain")))
        if level.isEmpty():
            found = level if found is None else found
            break
        found = level if found is None else found.unionByName(level)
        seen = seen.unionByName(level.select("project_id", "root", "id"))
        frontier = level.select("project_id", "root", F.col("id").alias("at"), "way", "chain")
    groups = F.create_map(*[F.lit(x) for pair in IMPACT_GROUPS.items() for x in pair])
    shown = found.where("type <> 'Module'")
    return shown.select("project_id", "root", "id", "type", "name", F.coalesce(F.try_element_at(groups, F.col("type")), F.lit("other")).alias("group"), "distance", F.when(F.col("type") == "Route", F.col("chain")).alias("via"))


def in_impact_order(impacted: DataFrame) -> DataFrame:
    """Rows of :func:`impact` as a listing shows them: by root, distance and name."""
    return impacted.orderBy("project_id", "root", "distance", "name", "id")


def impact_summary(impacted: DataFrame) -> DataFrame:
    """(project_id, root, group, n) of the rows of :func:`impact`."""
    return impacted.groupBy("project_id", "root", "group").agg(F.count("*").alias("n"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_paths: int = 3, max_length: int = 12) -> DataFrame:
    """(project_id, source, target, directed, rank, path, edges): the k shortest simple paths of each pair.

    ``pairs``: (project_id, source, target). Directed paths if there are any of at most ``max_length`` edges, else
    paths that ignore direction; ties by the nodes' ids. Types of parallel edges are joined by ``/``; a step against
    its edges says ``(reversed)``. DEFINES edges are not used. The first path is where searches from both ends meet; for
    further ones distances to the targets are labelled, and only nodes on a short enough way are entered.
    """
    k = max(1, min(max_paths, 10))
    ways = edges.where("type <> 'DEFINES'").groupBy("project_id", "src", "dst").agg(F.array_join(F.sort_array(F.collect_set("type")), "/").alias("types"))
    forward = written(ways.select("project_id", "src", "dst", F.col("types").alias("step"), F.lit(False).alias("back")))
    reverse = forward.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat("step", F.lit(" (reversed)")).alias("step"), F.lit(True).alias("back"))
    asked = pairs.select("project_id", "source", "target").distinct()
    straight = _simple_paths(forward, asked, k, max_length).withColumn("directed", F.lit(True))
    left = asked.join(straight.select("project_id", "source", "target").distinct(), ["project_id", "source", "target"], "left_anti")
    both = forward.unionByName(reverse).groupBy("project_id", "src", "dst").agg(F.min_by("step", "back").alias("step"))
    around = _simple_paths(written(both), left, k, max_length).withColumn("directed", F.lit(False))
    return straight.unionByName(around).select("project_id", "source", "target", "directed", "rank", "path", "edges")


_PAIR = ["project_id", "source", "target"]


def _distances(ways: DataFrame, targets: DataFrame, max_length: int) -> DataFrame:
    """(project_id, target, node, d): the fewest edges from each node to each target, up to ``max_length``."""
    known = level = targets.select("project_id", "target", F.col("target").alias("node"), F.lit(0).alias("d"))
    step = ways.select("project_id", F.col("dst").alias("node"), F.col("src").alias("next"))
    for d in range(1, max_length + 1):
        level = level.join(step, ["project_id", "node"]).select("project_id", "target", F.col("next").alias("node")).distinct().join(known, ["project_id", "target", "node"], "left_anti")
        level = written(level.withColumn("d", F.lit(d)))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return written(known)


class _Side:
    """Breadth-first search from one end of all pairs, shared by the pairs of that end.

    A level holds each node once for each end, with its least way; ways of the targets' side run from the node to the target.
    """

    def __init__(self, ways: DataFrame, pairs: DataFrame, end: str) -> None:
        self.end, self.key, forward = end, ["project_id", end], end == "source"
        at, next_ = ("src", "dst") if forward else ("dst", "src")
        self.step = ways.select("project_id", F.col(at).alias("node"), F.col(next_).alias("next"), "step")
        self.degree = self.step.groupBy("project_id", "node").agg(F.count("*").alias("degree"))
        self.grown = (lambda way, one: F.concat(way, F.array(one))) if forward else (lambda way, one: F.concat(F.array(one), way))
        self.level = pairs.select(*self.key).distinct().select(*self.key, F.col(end).alias("node"), F.array(end).alias("path"), F.array().cast("array<string>").alias("edges"))
        self.seen = self.level.select(*self.key, "node")

    def cost(self, pairs: DataFrame) -> int:
        """Rows of the next level, counted once for each pair."""
        asked = pairs.groupBy(*self.key).agg(F.count("*").alias("pairs"))
        return self.level.join(asked, self.key).join(self.degree, ["project_id", "node"]).agg(F.sum(F.col("pairs") * F.col("degree"))).first()[0] or 0

    def go_on(self, pairs: DataFrame) -> None:
        """One edge further, from the ends that pairs still ask for."""
        live = self.level.join(pairs.select(*self.key).distinct(), self.key, "left_semi").join(self.step, ["project_id", "node"]).drop("node").withColumnRenamed("next", "node")
        way = F.struct(self.grown("path", F.col("node")).alias("path"), self.grown("edges", F.col("step")).alias("edges"))
        self.level = written(live.join(self.seen, [*self.key, "node"], "left_anti").groupBy(*self.key, "node").agg(F.min(way).alias("way")).select(*self.key, "node", "way.*"))
        self.seen = self.seen.unionByName(self.level.select(*self.key, "node"))


def _nearest_paths(ways: DataFrame, pairs: DataFrame, max_length: int) -> DataFrame:
    """(pair, path, edges): of each pair the path of the fewest edges, then the least ids.

    Two searches meet, one from all sources and one from all targets; each round the one goes on whose next level is
    smaller for the pairs left. A pair leaves where its ends meet, or where one of them leads no further. So what is
    reached is held once for an end, not for a pair, and a hub between two ends is not searched beyond.
    """
    one, other = _Side(ways, pairs, "source"), _Side(ways, pairs, "target")
    found = pairs.where("source = target").select(*_PAIR, F.array("source").alias("path"), F.array().cast("array<string>").alias("edges"))
    left = written(pairs.where("source <> target").select(*_PAIR))
    for _ in range(max_length):
        if left.isEmpty():
            break
        a, b = one.cost(left), other.cost(left)
        if not (a and b):
            break
        side, across = (one, other) if a <= b else (other, one)
        side.go_on(left)
        left = written(left.join(side.level.select(*side.key).distinct(), side.key, "left_semi"))
        here = left.join(side.level.withColumnsRenamed({"path": f"{side.end}_path", "edges": f"{side.end}_edges"}), side.key)
        here = here.join(across.level.withColumnsRenamed({"path": f"{across.end}_path", "edges": f"{across.end}_edges"}), [*across.key, "node"])
        way = F.struct(F.concat("source_path", F.slice("target_path", 2, F.size("target_path"))).alias("path"), F.concat("source_edges", "target_edges").alias("edges"))
        met = written(here.groupBy(*_PAIR).agg(F.min(way).alias("way")).select(*_PAIR, "way.*"))
        found = found.unionByName(met)
        left = written(left.join(met.select(*_PAIR), _PAIR, "left_anti"))
    return written(found)


def _least_paths(ways: DataFrame, tasks: DataFrame, to_go: DataFrame, max_length: int) -> DataFrame:
    """(pair, place, path, edges): of each task the path of the fewest edges, then the least ids, from ``spur`` to the target.

    ``tasks``: (pair, place, spur, avoid, not_first), one for each pair and place; nodes to avoid, and nodes that the
    first step may not lead to. A level holds a node once for each task, with its least way; so rows stay below tasks
    times nodes, however many paths there are.
    """
    key = [*_PAIR, "place"]
    start = tasks.select(*key, F.col("spur").alias("at"), F.array("spur").alias("path"), F.array().cast("array<string>").alias("edges"), "avoid", "not_first")
    arrived = start.where("at = target").select(*key, "path", "edges")
    live, seen = start.where("at <> target"), start.select(*key, F.col("at").alias("next"))
    step = ways.select("project_id", F.col("src").alias("at"), F.col("dst").alias("next"), "step")
    for used in range(1, max_length + 1):
        grown = live.join(step, ["project_id", "at"]).where(~F.array_contains("avoid", F.col("next")) & ((F.lit(used) > 1) | ~F.array_contains("not_first", F.col("next"))))
        grown = grown.join(to_go.select("project_id", "target", F.col("node").alias("next"), "d"), ["project_id", "target", "next"]).where(F.col("place") + used + F.col("d") <= max_length)
        grown = grown.join(seen, [*key, "next"], "left_anti")
        way = F.struct(F.concat("path", F.array("next")).alias("path"), F.concat("edges", F.array("step")).alias("edges"))
        level = written(grown.groupBy(*key, "next").agg(F.min(way).alias("way"), F.first("avoid").alias("avoid"), F.first("not_first").alias("not_first")).select(*key, "next", "way.*", "avoid", "not_first"))
        if level.isEmpty():
            break
        there = level.where("next = target")
        arrived = arrived.unionByName(there.select(*key, "path", "edges"))
        live = level.join(there.select(*key), key, "left_anti").withColumnRenamed("next", "at")
        seen = seen.unionByName(level.select(*key, "next"))
    return written(arrived)


def _simple_paths(ways: DataFrame, pairs: DataFrame, k: int, max_length: int) -> DataFrame:
    """The k best simple paths of each pair, one rank a round: the next best leaves a found one at some node (a spur).

    After Yen (1971): of each path of the last rank every node is a spur; what comes before it stays, its nodes are
    avoided, and so are the steps that found paths of the same beginning take. The best candidate is the next rank.
    """
    last = _nearest_paths(ways, pairs, max_length).select(*_PAIR, F.lit(1).alias("rank"), "path", "edges")
    found, candidates = last, None
    to_go = _distances(ways, last.where("source <> target").select("project_id", "target").distinct(), max_length) if k > 1 else None
    for rank in range(2, k + 1):
        spurs = last.select(*_PAIR, "path", "edges", F.explode(F.sequence(F.lit(0), F.size("path") - 2)).alias("place")).where("source <> target")
        spurs = spurs.withColumn("begin", F.slice("path", 1, F.col("place") + 1))
        taken = found.select(*_PAIR, F.col("path").alias("other"))
        spurs = spurs.join(taken, _PAIR).where(F.slice("other", 1, F.col("place") + 1) == F.col("begin")).groupBy(*_PAIR, "place", "begin", "edges").agg(F.collect_set(F.get("other", F.col("place") + 1)).alias("not_first"))
        spurs = written(spurs.select(*_PAIR, "place", "begin", F.slice("edges", 1, F.col("place")).alias("begin_edges"), F.get("begin", F.col("place")).alias("spur"), F.slice("begin", 1, F.col("place")).alias("avoid"), "not_first"))
        ends = _least_paths(ways, spurs, to_go, max_length)
        more = ends.join(spurs.select(*_PAIR, "place", "begin", "begin_edges"), [*_PAIR, "place"]).select(*_PAIR, F.concat("begin", F.slice("path", 2, F.size("path"))).alias("path"), F.concat("begin_edges", "edges").alias("edges"))
        more = more if candidates is None else candidates.unionByName(more)
        candidates = written(more.distinct().join(found, [*_PAIR, "path"], "left_anti"))
        best = candidates.groupBy(*_PAIR).agg(F.min(F.struct(F.size("path").alias("n"), "path", "edges")).alias("b"))
        last = written(best.select(*_PAIR, F.lit(rank).alias("rank"), "b.path", "b.edges"))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found.select(*_PAIR, "rank", "path", "edges")


def _trimmed(live: DataFrame, rounds: int) -> DataFrame:
    """Edges without those of nodes that nothing reaches or that reach nothing, which lie on no circle."""
    for _ in range(rounds):
        kept = live.join(live.select("project_id", F.col("dst").alias("src")).distinct(), ["project_id", "src"], "left_semi")
        live = written(kept.join(live.select("project_id", F.col("src").alias("dst")).distinct(), ["project_id", "dst"], "left_semi").select("project_id", "src", "dst"))
    return live


def _with_shortcuts(live: DataFrame) -> DataFrame:
    """Edges, and from each node of a single edge those that lead 2, 4, 8, ... such edges on: ways along a chain take few rounds."""
    single = live.groupBy("project_id", "src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1 and src <> dst").drop("n")
    jumps = written(single)
    longest, every = jumps.count(), live
    length = 1
    while length < longest:
        length *= 2
        on = jumps.select("project_id", F.col("src").alias("dst"), F.col("dst").alias("next"))
        jumps = written(jumps.join(on, ["project_id", "dst"]).select("project_id", "src", F.col("next").alias("dst")))
        if jumps.isEmpty():
            break
        every = every.unionByName(jumps)
    return written(every.distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """(project_id, id, component) of every node that lies on a circle, a loop included; component is its circle's largest node.

    Forward-backward rounds: each node takes the largest node that reaches it; from each node that is its own largest,
    what it reaches is followed backwards, which gives its component. Found components leave, and the rest goes on.
    Both searches join only what changed with the edges, and shortcuts along chains keep their rounds few.
    """
    live = written(edges.select("project_id", "src", "dst").where("src is not null and dst is not null").distinct())
    key = ["project_id", "id"]
    loops = live.where("src = dst").select("project_id", F.col("src").alias("id"))
    done = None
    while True:
        live = _trimmed(live, 2)
        if live.isEmpty():
            break
        ways = _with_shortcuts(live)
        on = ways.select("project_id", F.col("src").alias("id"), F.col("dst").alias("to"))
        back = ways.select("project_id", F.col("dst").alias("id"), F.col("src").alias("to"))
        labels = changed = written(live.select("project_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.col("id")))
        while not changed.isEmpty():
            sent = changed.join(on, key).groupBy("project_id", F.col("to").alias("id")).agg(F.max("label").alias("sent"))
            all_ = written(labels.join(sent, key, "left").select(*key, F.greatest("label", "sent").alias("label"), (F.col("sent") > F.col("label")).alias("new")))
            labels, changed = all_.drop("new"), all_.where("new").drop("new")
        reached = frontier = written(labels.where("id = label"))
        while not frontier.isEmpty():
            next_ = frontier.join(back, key).select("project_id", F.col("to").alias("id"), "label").distinct().join(labels, [*key, "label"], "left_semi")
            frontier = written(next_.join(reached, key, "left_anti"))
            reached = written(reached.unionByName(frontier))
        part = reached.withColumnRenamed("label", "component")
        done = part if done is None else done.unionByName(part)
        left = live.join(reached.select("project_id", F.col("id").alias("src")), ["project_id", "src"], "left_anti")
        live = written(left.join(reached.select("project_id", F.col("id").alias("dst")), ["project_id", "dst"], "left_anti").select("project_id", "src", "dst"))
    if done is None:
        return edges.select("project_id", F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    many = done.groupBy("project_id", "component").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return written(done.join(many, ["project_id", "component"], "left_semi").select(*key, "component").unionByName(done.join(loops, key, "left_semi").select(*key, "component")).distinct())


def dependency_cycles(edges: DataFrame, limit: int | None = 20, max_len: int = 10, kind: str = "DEPENDS_ON") -> DataFrame:
    """(project_id, rank, cycle array): simple cycles of one type of edge, of at most ``max_len`` nodes, each from its least node.

    Cycles are sought inside :func:`strong_components` alone, which tell of circles of any length. ``limit`` cycles of each
    project are ranked by length, then nodes; without a limit all are given and ``rank`` is null.
    """
    used = edges.where(F.col("type") == kind).select("project_id", "src", "dst").distinct()
    of = strong_components(used)
    live = used.join(of.select("project_id", F.col("id").alias("src"), "component"), ["project_id", "src"])
    live = written(live.join(of.select("project_id", F.col("id").alias("dst"), "component"), ["project_id", "dst", "component"]).select("project_id", "src", "dst"))
    paths = live.select("project_id", F.array("src").alias("path"), F.col("dst").alias("next"))
    done = None
    for _ in range(max_len):
        ends = paths.where(F.col("next") == F.col("path")[0]).select("project_id", F.col("path").alias("cycle"))
        done = ends if done is None else done.unionByName(ends)
        open_ = paths.where((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next")))
        paths = written(open_.join(live.select("project_id", F.col("src").alias("next"), F.col("dst").alias("after")), ["project_id", "next"]).select("project_id", F.concat("path", F.array("next")).alias("path"), F.col("after").alias("next")))
        if paths.isEmpty():
            break
    if limit is None:
        return done.select("project_id", F.lit(None).cast("int").alias("rank"), "cycle")
    rank = lambda *keys: F.row_number().over(Window.partitionBy("project_id", *keys).orderBy(F.size("cycle"), "cycle"))
    best = done.withColumn("rank", rank(F.pmod(F.xxhash64("cycle"), F.lit(RANK_PARTS)))).where(F.col("rank") <= limit)
    return best.withColumn("rank", rank()).where(F.col("rank") <= limit).select("project_id", "rank", "cycle")


def core_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, id, core): a core type, or a function or class beside one; modules never."""
    typed = nodes.select("project_id", F.col("id").alias("other"), F.col("type").isin(*CORE_TYPES).alias("is_core"))
    links = edges.where("type <> 'DEFINES'").select("project_id", F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("l")).select("project_id", "l.*")
    beside = links.join(typed.where("is_core"), ["project_id", "other"]).select("project_id", "id", F.lit(True).alias("beside")).distinct()
    core = F.col("type").isin(*CORE_TYPES) | ((F.col("type") != "Module") & F.coalesce("beside", F.lit(False)))
    return nodes.select("project_id", "id", "type").join(beside, ["project_id", "id"], "left").select("project_id", "id", core.alias("core"))
