"""Nodes and edges from facts: each family of edges is a join of facts with resolved references."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiloom.functions.names import confidence, parent_id, schema_stem, short_name
from apiloom.functions.sql import sql_tables
from apiloom.plans.paths import chains_of_owners, include_chains, placed_routes
from apiloom.plans.resolve import MODULE, resolve_class_name, resolve_refs
from apiloom.schemas import CLASS_TYPES, EDGE_TYPES, EDGES, FUNCTION_TYPES, MODEL_TYPES, NODE_TYPES, NODES
from apiloom.sources.extract import OWN_TYPE
from apiloom.sources.shared import hashed_joins, written

# Base classes that make a class a schema or a declarative base.
SCHEMA_BASES = ("BaseModel", "BaseSettings", "RootModel", "GenericModel")
DECLARATIVE_BASES = ("DeclarativeBase", "DeclarativeBaseNoMeta")
#: Facts whose ``ref`` is a name to resolve, by the edges that are made of them; of ``NAMES`` ``name`` is one too.
RESOLVED = {
    "DEPENDS_ON": ("alias_dep", "param_dep", "route_dep", "variable_dep", "include_dep", "param_type", "include"), "ACCEPTS": ("param_type", "alias_dep"), "RETURNS": ("return_ref", "route_model"),
    "HAS_ROUTE": ("route",), "INCLUDES": ("include",), "MIDDLEWARE": ("middleware_owner", "add_middleware"), "CALLS": ("call",), "USES": ("call", "name", "module_ref", "field_ref"),
    "RELATES_TO": ("relationship_ref",), "INHERITS": ("base",),
}
REFERENCES = tuple(sorted({kind for kinds in RESOLVED.values() for kind in kinds}))
NAMES = ("include", "include_dep", "add_middleware")
#: Facts that make a link even if their ``ref`` resolves to nothing.
DEPENDENCIES = ("alias_dep", "param_dep", "route_dep", "variable_dep", "include_dep")
#: Edges that tell of nodes: of functions their role, of routes their paths, and all that only links name.
TOLD_BY = {
    **{kind: ("HANDLED_BY", "DEPENDS_ON", "MIDDLEWARE") for kind in FUNCTION_TYPES}, "Route": ("HAS_ROUTE", "INCLUDES"),
    **{kind: ("MAPS_TO", "REFERENCES", "QUERIES", "RENDERS", "DEPENDS_ON") for kind in ("Table", "Template")},
}
#: Edges that may lead from or to a node that only a dependency makes.
LATE = ("CALLS", "INCLUDES", "MIDDLEWARE")
#: Edges that are told by the types of classes.
TYPED = ("ACCEPTS", "RETURNS", "USES", "INHERITS", "MAPS_TO", "REFERENCES", "RELATES_TO", "MIRRORS")


def fact(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("kind").isin(*kinds))


def order(b: Column | int = 0) -> Column:
    """Place of what a fact makes: file, fact, and place within the fact."""
    return F.struct(F.col("path").alias("path"), F.col("ord").cast("int").alias("a"), (F.lit(b) if isinstance(b, int) else b).cast("int").alias("b"))


def symbol(name: str = "name") -> Column:
    return F.concat("module", F.lit(":"), name)


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, absent ones null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def last_writer_wins(df: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """One row a key: each attribute is that of the last row that sets it; ``ord`` is that of the first row.

    A hash comes before the key: rows sorted for this are told apart by it, where keys that begin alike (a project's
    name, then a package's) would be compared letter by letter.
    """
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    rest = [f.name for f in schema.fields if f.name not in (*keys, "ord")]
    return df.groupBy(F.xxhash64(*keys).alias("__hash"), *keys).agg(*[latest(c) for c in rest], F.min("ord").alias("ord")).select(*schema.names)


def split_by_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys no other row has, all other rows).

    Keys are told apart by a hash, whose counts are the only thing that is shuffled; two keys of one hash are merely
    taken for repeated. ``df`` is read twice, so it must be cheap to read.
    """
    hashed = df.withColumn("__hash", F.xxhash64(*keys))
    repeated = written(hashed.groupBy("__hash").agg(F.count("*").alias("n")).where("n > 1").select("__hash"))
    return hashed.join(repeated, "__hash", "left_anti").drop("__hash"), hashed.join(repeated, "__hash", "left_semi").drop("__hash")


def merged(df: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """:func:`last_writer_wins`, where rows that have their key alone stay as they are and are not sorted."""
    single, repeated = split_by_key(df, keys)
    return single.select(*schema.names).unionByName(last_writer_wins(repeated, keys, schema))


def all_refs(facts: DataFrame, kinds: Iterable[str] = REFERENCES) -> DataFrame:
    """(project_id, module, ref): the names to resolve in facts of these kinds."""
    refs = fact(facts, *kinds).select(*MODULE, "ref")
    names = fact(facts, *[k for k in NAMES if k in kinds]).select(*MODULE, F.col("name").alias("ref"))
    return refs.unionByName(names).where(F.col("ref").isNotNull() & (F.col("ref") != OWN_TYPE))


def declared_nodes(facts: DataFrame) -> DataFrame:
    """Modules, classes, functions, apps and routers; a later declaration of the same id overrides what it sets."""
    modules = fact(facts, "module").select("project_id", F.concat(F.lit("module:"), "module").alias("id"), F.lit("Module").alias("type"), F.col("module").alias("name"), F.col("path").alias("file"), F.col("value").alias("error"), order().alias("ord"))
    fields = fact(facts, "field").groupBy(*MODULE, F.col("owner").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("name").alias("f")))), lambda x: x["f"]).alias("fields"))
    place = ["project_id", symbol().alias("id"), "name", "module", F.col("path").alias("file"), "line"]
    rank = lambda n: F.struct(F.col("path").alias("path"), F.lit(n).alias("a"), F.col("ord").alias("b")).alias("ord")
    classes = fact(facts, "class").join(fields, [*MODULE, "name"], "left").select(*place, F.lit("Class").alias("type"), F.coalesce("fields", F.array().cast("array<string>")).alias("fields"), rank(0))
    functions = fact(facts, "function").select(*place, F.lit("Function").alias("type"), F.col("flag").alias("is_async"), rank(1))
    variables = fact(facts, "variable").select(*place, F.col("ref").alias("type"), F.col("value").alias("prefix"), rank(2))
    parts = [shaped(p, NODES) for p in (modules, classes, functions, variables)]
    return merged(reduce(DataFrame.unionByName, parts), ["project_id", "id"], NODES)


def class_ancestry(bases: DataFrame) -> DataFrame:
    """(project_id, id, ancestor) for every class and all its ancestors; ``bases``: (project_id, id, base). Cycle-safe.

    A round joins the pairs found last with all pairs, so ancestors twice as far are met: depth d takes log2(d) rounds.
    """
    found = fresh = written(bases.select("project_id", "id", F.col("base").alias("ancestor")).distinct())
    while True:
        above = found.select("project_id", F.col("id").alias("ancestor"), F.col("ancestor").alias("above"))
        more = fresh.join(above, ["project_id", "ancestor"]).select("project_id", "id", F.col("above").alias("ancestor")).distinct()
        fresh = written(more.join(found, ["project_id", "id", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = written(found.unionByName(fresh))


def classify_classes(facts: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes with type and orm_base, INHERITS edges, (project_id, id, field) with inherited fields)."""
    classes = fact(facts, "class").groupBy("project_id", symbol().alias("id")).agg(F.max_by(F.struct("name", "value", "flag", "extra"), "ord").alias("c")).select("project_id", "id", F.col("c.value").alias("tablename"), F.col("c.flag").alias("abstract"), (F.col("c.extra") == "True").alias("is_table"))
    base_vars = fact(facts, "orm_base").select("project_id", symbol().alias("base"), F.lit(True).alias("is_var")).distinct()
    bases = fact(facts, "base").select("project_id", "module", "ref", symbol("owner").alias("id"), "path", "ord").join(resolved.where("kind = 'symbol'").select(*MODULE, "ref", F.col("id").alias("base")), [*MODULE, "ref"], "left")
    known = classes.select("project_id", F.col("id").alias("base"), F.lit(True).alias("is_class"))
    bases = written(bases.join(known, ["project_id", "base"], "left").join(base_vars, ["project_id", "base"], "left"))
    inside = bases.where("is_class or is_var")
    inherits = inside.where("is_class").select("project_id", F.col("id").alias("src"), F.col("base").alias("dst"), F.lit("INHERITS").alias("type"), order().alias("ord"))
    up = class_ancestry(inside)
    own = classes.select("project_id", "id", F.col("id").alias("ancestor"))
    line = up.unionByName(own).distinct()
    external = bases.where("is_class is null and is_var is null").select("project_id", F.col("id").alias("ancestor"), short_name(F.col("ref")).alias("external"))
    outside = line.join(external, ["project_id", "ancestor"]).groupBy("project_id", "id").agg(F.collect_set("external").alias("externals"))
    direct = external.groupBy("project_id", F.col("ancestor").alias("id")).agg(F.collect_set("external").alias("direct"))
    from_var = up.join(base_vars.withColumnRenamed("base", "ancestor"), ["project_id", "ancestor"]).select("project_id", "id", F.lit(True).alias("from_var")).distinct()
    tables = line.join(classes.where("is_table").select("project_id", F.col("id").alias("ancestor")), ["project_id", "ancestor"]).select("project_id", "id", F.lit(True).alias("any_table")).distinct()
    fields = fact(facts, "field").select("project_id", symbol("owner").alias("ancestor"), F.col("name").alias("field"))
    all_fields = line.join(fields, ["project_id", "ancestor"]).select("project_id", "id", "field").distinct()
    with_own = fields.select("project_id", F.col("ancestor").alias("id"), F.lit(True).alias("has_fields")).distinct()
    key = ["project_id", "id"]
    joined = reduce(lambda a, b: a.join(b, key, "left"), [outside, direct, from_var, tables, with_own], classes)
    has = lambda c, names: F.coalesce(F.arrays_overlap(F.col(c), F.lit(list(names))), F.lit(False))
    declarative = has("externals", DECLARATIVE_BASES) | F.coalesce("from_var", F.lit(False))
    is_table = F.coalesce(F.col("is_table"), F.lit(False)) | (F.coalesce(F.col("any_table"), F.lit(False)) & F.col("tablename").isNotNull())
    base_itself = has("direct", DECLARATIVE_BASES) & F.col("tablename").isNull() & F.col("has_fields").isNull()
    kind = (
        F.when(has("externals", ["SQLModel"]), F.when(is_table, "ORMModel").otherwise("Schema"))
        .when(has("externals", SCHEMA_BASES), "Schema")
        .when(declarative, F.when(base_itself | F.col("abstract"), "Class").otherwise("ORMModel"))
        .otherwise("Class")
    )
    typed = joined.withColumn("type", kind).withColumn("orm_base", F.when((F.col("type") == "Class") & declarative, True))
    return written(typed.select(*key, "type", "orm_base", "tablename", "is_table")), inherits, written(all_fields)


class Links:
    """Facts with what their names resolve to, for the edge families. All are joined at once, so a family is a filter."""

    def __init__(self, facts: DataFrame, resolved: DataFrame, nodes: DataFrame, kinds: Iterable[str] = REFERENCES) -> None:
        self.facts, self.resolved = facts, resolved
        types = nodes.select("project_id", F.col("id").alias("dst"), F.col("type").alias("dst_type"))
        self.symbols = written(resolved.where("kind = 'symbol'").select(*MODULE, "ref", F.col("id").alias("dst")).join(types, ["project_id", "dst"], "left"))
        found = fact(facts, *kinds).join(self.symbols, [*MODULE, "ref"], "left")
        self.rows = written(by_kind(found.where(F.col("dst").isNotNull() | F.col("kind").isin("route", *DEPENDENCIES))))
        self.targets, self.late = self.symbols.where("dst_type is not null"), None
        self.aliased = written(self._aliased_params())

    def add_nodes(self, more: DataFrame) -> None:
        """Count further nodes as targets: what stands for symbols that were none before."""
        types = more.select("project_id", F.col("id").alias("dst"), F.col("type").alias("late"))
        none = "dst is not null and dst_type is null"
        typed = lambda df: written(df.where(none).join(types, ["project_id", "dst"]).withColumn("dst_type", F.col("late")).select(*df.columns))
        symbols = typed(self.symbols)
        if not symbols.isEmpty():
            self.targets, self.late = self.targets.unionByName(symbols), typed(self.rows)

    def to_node(self, *kinds: str, types: tuple[str, ...] | None = None) -> DataFrame:
        """Facts whose ``ref`` is a node, with ``dst`` and ``dst_type``."""
        found = fact(self.rows, *kinds).where("dst_type is not null")
        found = found if self.late is None else found.unionByName(fact(self.late, *kinds))
        return found.where(F.col("dst_type").isin(*types)) if types else found

    def to_dependency(self, *kinds: str) -> DataFrame:
        """Facts with ``dst`` for each dependency: a symbol, or an external node for a name that resolves to none."""
        return fact(self.rows, *kinds).withColumn("dst", F.coalesce("dst", F.concat(F.lit("external:"), "ref")))

    def _aliased_params(self) -> DataFrame:
        """Parameters whose type is an alias, with each of its dependencies."""
        rows = self.to_dependency("alias_dep").where(F.col("ref") != OWN_TYPE)
        aliases = written(rows.select("project_id", symbol("owner").alias("alias"), "dst", F.col("ord").alias("place")))
        return fact(self.rows, "param_type").where("dst is not null").withColumnRenamed("dst", "alias").join(aliases, ["project_id", "alias"])


def edge(kind: str, src: Column, rows: DataFrame, b: Column | int = 0, **attributes: Column) -> DataFrame:
    return shaped(rows.select("project_id", src.alias("src"), "dst", F.lit(kind).alias("type"), *[v.alias(k) for k, v in attributes.items()], order(b).alias("ord")), EDGES)


def edges_defines(facts: DataFrame) -> DataFrame:
    rows = fact(facts, "class", "function", "variable").withColumn("dst", symbol())
    return edge("DEFINES", F.when(F.col("kind") == "variable", F.concat(F.lit("module:"), "module")).otherwise(parent_id(F.col("module"), F.col("name"))), rows)


def edges_depends_on(links: Links) -> DataFrame:
    """From parameters, annotated aliases, decorators, routers and include_router calls."""
    of = lambda kind: links.to_dependency(kind).where("ref is not null")
    me, route = symbol("owner"), F.concat(F.lit("route:"), "name", F.lit(":"), "module", F.lit(":"), "owner")
    # An include_router call's dependencies belong to the router it names.
    router = links.to_dependency("include_dep").join(links.targets.select(*MODULE, F.col("ref").alias("name"), F.col("dst").alias("router"), F.col("dst_type").alias("router_type")), [*MODULE, "name"]).where("router_type = 'Router'")
    owned = links.targets.select(*MODULE, F.col("ref").alias("owner"), F.lit(True).alias("known"))
    router = router.join(owned, [*MODULE, "owner"], "left_semi")
    parts = [
        edge("DEPENDS_ON", me, of("param_dep"), via=F.lit("param"), param=F.col("name")),
        edge("DEPENDS_ON", me, links.aliased, F.col("place"), via=F.lit("annotated"), param=F.col("name")),
        edge("DEPENDS_ON", route, of("route_dep"), via=F.lit("decorator")),
        edge("DEPENDS_ON", symbol("owner"), of("variable_dep"), via=F.lit("router")),
        edge("DEPENDS_ON", F.col("router"), router, via=F.lit("include_router")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges_accepts(links: Links) -> DataFrame:
    """Functions to the models that their parameters take, dependencies aside."""
    param = [*MODULE, "owner", "name"]
    taken = fact(links.facts, "param_dep").select(*param).unionByName(links.aliased.select(*param)).distinct()
    rows = links.to_node("param_type", types=MODEL_TYPES).join(taken, param, "left_anti")
    return edge("ACCEPTS", symbol("owner"), rows, param=F.col("name"))


def edges_returns(links: Links) -> DataFrame:
    annotated = edge("RETURNS", symbol("owner"), links.to_node("return_ref", types=MODEL_TYPES))
    declared = edge("RETURNS", symbol("owner"), links.to_node("route_model", types=MODEL_TYPES), via=F.lit("response_model"))
    return annotated.unionByName(declared)


def route_nodes(links: Links, chains: DataFrame) -> DataFrame:
    """Routes: one for each method of a function, the last decorator's attributes; their paths below every router that has them."""
    rows = fact(links.rows, "route")
    router = F.when(F.col("dst_type").isin("App", "Router"), F.col("dst"))
    made = rows.select("project_id", route_id().alias("id"), F.lit("Route").alias("type"), F.concat("name", F.lit(" "), "value").alias("name"), F.col("name").alias("method"), F.col("value").alias("path"), F.col("extra").alias("response_model"), "module", F.col("path").alias("file"), "line", order().alias("ord"), router.alias("owner"))
    above = written(chains_of_owners(chains))
    single, repeated = split_by_key(made, ["project_id", "id"])
    single = single.join(above, ["project_id", "owner"], "left")
    latest = repeated.groupBy("project_id", "id").agg(F.max_by(F.struct(*[c for c in made.columns if c not in ("project_id", "id", "ord", "owner")]), "ord").alias("r"), F.min("ord").alias("ord"))
    owned = repeated.select("project_id", "id", "owner").distinct().join(above, ["project_id", "owner"]).groupBy("project_id", "id").agg(F.flatten(F.collect_list("above")).alias("above"))
    latest = latest.select("project_id", "id", "r.*", "ord").join(owned, ["project_id", "id"], "left")
    both = single.select(*latest.columns).unionByName(latest)
    return shaped(placed_routes(both), NODES)


def route_id() -> Column:
    return F.concat(F.lit("route:"), "name", F.lit(":"), "module", F.lit(":"), "owner")


def edges_handled_by(facts: DataFrame) -> DataFrame:
    return edge("HANDLED_BY", route_id(), fact(facts, "route").withColumn("dst", symbol("owner")))


def edges_has_route(links: Links) -> DataFrame:
    rows = links.to_node("route", types=("App", "Router")).withColumn("on", F.col("dst")).withColumn("dst", route_id())
    return edge("HAS_ROUTE", F.col("on"), rows)


def edges_middleware(links: Links) -> tuple[DataFrame, DataFrame]:
    """(edges, external middleware nodes)."""
    decorated = links.to_node("middleware_owner", types=("App",)).withColumn("on", F.col("dst")).withColumn("dst", symbol("owner"))
    added = links.to_node("add_middleware").withColumnsRenamed({"dst": "on", "dst_type": "on_type"})
    target = links.targets.select(*MODULE, F.col("ref").alias("name"), "dst")
    added = added.join(target, [*MODULE, "name"], "left").withColumn("external", F.col("dst").isNull()).withColumn("dst", F.coalesce("dst", F.concat(F.lit("external:"), "name")))
    nodes = added.where("external").select("project_id", F.col("dst").alias("id"), F.lit("Middleware").alias("type"), "name", F.lit(True).alias("external"), order().alias("ord"))
    return edge("MIDDLEWARE", F.col("on"), decorated).unionByName(edge("MIDDLEWARE", F.col("on"), added)), shaped(nodes, NODES)


def edges_calls(links: Links) -> DataFrame:
    return edge("CALLS", symbol("owner"), links.to_node("call", types=FUNCTION_TYPES).where(F.col("dst") != symbol("owner")))


def edges_uses(links: Links) -> DataFrame:
    """Calls of classes, names of classes in functions, and names of classes in a module's own body."""
    inside = links.to_node("call", "name", types=CLASS_TYPES).where(F.col("dst") != symbol("owner"))
    top = links.to_node("module_ref", types=CLASS_TYPES)
    return edge("USES", symbol("owner"), inside).unionByName(edge("USES", F.concat(F.lit("module:"), "module"), top))


def edges_uses_field(links: Links, nodes: DataFrame) -> DataFrame:
    """Classes to the classes named in their annotations; between two ORM models these are relationships already."""
    own = nodes.select("project_id", F.col("id").alias("me"), F.col("type").alias("my_type"))
    rows = written(links.to_node("field_ref", types=CLASS_TYPES).withColumn("me", symbol("owner"))).join(own, ["project_id", "me"])
    rows = rows.where(F.col("me") != F.col("dst")).where("not (my_type = 'ORMModel' and dst_type = 'ORMModel')")
    return edge("USES", F.col("me"), rows, via=F.lit("field"))


def edges_includes(links: Links) -> DataFrame:
    routers = links.targets.where("dst_type = 'Router'").select(*MODULE, F.col("ref").alias("name"), F.col("dst").alias("router"))
    rows = links.to_node("include").join(routers, [*MODULE, "name"]).withColumn("on", F.col("dst")).withColumn("dst", F.col("router"))
    return edge("INCLUDES", F.col("on"), rows, prefix=F.col("value"))


def edges_orm(links: Links, classes: DataFrame) -> DataFrame:
    """MAPS_TO and REFERENCES to tables, RELATES_TO between ORM models."""
    orm = classes.where("type = 'ORMModel'")
    key = ["project_id", "id"]
    declared = fact(links.facts, "class").withColumn("id", symbol()).join(orm.select(*key, "tablename", "is_table"), key)
    name = F.coalesce("tablename", F.when(F.col("is_table"), F.lower(short_name(F.col("name")))))
    maps = declared.withColumn("dst", F.concat(F.lit("table:"), F.lower(name))).where("dst is not null")
    foreign = fact(links.facts, "foreign_table").withColumn("id", symbol("owner")).join(orm.select(*key), key).withColumn("dst", F.concat(F.lit("table:"), "value"))
    related = fact(links.facts, "relationship_ref")
    named = resolve_class_name(related, links.facts, links.resolved).withColumnRenamed("id", "dst")
    related = related.join(named, [*MODULE, "ref"]).withColumn("id", symbol("owner")).join(orm.select(*key), key)
    related = related.join(orm.select("project_id", F.col("id").alias("dst")), ["project_id", "dst"], "left_semi").where("id <> dst")
    return edge("MAPS_TO", F.col("id"), maps).unionByName(edge("REFERENCES", F.col("id"), foreign)).unionByName(edge("RELATES_TO", F.col("id"), related))


def edges_queries(facts: DataFrame) -> DataFrame:
    """Functions and modules to the tables in their SQL strings, with every operation found. Equal strings are read once."""
    src = F.coalesce(symbol("owner"), F.concat(F.lit("module:"), "module"))
    texts = fact(facts, "text")
    distinct = written(texts.select("value").distinct())  # Spark would look for tables before it drops equal strings
    told = written(distinct.withColumn("tables", sql_tables(F.col("value"))).where(F.size("tables") > 0))
    rows = texts.join(told, "value").select("project_id", src.alias("src"), "path", "ord", F.posexplode("tables").alias("at", "t"))
    rows = rows.select("project_id", "src", F.concat(F.lit("table:"), "t.table").alias("dst"), F.lit("QUERIES").alias("type"), F.array("t.op").alias("ops"), order(F.col("at")).alias("ord"))
    key = ["project_id", "src", "dst"]
    single, repeated = split_by_key(rows, key)
    repeated = repeated.groupBy(*key, "type").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ops")))).alias("ops"), F.min("ord").alias("ord"))
    return shaped(single.unionByName(repeated.select(*single.columns)), EDGES)


def edges_renders(facts: DataFrame) -> DataFrame:
    return edge("RENDERS", symbol("owner"), fact(facts, "template").withColumn("dst", F.concat(F.lit("template:"), "value")))


def edges_mirrors(nodes: DataFrame, fields: DataFrame) -> DataFrame:
    """Schemas to the ORM models of their stem, with the shared part of the schema's fields, inherited ones included."""
    lists = fields.groupBy("project_id", "id").agg(F.collect_set("field").alias("all_fields"))
    typed = nodes.where(F.col("type").isin(*MODEL_TYPES)).select("project_id", "id", "type", short_name(F.col("name")).alias("short"), "ord").join(lists, ["project_id", "id"])
    schemas = typed.where("type = 'Schema'").select("project_id", F.col("id").alias("src"), F.lower(schema_stem(F.col("short"))).alias("stem"), F.col("all_fields").alias("s"), "ord")
    models = typed.where("type = 'ORMModel'").select("project_id", F.col("id").alias("dst"), F.lower("short").alias("stem"), F.col("all_fields").alias("o"))
    pairs = schemas.join(models, ["project_id", "stem"])
    score = confidence(F.size(F.array_intersect("s", "o")), F.size("s"))
    return shaped(pairs.select("project_id", "src", "dst", F.lit("MIRRORS").alias("type"), score.alias("confidence"), F.struct(F.lit("￿").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b")).alias("ord")).where("confidence > 0"), EDGES)


def assign_function_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Plain functions become handlers, dependencies or middleware, by the links they have, in this order."""
    to = lambda kind: edges.where(F.col("type") == kind).select("project_id", F.col("dst").alias("id"), F.lit(True).alias(f"is_{kind}")).distinct()
    marked = nodes.join(to("HANDLED_BY"), ["project_id", "id"], "left").join(to("DEPENDS_ON"), ["project_id", "id"], "left")
    role = F.when(F.col("is_HANDLED_BY"), "Handler").when(F.col("is_DEPENDS_ON"), "Dependency").when(F.col("middleware"), "Middleware").otherwise("Function")
    return marked.withColumn("type", F.when(F.col("type") == "Function", role).otherwise(F.col("type"))).select(*nodes.columns)


def target_nodes(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes that only links name: tables, templates, and dependencies that are variables or external."""
    rows = edges.where("type in ('MAPS_TO', 'REFERENCES', 'QUERIES', 'RENDERS', 'DEPENDS_ON')")
    rows = rows.groupBy(F.xxhash64("project_id", "dst").alias("__hash"), "project_id", F.col("dst").alias("id")).agg(F.min("ord").alias("ord"))
    rows = written(rows.select("project_id", "id", "ord"))
    have = written(known.select("project_id", "id").join(rows.select("project_id", "id"), ["project_id", "id"], "left_semi"))
    rows = rows.join(have, ["project_id", "id"], "left_anti")
    external = F.col("id").startswith("external:")
    kind = F.when(F.col("id").startswith("table:"), "Table").when(F.col("id").startswith("template:"), "Template").otherwise("Dependency")
    name = F.when(external | (kind != "Dependency"), F.regexp_replace("id", "^(table|template|external):", "")).otherwise(F.regexp_replace("id", "^[^:]*:", ""))
    module = F.when((kind == "Dependency") & ~external, F.regexp_replace("id", ":.*$", ""))
    return shaped(rows.select("project_id", "id", kind.alias("type"), name.alias("name"), module.alias("module"), F.when(external, True).alias("external"), "ord"), NODES)


def by_kind(facts: DataFrame) -> DataFrame:
    """Facts of a kind lie together in each partition, in the order in which they came.

    A family of edges reads few kinds, so its scan skips the pages of all others. Sorted by a number, which needs no
    comparison of texts.
    """
    return facts.sortWithinPartitions(F.crc32("kind"))


def needed_edges(node_types: Iterable[str], edge_types: Iterable[str]) -> set[str]:
    """Types of the edges that nodes and edges of these types are told by, these edges included."""
    made = {*edge_types, *(kind for node in node_types for kind in TOLD_BY.get(node, ()))}
    return made | {"DEPENDS_ON"} if made & {*LATE} else made


def build_graph(facts: DataFrame, grouped: bool = False, node_types: Iterable[str] = NODE_TYPES, edge_types: Iterable[str] = EDGE_TYPES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every project in ``facts``, in the schemas of ``apiloom.schemas``.

    Everything is keyed by project, so projects never meet. A dependency that is a variable gets its node before any
    edge is made, so results do not depend on the order of functions. ``grouped``: the facts are a table that was
    written as :func:`by_kind` has them, and are not written again.

    With ``node_types`` or ``edge_types`` the nodes and edges of these types are those of the whole graph, and there are
    no others, but for nodes that only dependencies name, which are always there; what tells of neither is not made.
    """
    hashed_joins(facts.sparkSession)
    facts = facts if grouped else written(by_kind(facts))
    node_types, edge_types = {*node_types}, {*edge_types}
    made = needed_edges(node_types, edge_types)
    with_classes = bool(node_types & {*CLASS_TYPES} or made & {*TYPED})
    kinds = sorted({kind for of in made for kind in RESOLVED.get(of, ())} | ({"base"} if with_classes else set()))
    resolved = written(resolve_refs(all_refs(facts, kinds), facts))
    nodes = declared_nodes(facts)
    if with_classes:
        classes, inherits, fields = classify_classes(facts, resolved)
        typed = nodes.join(classes.select("project_id", "id", F.col("type").alias("class_type"), F.col("orm_base").alias("is_base"), F.col("tablename").alias("t"), "is_table"), ["project_id", "id"], "left")
        is_class = F.col("type") == "Class"
        named = F.when(F.col("class_type") == "ORMModel", F.coalesce("t", F.when(F.col("is_table"), F.lower(short_name(F.col("name"))))))
        nodes = typed.withColumn("tablename", named).withColumn("orm_base", F.when(is_class, F.col("is_base"))).withColumn("type", F.when(is_class, F.col("class_type")).otherwise(F.col("type"))).select(*NODES.names)
    nodes = written(nodes)

    links = Links(facts, resolved, nodes, kinds)
    depends = written(edges_depends_on(links) if "DEPENDS_ON" in made else _none(facts, EDGES))
    variables = written(target_nodes(depends, nodes))
    links.add_nodes(variables)
    middleware, outside = edges_middleware(links)
    families = {
        ("DEFINES",): lambda: edges_defines(facts), ("INHERITS",): lambda: shaped(inherits, EDGES), ("DEPENDS_ON",): lambda: depends, ("ACCEPTS",): lambda: edges_accepts(links), ("RETURNS",): lambda: edges_returns(links),
        ("HANDLED_BY",): lambda: edges_handled_by(facts), ("HAS_ROUTE",): lambda: edges_has_route(links), ("MIDDLEWARE",): lambda: middleware, ("CALLS",): lambda: edges_calls(links),
        ("USES",): lambda: edges_uses(links).unionByName(edges_uses_field(links, nodes)), ("INCLUDES",): lambda: edges_includes(links), ("MAPS_TO", "REFERENCES", "RELATES_TO"): lambda: edges_orm(links, classes),
        ("RENDERS",): lambda: edges_renders(facts), ("MIRRORS",): lambda: edges_mirrors(nodes, fields),
    }
    found = written(reduce(DataFrame.unionByName, [family() for types, family in families.items() if made & {*types}], _none(facts, EDGES)))
    edges = merged(found, ["project_id", "src", "dst", "type"], EDGES)
    edges = written(edges.unionByName(edges_queries(facts)) if "QUERIES" in made else edges)
    wanted = edges if made == edge_types else edges.where(F.col("type").isin(*edge_types))
    if not node_types:
        return variables, wanted

    if node_types & {*FUNCTION_TYPES, "Table", "Template"}:
        sources = fact(facts, "param").where("value is not null").groupBy("project_id", symbol("owner").alias("id")).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "value"))), lambda x: F.struct(x["name"], x["value"]))).alias("headers"))
        marked = edges.where("type = 'MIDDLEWARE'").select("project_id", F.col("dst").alias("id"), F.lit(True).alias("is_middleware")).distinct()
        declared = nodes.join(sources, ["project_id", "id"], "left").join(written(marked), ["project_id", "id"], "left")
        declared = declared.withColumn("param_sources", F.when(F.col("type") == "Function", F.col("headers"))).withColumn("middleware", F.when(F.col("type") == "Function", F.col("is_middleware"))).select(*NODES.names)
        known = nodes.unionByName(variables)
        targets = written(target_nodes(edges, known))
        outside = written(outside.dropDuplicates(["project_id", "id"]))
        taken = known.unionByName(targets).select("project_id", "id").join(outside.select("project_id", "id"), ["project_id", "id"], "left_semi")
        outside = outside.join(written(taken), ["project_id", "id"], "left_anti")
        others = [assign_function_roles(declared, edges), targets, outside]
    else:
        others = [nodes.where("type <> 'Function'")]
    if "Route" in node_types:
        others.append(route_nodes(links, include_chains(nodes, edges)))
    others = reduce(DataFrame.unionByName, others)
    return written(variables.unionByName(others if node_types == {*NODE_TYPES} else others.where(F.col("type").isin(*node_types)))), wanted


def _none(facts: DataFrame, schema: T.StructType) -> DataFrame:
    return facts.sparkSession.createDataFrame([], schema)
