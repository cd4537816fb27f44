"""Dotted names, as a module sees them, to modules and symbols of its project: joins on the project alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiloom.functions.names import short_name
from apiloom.sources.shared import written

MODULE = ["project_id", "module"]


def module_index(facts: DataFrame) -> DataFrame:
    """(project_id, name, module): every module by its own name, and by each dotted suffix that no other module has."""
    modules = facts.where("kind = 'module'").select(*MODULE).distinct()
    parts = F.split("module", "[.]")
    suffix = F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    suffixes = modules.where(F.contains("module", F.lit("."))).select("project_id", "module", suffix.alias("name"))
    unique = suffixes.groupBy("project_id", "name").agg(F.count("*").alias("n"), F.min("module").alias("module")).where("n = 1").drop("n")
    exact = modules.select("project_id", F.col("module").alias("name"), "module")
    return exact.unionByName(unique.join(exact.select("project_id", "name"), ["project_id", "name"], "left_anti"))


def find_module(names: DataFrame, modules: DataFrame) -> DataFrame:
    """``names`` (project_id, name) with ``found``: the module of that name, else the only one whose name ends so, else null."""
    return names.join(modules.withColumnRenamed("module", "found"), ["project_id", "name"], "left")


def qualified_names(facts: DataFrame) -> DataFrame:
    """(project_id, module, qualname) of everything a module defines."""
    return facts.where("kind in ('symbol', 'function', 'class')").select(*MODULE, F.col("name").alias("qualname")).distinct()


def import_table(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """(project_id, module, alias, target, attr): what each imported name stands for; the last import of a name counts."""
    last = facts.where("kind = 'import'").groupBy(*MODULE, F.col("name").alias("alias")).agg(F.max_by(F.struct("ref", "value"), "ord").alias("what"))
    named = last.select(*MODULE, "alias", F.col("what.ref").alias("name"), F.col("what.value").alias("attr"))
    return find_module(named, modules).where("found is not null").select(*MODULE, "alias", F.col("found").alias("target"), "attr")


def resolve_refs(refs: DataFrame, facts: DataFrame, max_reexports: int = 10) -> DataFrame:
    """(project_id, module, ref, kind, target_module, qualname, id) of the references that resolve.

    ``refs``: (project_id, module, ref). The first segment is a symbol of the module, else an import; each further one
    a submodule, a symbol, or a re-export of what is found so far. The first is found by one join on the module's own
    names. What then is asked of another module (so many modules ask the same) is asked once for all, and a round
    resolves one segment of all these questions by three joins. Null references resolve to nothing.
    """
    modules = written(module_index(facts))
    defined = written(qualified_names(facts))
    imports = written(import_table(facts, modules))
    # What a name begins with is a symbol or an import of its own module; all others (builtins, locals) leave at once.
    own = defined.select(*MODULE, F.col("qualname").alias("head"), F.lit(True).alias("known")).join(imports.withColumnRenamed("alias", "head"), [*MODULE, "head"], "full")
    # A module repeats its references: each counts once before anything is joined.
    asked = refs.where("ref is not null").select(*MODULE, "ref").distinct()
    start = asked.withColumn("head", F.substring_index("ref", ".", 1)).join(own, [*MODULE, "head"])
    tail = F.slice(F.split("ref", "[.]"), 2, F.greatest(F.size(F.split("ref", "[.]")) - 1, F.lit(0)))
    to_symbol = F.col("known").isNotNull()
    begun = written(start.select(
        *MODULE,
        "ref",
        F.when(to_symbol, "symbol").otherwise("module").alias("kind"),
        F.when(to_symbol, F.col("module")).otherwise(F.col("target")).alias("at"),
        F.when(to_symbol, F.col("head")).otherwise("").alias("qual"),
        F.when(~to_symbol & F.col("attr").isNotNull(), F.concat(F.array("attr"), tail)).otherwise(tail).alias("rest"),
    ))
    question = ["project_id", "kind", "at", "qual", "rest"]
    questions = written(begun.where(F.size("rest") > 0).select(*question).distinct())
    answers = _followed(questions, modules, defined, imports, max_reexports)
    found = begun.where(F.size("rest") == 0).select(*MODULE, "ref", "kind", "at", "qual")
    further = begun.where(F.size("rest") > 0).join(answers, question).select(*MODULE, "ref", "found.*")
    done = found.unionByName(further)
    id_ = F.when(F.col("kind") == "symbol", F.concat("at", F.lit(":"), "qual")).otherwise(F.concat(F.lit("module:"), "at"))
    return done.select(*MODULE, "ref", "kind", F.col("at").alias("target_module"), F.col("qual").alias("qualname"), id_.alias("id"))


def _followed(questions: DataFrame, modules: DataFrame, defined: DataFrame, imports: DataFrame, max_reexports: int) -> DataFrame:
    """``questions`` (project_id, kind, at, qual, rest) that have an answer, with it: ``found``, a struct of kind, at and qual."""
    asked = F.struct(*[F.col(c) for c in questions.columns]).alias("asked")
    state = questions.select(asked, "*", F.lit(0).alias("hops"))
    done = None
    while True:
        head, tail = F.col("rest")[0], F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0)))
        step = state.withColumn("qualname", F.when(F.col("kind") == "symbol", F.concat("qual", F.lit("."), head)).otherwise(head))
        # What asks for no submodule or import has a key of its own that nothing has, lest all of a project meet under null.
        none = F.concat(F.lit("\0"), "at", F.lit(":"), "qualname")
        step = step.withColumn("name", F.when(F.col("kind") == "module", F.concat("at", F.lit("."), head)).otherwise(none)).withColumn("alias", F.when(F.col("kind") != "symbol", head).otherwise(none))
        step = step.join(modules.withColumnRenamed("module", "sub"), ["project_id", "name"], "left")
        step = step.join(defined.select("project_id", F.col("module").alias("at"), "qualname", F.lit(True).alias("known")), ["project_id", "at", "qualname"], "left")
        step = step.join(imports.withColumnRenamed("module", "at"), ["project_id", "at", "alias"], "left")
        to_sub, to_symbol = F.col("sub").isNotNull(), F.col("sub").isNull() & F.col("known").isNotNull()
        to_import = ~to_sub & ~to_symbol & F.col("target").isNotNull() & (F.col("hops") < max_reexports)
        moved = written(step.where(to_sub | to_symbol | to_import).select(
            "asked",
            "project_id",
            F.when(to_symbol, "symbol").otherwise("module").alias("kind"),
            F.when(to_sub, F.col("sub")).when(to_symbol, F.col("at")).otherwise(F.col("target")).alias("at"),
            F.when(to_symbol, F.col("qualname")).otherwise("").alias("qual"),
            F.when(to_import & F.col("attr").isNotNull(), F.concat(F.array("attr"), tail)).otherwise(tail).alias("rest"),
            (F.col("hops") + F.when(to_import, 1).otherwise(0)).alias("hops"),
        ))
        ended = moved.where(F.size("rest") == 0)
        done = ended if done is None else done.unionByName(ended)
        state = moved.where(F.size("rest") > 0)
        if state.isEmpty():
            break
    return done.select("asked.*", F.struct("kind", "at", "qual").alias("found"))


def resolve_class_name(refs: DataFrame, facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(project_id, module, ref, id): the symbol a reference resolves to, else the project's only class of that last name."""
    classes = facts.where("kind = 'class'").select("project_id", short_name(F.col("name")).alias("short"), F.concat("module", F.lit(":"), "name").alias("only"))
    single = classes.groupBy("project_id", "short").agg(F.count("*").alias("n"), F.min("only").alias("only")).where("n = 1").drop("n")
    asked = refs.select(*MODULE, "ref").distinct().withColumn("short", short_name(F.col("ref")))
    symbols = resolved.where("kind = 'symbol'").select(*MODULE, "ref", "id")
    found = asked.join(symbols, [*MODULE, "ref"], "left").join(single, ["project_id", "short"], "left")
    return found.select(*MODULE, "ref", F.coalesce("id", "only").alias("id")).where("id is not null")
