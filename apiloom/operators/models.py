"""File-local checks of models, annotations and response models: facts of one file, no resolution across files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiloom.plans.build import class_ancestry

# Base names that make a class a model.
MODEL_BASES = ("BaseModel", "SQLModel", "BaseSettings", "RootModel")
FILE = ["project_id", "path"]


def _classes(facts: DataFrame) -> DataFrame:
    """The last class of each name in a file counts."""
    return facts.where("kind = 'any_class'").groupBy(*FILE, "name").agg(F.max("line").alias("line"))


def _above(facts: DataFrame) -> DataFrame:
    """(project_id, path, name, above): names that a class reaches through bases written as plain names."""
    key = F.to_json(F.struct(*FILE))
    bases = facts.where("kind = 'any_base'").select(key.alias("project_id"), F.col("owner").alias("id"), F.col("ref").alias("base"))
    up = class_ancestry(bases)
    place = F.from_json("project_id", "project_id string, path string")
    return up.select(place["project_id"].alias("project_id"), place["path"].alias("path"), F.col("id").alias("name"), F.col("ancestor").alias("above"))


def list_models(facts: DataFrame) -> DataFrame:
    """(project_id, path, name): classes, nested ones too, that reach a model base within their file."""
    models = _above(facts).where(F.col("above").isin(*MODEL_BASES)).select(*FILE, "name").distinct()
    return _classes(facts).join(models.unionByName(_classes(facts).where(F.col("name").isin(*MODEL_BASES)).select(*FILE, "name")).distinct(), [*FILE, "name"]).select(*FILE, "name")


def inspect_model(facts: DataFrame, models: DataFrame) -> DataFrame:
    """(project_id, path, model, fields, validators, error) of each model asked for (project_id, path, model).

    Fields (name, type, default) and validators (function, field) of the class's own body.
    """
    asked = models.select(*FILE, "model").distinct()
    known = _classes(facts).select(*FILE, F.col("name").alias("model"), F.lit(True).alias("known"))
    is_model = list_models(facts).select(*FILE, F.col("name").alias("model"), F.lit(True).alias("is_model"))
    listed = lambda kind, what, **parts: facts.where(F.col("kind") == kind).groupBy(*FILE, F.col("owner").alias("model")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *[F.col(v).alias(k) for k, v in parts.items()]))), lambda x: F.struct(*[x[k].alias(k) for k in parts])).alias(what))
    rows = asked.join(known, [*FILE, "model"], "left").join(is_model, [*FILE, "model"], "left")
    rows = rows.join(listed("any_field", "fields", name="name", type="value", default="extra"), [*FILE, "model"], "left").join(listed("validator", "validators", function="name", field="value"), [*FILE, "model"], "left")
    error = F.when(F.col("known").isNull(), F.concat(F.lit("Model '"), "model", F.lit("' not found in "), "path")).when(F.col("is_model").isNull(), F.concat(F.lit("'"), "model", F.lit("' does not inherit from a known model base class")))
    ok = error.isNull()
    return rows.select(*FILE, "model", F.when(ok, F.coalesce("fields", F.array().cast("array<struct<name:string,type:string,default:string>>"))).alias("fields"), F.when(ok, F.coalesce("validators", F.array().cast("array<struct<function:string,field:string>>"))).alias("validators"), error.alias("error"))


def find_model_usages(facts: DataFrame, models: DataFrame) -> DataFrame:
    """(project_id, model, path, line, function): annotations whose text is exactly the model's name (project_id, model)."""
    marks = facts.where("kind = 'annotation'").select("project_id", F.col("value").alias("model"), "path", "line", F.col("owner").alias("function"))
    return marks.join(models.select("project_id", "model").distinct(), ["project_id", "model"])


def validate_response_models(facts: DataFrame) -> DataFrame:
    """(project_id, path, method, route_path, handler, line): route decorators without a response_model."""
    return facts.where("kind = 'verb_decorator' and not flag").select(*FILE, F.col("name").alias("method"), F.col("value").alias("route_path"), F.col("owner").alias("handler"), "line")


def schema_orm_diff(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each pair (project_id, orm_file, orm_model, schema_file, schema_model) with the fields of one, the other, and both.

    Fields are annotated attributes, inherited ones within the file included; arrays are sorted.
    """
    fields = facts.where("kind = 'any_field'").select(*FILE, F.col("owner").alias("above"), F.col("name").alias("field"))
    line = _above(facts).unionByName(_classes(facts).select(*FILE, "name", F.col("name").alias("above"))).distinct()
    of = line.join(fields, [*FILE, "above"]).groupBy(*FILE, "name").agg(F.sort_array(F.collect_set("field")).alias("f"))
    side = lambda s: of.select("project_id", F.col("path").alias(f"{s}_file"), F.col("name").alias(f"{s}_model"), F.col("f").alias(f"{s}_f"))
    rows = pairs.join(side("orm"), ["project_id", "orm_file", "orm_model"], "left").join(side("schema"), ["project_id", "schema_file", "schema_model"], "left")
    none = F.array().cast("array<string>")
    orm, schema = F.coalesce("orm_f", none), F.coalesce("schema_f", none)
    return rows.select("project_id", "orm_model", "schema_model", F.array_except(schema, orm).alias("in_schema_not_in_orm"), F.array_except(orm, schema).alias("in_orm_not_in_schema"), F.array_intersect(orm, schema).alias("matching_fields"))
