"""URL filters: rules by longest match, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, beginning of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?`` or ``#``.

    Both are empty for a null url and for one without ``://``.
    """
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for what, at, begins in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begins)
        rule = F.when(fits, F.lit(at + begins)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_grams(host: Column, path: Column, sizes: Sequence[int] = (3, 4)) -> Column:
    """Character n-grams of host and path, each marked with the part it comes from."""

    def grams(part: Column, mark: str) -> Column:
        framed = F.concat(F.lit("^"), part, F.lit("$"))
        of = lambda n: F.when(F.length(framed) >= n, F.transform(F.sequence(F.lit(1), F.length(framed) - (n - 1)), lambda i: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
        return F.concat(*[of(n) for n in sizes])

    return F.concat(grams(host, "h:"), grams(path, "p:"))


def _vectors(urls: DataFrame, buckets: int) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    named = urls.withColumn("__host", host).withColumn("__path", path)
    named = named.withColumn("__grams", url_grams(F.col("__host"), F.col("__path")))
    return HashingTF(inputCol="__grams", outputCol="__vector", numFeatures=buckets, binary=True).transform(named)


def fit_url_model(labelled: DataFrame, buckets: int = 4096, max_rows: int = 10_000) -> LogisticRegressionModel | None:
    """Logistic regression from a small table (url, blocked 0/1); of a larger one the ``max_rows`` urls of least hash.

    None if the table does not hold both labels.
    """
    rows = labelled.select("url", F.col("blocked").cast("double").alias("blocked")).where("url is not null and blocked in (0, 1)")
    rows = rows.distinct().orderBy(F.xxhash64("url"), "url", "blocked").limit(max_rows)
    rows = _vectors(rows, buckets).select("__vector", "blocked").persist()
    try:
        if rows.select("blocked").distinct().count() < 2:
            return None
        return LogisticRegression(featuresCol="__vector", labelCol="blocked", maxIter=30, regParam=0.01).fit(rows)
    finally:
        rows.unpersist()


def rule_labelled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """A labelled table from the pages that a rule decides: (url, blocked)."""
    _, verdict = matched_rule(*host_and_path(F.col("url")), rules)
    return pages.select("url", (verdict == "block").cast("int").alias("blocked")).where("blocked is not null")


def judge_urls(pages: DataFrame, model: LogisticRegressionModel | None, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, buckets: int = 4096) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every page.

    The longest rule decides; where none fits, the model's probability of ``blocked`` does (block from ``threshold``
    up), and without a model the verdict is allow. A null, empty or malformed url has an empty host and path and is
    judged by the model too. Repeated rows and null ids are kept, other columns are dropped, an empty table gives none.
    """
    from pyspark.ml.functions import vector_to_array

    rows = _vectors(pages.select("page_id", "url"), buckets)
    if model is None:
        rows = rows.withColumn("__score", F.lit(0.0))
    else:
        rows = model.setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__predicted").transform(rows).withColumn("__score", vector_to_array("__p")[1])
    rule, verdict = matched_rule(F.col("__host"), F.col("__path"), rules)
    learned = F.when(F.col("__score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.col("__score").alias("score"))
