"""Bundled code: kits and trackers by class prefix, libraries, versions and known vulnerabilities.

A prefix that ends at a package or class is matched by equality with the prefixes of the class name itself,
cut at each slash, so classes join the catalogue by a hash and not row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.catalogues import inventory as values
from strata.functions.text import slug, version
from strata.operators.scoring import first_of
from strata.plans.keep import fixed


def prefixes_of(name: Column, mark: str = "/") -> Column:
    """array<string>: the name and what it starts with up to and including each mark."""
    parts = F.split(name, mark)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), mark), F.when(n < F.size(parts), F.lit(mark)).otherwise(F.lit(""))))
    return F.array_distinct(heads)


def prefix_join(rows: DataFrame, column: str, catalogue: DataFrame, mark: str = "/") -> DataFrame:
    """rows with each catalogue row whose `prefix`, which ends at a mark or is a whole name, begins the column."""
    cut_ = rows.withColumn("_head", F.explode(prefixes_of(F.col(column), mark)))
    return cut_.join(catalogue, F.col("_head") == F.col("prefix")).drop("_head")


def starts_join(rows: DataFrame, column: str, catalogue: DataFrame) -> DataFrame:
    """rows with each catalogue row whose `prefix` begins the column, wherever it ends.

    The lengths that prefixes have are few, so the column is cut to each and joined by equality.
    """
    lengths = sorted({r[0] for r in catalogue.select(F.length("prefix")).distinct().collect()})
    heads = F.transform(F.filter(F.lit(lengths), lambda n: n <= F.length(column)), lambda n: F.substring(F.col(column), F.lit(1), n))
    return rows.withColumn("_head", F.explode(heads)).join(catalogue, F.col("_head") == F.col("prefix")).drop("_head")


def kits(classes: DataFrame) -> DataFrame:
    """(app_id, name, prefix, category, risk, cwe_id): kits of which an app has a class; the first listed for a class."""
    table = fixed(classes.sparkSession, [(*r, i) for i, r in enumerate(values.SDKS)], "name string, prefix string, category string, risk string, cwe_id string, ord int")
    hits = first_of(starts_join(classes.select("app_id", "class_name").distinct(), "class_name", table), ["app_id", "class_name"], ["ord"])
    return hits.select("app_id", "name", "prefix", "category", "risk", "cwe_id").distinct()


def trackers(classes: DataFrame) -> DataFrame:
    """(app_id, rule_id, name, prefix, category): trackers of which an app has a class; the longest prefix of a class."""
    table = fixed(classes.sparkSession, [(*r, i) for i, r in enumerate(values.TRACKERS)], "name string, prefix string, category string, ord int")
    hits = first_of(starts_join(classes.select("app_id", "class_name").distinct(), "class_name", table), ["app_id", "class_name"], [F.desc(F.length("prefix")), "ord"])
    return hits.select("app_id", F.concat(F.lit("TRACKER_"), "category", F.lit("_"), slug(F.col("name"))).alias("rule_id"), "name", "prefix", "category").distinct()


def components(classes: DataFrame, versions: DataFrame) -> DataFrame:
    """(app_id, name, purl, version): libraries present by a class, with the mined version (app_id, name, version).

    The version is that mined under the library's own name, else under the least name that holds its short
    name, else `unknown`.
    """
    table = fixed(classes.sparkSession, values.LIBRARIES, "library string, template string, prefix string")
    found = starts_join(classes.select("app_id", "class_name").distinct(), "class_name", table).select("app_id", "library", "template").distinct()
    short = F.regexp_replace(F.lower("library"), "androidx-|kotlinx-", "")
    near = found.join(versions.withColumnRenamed("name", "mined"), "app_id", "left").where(F.col("mined").isNull() | (F.lower("library") == F.col("mined")) | F.col("mined").contains(short))
    best = near.groupBy("app_id", "library", "template").agg(F.min_by("version", F.struct(F.lower("library") != F.col("mined"), "mined")).alias("v"))
    all_ = found.join(best, ["app_id", "library", "template"], "left").withColumn("version", F.coalesce("v", F.lit("unknown")))
    return all_.select("app_id", F.col("library").alias("name"), F.replace("template", F.lit("{version}"), F.col("version")).alias("purl"), "version")


def vulnerable(parts: DataFrame, cves: DataFrame | None = None) -> DataFrame:
    """parts (.., purl, version) with (cve, fixed, cvss, severity) of each vulnerability fixed in a later version."""
    table = cves if cves is not None else fixed(parts.sparkSession, values.CVES, "package string, fixed string, cve string, cvss double")
    own = F.concat(F.substring_index("purl", "@", 1), F.lit("@"))
    hits = parts.where("version <> 'unknown'").withColumn("_own", own).join(table, F.col("_own") == F.col("package")).where(version(F.col("version")) < version(F.col("fixed")))
    severity = F.when(F.col("cvss") >= 9, "CRITICAL").when(F.col("cvss") >= 7, "HIGH").when(F.col("cvss") >= 4, "MEDIUM").otherwise("LOW")
    return hits.withColumn("severity", severity).drop("_own", "package")
