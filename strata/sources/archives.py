"""Bundles of packages as tables of files: which base, which file wins, and where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bundle_kind(path: Column) -> Column:
    """aab, xapk, apks or apkm by a path's suffix, else apk."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(suffix.isin("aab", "xapk", "apks", "apkm"), suffix).otherwise("apk")


def merged(files: DataFrame, keys: tuple = ()) -> DataFrame:
    """files (keys.., name, size, split, is_base) less those that another split's file of the same name beats:
    the base's wins, then the largest, then that of the least split."""
    order = Window.partitionBy(*keys, "name").orderBy(F.col("is_base").desc(), F.col("size").desc(), "split")
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def flattened_path(path: Column) -> Column:
    """Where a module's file of an app bundle stands in a package; null for what has no place there."""
    rest = F.regexp_extract(path, "^[^/]+/(.*)$", 1)
    return (
        F.when(rest.startswith("dex/"), F.regexp_replace(rest, "^dex/", ""))
        .when(rest.rlike("^(lib|res|assets)/"), rest)
        .when(rest.startswith("manifest/"), F.regexp_replace(rest, "^manifest/", ""))
        .when(rest.startswith("root/"), F.regexp_replace(rest, "^root/", ""))
    )


def dex_names(files: DataFrame, keys: tuple = ("app_id",)) -> DataFrame:
    """files (keys.., split, name) of code with `target`: classes.dex, classes2.dex and so on by split and name."""
    order = Window.partitionBy(*keys).orderBy("split", "name")
    n = F.row_number().over(order)
    return files.withColumn("target", F.when(n == 1, "classes.dex").otherwise(F.concat(F.lit("classes"), n.cast("string"), F.lit(".dex"))))
