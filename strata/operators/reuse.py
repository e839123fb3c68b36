"""Results kept by the content of a method, so that unchanged code isn't analysed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.plans.keep import written

#: The columns of instructions that hashes and method-level detectors read.
READ = ("method", "pos", "class_name", "method_name", "opcode", "kind", "registers", "dst", "text", "num", "ref", "label")


def body_hashes(code: DataFrame) -> DataFrame:
    """(method, body): a hash of each method's name and instructions with their places; lines and comments don't count.

    Hashes of the instructions are added up, so that a method's code is neither dealt nor held together for it.
    """
    line = F.concat_ws(" ", "opcode", F.array_join("registers", ","), F.coalesce("text", F.lit("")), F.coalesce(F.col("num").cast("string"), F.lit("")), F.coalesce("ref", F.lit("")), F.coalesce("label", F.lit("")))
    each = code.where("method is not null").select("method", F.xxhash64("pos", line).alias("x"), F.xxhash64(line, F.lit("body"), "pos").alias("y"))
    marks = [F.count("*"), *(f for c in ("x", "y") for f in (F.bit_xor(c), F.sum(F.shiftright(c, 21))))]
    summed = each.groupBy("method").agg(*(m.cast("string").alias(f"_{i}") for i, m in enumerate(marks)))
    return summed.select("method", F.unhex(F.sha2(F.concat_ws("\n", "method", *(f"_{i}" for i in range(len(marks)))), 256)).alias("body"))


def analysed(code: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What analyse finds in code, (method, ..), with the body it was found in; a method without a finding has a row of
    nulls, so that it counts as analysed."""
    found = analyse(code)
    return written(body_hashes(code).join(found, "method", "left"))


def current(code: DataFrame, kept: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What analyse finds in code, taken from kept (see analysed) for each body that is there, found anew for the others.

    analyse must look at methods one by one. The result is that of analyse(code).
    """
    bodies = written(body_hashes(code))
    fresh = written(bodies.join(kept.select("body"), "body", "left_anti").select("method"))
    anew = analyse(code.join(fresh, "method", "left_semi"))
    old = kept.where("pos is not null").join(bodies.select("body"), "body", "left_semi")
    return anew.select(*anew.columns).unionByName(old.select(*anew.columns))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key: a table of results that runs only append to, as it stands."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
