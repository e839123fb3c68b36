"""Comparing reports: fingerprints, baselines and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.scoring import first_of

KEY = ["app_id", "rule_id", "class_name", "method_name", "category"]


def fingerprint(rule: Column, class_name: Column, method: Column, evidence: Column) -> Column:
    """SHA-1 of what a finding is about, the same after code has moved."""
    said = F.regexp_replace(F.regexp_replace(F.coalesce(evidence, F.lit("")), r"@offset \d+", "@offset N"), "0x[0-9a-fA-F]+", "0xN")
    parts = [F.coalesce(rule, F.lit("")), F.coalesce(class_name, F.lit("")), F.coalesce(method, F.lit("")), F.trim(said)]
    return F.sha1(F.concat_ws("|", *parts))


def fingerprinted(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(*(F.col(c) for c in ("rule_id", "class_name", "method_name", "evidence"))))


def baseline_split(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """findings with a fingerprint and baseline_status: `known` if baseline (fingerprint) has it, else `new`."""
    known = baseline.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    return fingerprinted(findings).join(known, "fingerprint", "left").withColumn("baseline_status", F.when(F.col("_known"), "known").otherwise("new")).drop("_known")


def report_diff(old: DataFrame, new: DataFrame, order: list) -> DataFrame:
    """(KEY, status, old and new severity and confidence): NEW, FIXED, CHANGED or UNCHANGED for each key.

    order puts the row that speaks for a key first, where a report has several.
    """
    def side(rows: DataFrame, name: str) -> DataFrame:
        return first_of(rows, KEY, order).select(*KEY, F.col("severity").alias(f"{name}_severity"), F.col("confidence").alias(f"{name}_confidence"), F.lit(True).alias(f"_{name}"))

    both = side(old, "old").join(side(new, "new"), KEY, "full_outer")
    same = (F.col("old_severity") == F.col("new_severity")) & (F.col("old_confidence") == F.col("new_confidence"))
    status = F.when(F.col("_old").isNull(), "NEW").when(F.col("_new").isNull(), "FIXED").when(same, "UNCHANGED").otherwise("CHANGED")
    return both.select(*KEY, status.alias("status"), "old_severity", "new_severity", "old_confidence", "new_confidence")
