"""Findings as rows of report files: static-analysis results, rules and baselines; configuration read from XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the result format: its level for each severity.
LEVELS = (("CRITICAL", "error"), ("HIGH", "error"), ("MEDIUM", "warning"), ("LOW", "note"), ("INFO", "none"))


def level(severity: Column) -> Column:
    """The result level of a severity; warning for one that isn't known."""
    return F.coalesce(*(F.when(severity == s, word) for s, word in LEVELS), F.lit("warning"))


def results(findings: DataFrame) -> DataFrame:
    """(app_id, event_id, ruleId, ruleIndex, level, uri, startLine) of findings; ruleIndex numbers the rules of an
    app by name, from 0. A finding without a class is in `unknown`, one without a line in line 1."""
    rules = findings.groupBy("app_id").agg(F.array_sort(F.collect_set("rule_id")).alias("_rules"))  # names of rules: a fixed few
    path = F.replace(F.replace(F.coalesce("class_name", F.lit("")), F.lit("L"), F.lit("")), F.lit(";"), F.lit(""))
    return findings.join(rules, "app_id").select(
        "app_id", "event_id", F.col("rule_id").alias("ruleId"), (F.array_position("_rules", F.col("rule_id")) - 1).cast("int").alias("ruleIndex"), level(F.col("severity")).alias("level"),
        F.concat(path, F.lit(".smali")).alias("uri"), F.greatest(F.coalesce("line_number", F.lit(1)), F.lit(1)).alias("startLine"),
    )


def write_baseline(fingerprints: DataFrame, path: str) -> None:
    """Write the distinct fingerprints, a JSON object a line."""
    fingerprints.select("fingerprint").where("fingerprint is not null").distinct().write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint) of a baseline that write_baseline wrote."""
    return spark.read.schema("fingerprint string").json(path).where("fingerprint is not null").distinct()


#: What is read of a network-security configuration; domain-configs may lie within others.
_PINS = "`pin-set`: array<struct<_expiration: string>>"
_DOMAIN = "_cleartextTrafficPermitted: string, domain: array<struct<_VALUE: string, _includeSubdomains: string>>, " + _PINS
_CONFIG = (
    f"`base-config` array<struct<_cleartextTrafficPermitted: string>>, `domain-config` array<struct<{_DOMAIN}, `domain-config`: array<struct<{_DOMAIN}>>>>,"
    " `debug-overrides` array<struct<`trust-anchors`: array<struct<certificates: array<struct<_src: string>>>>>>, _corrupt_record string"
)


def network_config(configs: DataFrame) -> DataFrame:
    """(app_id, rule_id, severity, detail) that network-security configurations (app_id, xml) break: clear text for all
    or for domains, user certificates in debug overrides, pins with an end, and no pins at all.

    A domain-config is one row with its domains, `(unspecified)` without any. Text that is no XML gives no row.
    """
    parsed = configs.select("app_id", F.from_xml("xml", _CONFIG, {"mode": "PERMISSIVE", "valueTag": "_VALUE"}).alias("c")).where("c._corrupt_record is null and c is not null")
    empty = F.array().cast("array<struct<rule_id:string,severity:string,detail:string>>")
    row = lambda rule, severity, detail: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), detail.alias("detail"))
    true_ = lambda x: F.lower(F.coalesce(x["_cleartextTrafficPermitted"], F.lit(""))) == "true"
    each_of = lambda c: F.coalesce(c, F.array())
    domains = each_of(F.col("c.`domain-config`"))
    pins = F.concat(F.flatten(F.transform(domains, lambda d: each_of(d["pin-set"]))), F.flatten(F.transform(F.flatten(F.transform(domains, lambda d: each_of(d["domain-config"]))), lambda d: each_of(d["pin-set"]))))
    named = lambda d: F.array_join(F.transform(each_of(d["domain"]), lambda x: F.trim(F.coalesce(x["_VALUE"], F.lit("")))), ", ")
    anchors = F.get(F.get(F.col("c.`debug-overrides`"), F.lit(0))["trust-anchors"], F.lit(0))["certificates"]
    each = F.concat(
        F.when(true_(F.get(F.col("c.`base-config`"), F.lit(0))), F.array(row("NETWORK_NSC_CLEARTEXT", "HIGH", F.lit("base")))).otherwise(empty),
        F.transform(F.filter(domains, true_), lambda d: row("NETWORK_NSC_DOMAIN_CLEARTEXT", "MEDIUM", F.coalesce(F.nullif(named(d), F.lit("")), F.lit("(unspecified)")))),
        F.coalesce(F.transform(F.filter(anchors, lambda a: a["_src"] == "user"), lambda a: row("NETWORK_NSC_USER_CA", "MEDIUM", a["_src"])), empty),
        F.transform(F.filter(pins, lambda p: p["_expiration"] != ""), lambda p: row("NETWORK_PIN_EXPIRY", "INFO", p["_expiration"])),
        F.when(F.size(pins) == 0, F.array(row("NETWORK_PINNING_MISSING", "LOW", F.lit("")))).otherwise(empty),
    )
    return parsed.select("app_id", F.explode(each).alias("f")).select("app_id", "f.*")


def code_strings(lines: DataFrame) -> DataFrame:
    """(file, value): the distinct literals of const-string lines (file, line), of at least four characters."""
    value = F.regexp_extract("line", r'const-string(?:/jumbo)? [vp]\d+, "((?:[^"\\]|\\.)*)"', 1)
    return lines.select("file", value.alias("value")).where(F.length("value") >= 4).distinct()
