"""Scoring of findings: confidence, categories, vectors, thresholds, profiles, summaries and behaviours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.catalogues import scoring as values
from strata.plans.keep import fixed

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")


def severity_rank(severity: Column) -> Column:
    """5 for CRITICAL down to 1 for INFO; 0 for anything else."""
    return _rank(severity, SEVERITIES)


def confidence_rank(confidence: Column) -> Column:
    return _rank(confidence, CONFIDENCES)


def _rank(column: Column, names: tuple) -> Column:
    out = F.lit(0)
    for i, name in enumerate(names):
        out = F.when(column == name, len(names) - i).otherwise(out)
    return out


def _lower(confidence: Column) -> Column:
    return F.when(confidence == "HIGH", "MEDIUM").when(confidence == "MEDIUM", "LOW").otherwise(confidence)


def adjusted_confidence(findings: DataFrame) -> DataFrame:
    """findings with confidence_raw, and confidence lowered by where the finding stands. Apply it once.

    Rules that depend on nothing around them keep theirs. Else noisy rules have MEDIUM at most; library
    classes lose a level unless the finding is critical; test classes and methods lose one; and HIGH becomes
    MEDIUM in debug classes.
    """
    name, method = F.coalesce("class_name", F.lit("")), F.coalesce("method_name", F.lit(""))
    test = r"(^|/)(?i:test|mock|stub|fake|espresso|robolectric|junit)[/$]"
    library = name.rlike("|".join(values.LIBRARY_CLASSES))
    debug = name.rlike(r"(^|/)(?i:debug)[/$;]") | name.rlike(r"BuildConfig(\$|;|$)")
    c = F.col("confidence")
    c = F.when(F.col("rule_id").isin(*values.NOISY) & (c == "HIGH"), "MEDIUM").otherwise(c)
    c = F.when(library & (F.col("severity") != "CRITICAL"), _lower(c)).otherwise(c)
    c = F.when(name.rlike(test) | method.rlike(test), _lower(c)).otherwise(c)
    c = F.when(debug & (c == "HIGH"), "MEDIUM").otherwise(c)
    kept = F.when(F.col("rule_id").isin(*values.NEVER_DOWNGRADED), F.col("confidence")).otherwise(c)
    return findings.withColumns({"confidence_raw": F.col("confidence"), "confidence": kept})


def owasp_category(findings: DataFrame) -> DataFrame:
    """findings with owasp_category: by rule, by the first prefix that fits, by a flow's sink, by category."""
    names = dict(values.OWASP_NAMES)
    rule = F.col("rule_id")
    by = lambda table, column: F.try_element_at(F.create_map(*(F.lit(x) for k, v in table for x in (k, names[v]))), column)
    prefix = F.lit(None).cast("string")
    for start, code in reversed(values.OWASP_PREFIXES):
        prefix = F.when(rule.startswith(start), names[code]).otherwise(prefix)
    sink, up = F.lit(None).cast("string"), F.upper(rule)
    for marks, code in reversed((("EXEC|COMMAND", "M4"), ("WEBVIEW|JS_INJECT", "M4"), ("SQL", "M4"), ("OPEN_REDIRECT|DEEPLINK_REDIRECT", "M5"), ("NETWORK", "M5"), ("STORAGE|FILE_WRITE|PREFS", "M9"), ("PENDING_INTENT", "M8"), ("LOG", "M6"))):
        sink = F.when(up.rlike(marks), names[code]).otherwise(sink)
    found = F.coalesce(by(values.OWASP_RULES, rule), prefix, F.when(rule.startswith("TAINT_"), sink), by(values.OWASP_BY_CATEGORY, F.col("category")), F.lit(""))
    return findings.withColumn("owasp_category", found)


def cvss_vector(findings: DataFrame) -> DataFrame:
    """findings with cvss_vector: by source and sink label, by rule, by the longest rule that is a prefix of
    it, by severity. Columns taint_source and taint_sink may be null or empty, or missing altogether."""
    for c in {"taint_source", "taint_sink"} - set(findings.columns):
        findings = findings.withColumn(c, F.lit(None).cast("string"))
    rule = F.col("rule_id")
    flows = F.create_map(*(F.lit(x) for a, b, v in values.CVSS_FLOWS for x in (f"{a}>{b}", v)))
    exact = F.create_map(*(F.lit(x) for k, v in values.CVSS_RULES for x in (k, v)))
    severity = dict(values.CVSS_SEVERITIES)
    rest = F.try_element_at(F.create_map(*(F.lit(x) for k, v in severity.items() for x in (k, v))), F.col("severity"))
    prefix = F.lit(None).cast("string")
    for start, vector in sorted(values.CVSS_RULES, key=lambda x: len(x[0])):
        prefix = F.when(rule.startswith(start), vector).otherwise(prefix)
    flow = F.try_element_at(flows, F.concat_ws(">", "taint_source", "taint_sink"))
    return findings.withColumn("cvss_vector", F.coalesce(flow, F.try_element_at(exact, rule), prefix, rest, F.lit(severity["MEDIUM"])))


def at_least(findings: DataFrame, confidence: str = "LOW", severity: str = "INFO") -> DataFrame:
    """Findings of at least both levels."""
    return findings.where(
        (confidence_rank(F.col("confidence")) >= 3 - CONFIDENCES.index(confidence)) & (severity_rank(F.col("severity")) >= 5 - SEVERITIES.index(severity))
    )


def in_profile(findings: DataFrame, profile: str | None) -> DataFrame:
    """Findings whose rule belongs to a profile (L1 within L2 within R); all of them for an unknown one."""
    levels = ("L1", "L2", "R")
    if not profile or profile.upper() not in levels:
        return findings
    wanted = levels[: levels.index(profile.upper()) + 1]
    rule = F.col("rule_id")
    fits = rule.isin(*(r for p, r in values.PROFILE_RULES if p in wanted))
    for p, start in values.PROFILE_PREFIXES:
        if p in wanted:
            fits = fits | rule.startswith(start)
    return findings.where(fits)


def risk_grade(critical: Column, high: Column, medium: Column) -> Column:
    """F to A from the counts of an app's findings."""
    return (
        F.when(critical > 0, "F").when(high >= 3, "F").when(high >= 1, "D").when(medium >= 5, "D").when(medium >= 3, "C").when(medium >= 1, "B").otherwise("A")
    )


def summary(findings: DataFrame, *keys: str) -> DataFrame:
    """A row for each app (or other keys): total, a count for each severity and confidence, and the grade.

    The counts are conditional sums in one pass, combined before the shuffle.
    """
    keys = keys or ("app_id",)
    counted = findings.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES),
        *(F.count_if(F.col("confidence") == c).alias(f"confidence_{c.lower()}") for c in CONFIDENCES),
    )
    return counted.withColumn("risk_grade", risk_grade(F.col("critical"), F.col("high"), F.col("medium")))


def finding_order(findings: DataFrame) -> list[Column]:
    """The total order of a report: worst first, then by place."""
    return [F.desc("severity_rank"), F.desc("confidence_rank"), *(F.asc(c) for c in ("rule_id", "class_name", "method_name", "line_number", "evidence"))]


def behaviours(findings: DataFrame) -> DataFrame:
    """(app_id, name, weight, severity, tactic, contributing_rule_ids): behaviours all of whose components
    some finding of the app matches. A division: the components met are counted against those there are.

    The rule reported for a component is the least that matches it.
    """
    spark = findings.sparkSession
    rows = [(n, w, t, i, part, cat, len(cs)) for n, w, t, cs in values.BEHAVIOURS for i, (part, cat) in enumerate(cs)]
    parts = fixed(spark, rows, "name string, weight int, tactic string, slot int, part string, wants string, slots int")
    seen = findings.select("app_id", "rule_id", "category").distinct()
    fits = ((F.col("part") == "") | seen["rule_id"].contains(F.col("part"))) & ((F.col("wants") == "") | (seen["category"] == F.col("wants")))
    met = seen.join(parts, fits).groupBy("app_id", "name", "weight", "tactic", "slots", "slot").agg(F.min("rule_id").alias("rule_id"))
    whole = met.groupBy("app_id", "name", "weight", "tactic", "slots").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("slot", "rule_id"))).alias("rules"))
    bucket = F.when(F.col("weight") >= 16, "CRITICAL").when(F.col("weight") >= 8, "HIGH").when(F.col("weight") >= 4, "MEDIUM").when(F.col("weight") >= 1, "LOW").otherwise("INFO")
    return whole.where("n = slots").select("app_id", "name", "weight", bucket.alias("severity"), "tactic", F.col("rules.rule_id").alias("contributing_rule_ids"))


def gate(findings: DataFrame, severity: str = "HIGH") -> DataFrame:
    """(app_id, failed): whether an app has a finding of at least this severity."""
    worst = findings.groupBy("app_id").agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    return worst.select("app_id", (F.col("worst") >= 5 - SEVERITIES.index(severity)).alias("failed"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by a total order."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")
