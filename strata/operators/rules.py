"""Pattern rules over code text, line by line and over whole files.

A rule is matched by its own literal pattern, so no rules table is joined row by row with the text; a pattern is only
tried on lines that hold a word which its matches need, and not at all where it is that word.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.catalogues.rules import RULES
from strata.functions.text import is_test_class

#: rule, severity, confidence, category, cwe, cvss, language, multiline, pattern
Rule = tuple


def required_words(pattern: str) -> str | None:
    """A literal that every match holds: the longest run of plain letters outside groups and classes."""
    plain = re.sub(r"\[[^\]]*\]", " ", re.sub(r"\\.", " ", pattern))
    plain = re.sub(r"\([^()]*\)[?*+{]?|.[?*{]", " ", re.sub(r"\((?:[^()]|\([^()]*\))*\)[?*+{]?", " ", plain))
    if "|" in plain or re.search(r"\(\?[^:)]*\)", pattern):
        return None
    words = re.findall(r"[A-Za-z;>_/-]{4,}", plain)
    return max(words, key=len) if words else None


def literal(pattern: str) -> str | None:
    """The text that a pattern without operators stands for."""
    plain = re.sub(r"\\([^\w\s])", "", pattern)
    return None if re.search(r"[\\.^$|?*+()\[\]{}]", plain) else re.sub(r"\\([^\w\s])", r"\1", pattern)


def alternatives(pattern: str) -> list[str]:
    """The patterns between the bars outside groups and classes."""
    out, depth, inside, i = [""], 0, False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if c == "|" and not depth and not inside:
            out.append("")
        else:
            out[-1] += c
        inside = c == "[" or (inside and c != "]")
        depth += 0 if inside else (c == "(") - (c == ")")
        i += len(c)
    return out


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern is found in a text, by its words where these suffice or are missing."""
    if (whole := literal(pattern)) is not None:
        return F.contains(text, F.lit(whole))
    words = [required_words(p) for p in alternatives(pattern)]
    if not all(words):
        return text.rlike(pattern)
    some = F.lit(False)
    for word in words:
        some = some | F.contains(text, F.lit(word))
    return some & text.rlike(pattern)


def _facts(rule: Rule) -> Column:
    name, severity, confidence, category, cwe, cvss = rule[:6]
    return F.struct(
        F.lit(name).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
        F.lit(category).alias("category"), F.lit(cwe).alias("cwe_id"), F.lit(float(cvss)).alias("cvss"),
    )


def line_matches(lines: DataFrame, rules: Sequence[Rule] = RULES, language: str = "smali") -> DataFrame:
    """lines (.., line_no, line) with the facts and evidence of each single-line rule that a line matches."""
    rules = [r for r in rules if not r[7] and r[6] == language and r[8]]
    if not rules:
        rules = [("NONE", "INFO", "LOW", "", "", 0.0, language, False, "(?!)")]
    hits = F.concat_ws(",", *(F.when(matches(F.col("line"), r[8]), F.lit(str(i))) for i, r in enumerate(rules)))  # compiled, unlike a filter of an array
    each = lines.withColumn("_hit", F.explode(F.split(hits, ","))).where("_hit != ''")  # a test of hits itself would be pushed into the view
    facts = F.get(F.array(*map(_facts, rules)), F.col("_hit").cast("int"))
    evidence = F.format_string("Line %d: %s", F.col("line_no").cast("long"), F.substring(F.trim("line"), 1, 120))
    return each.withColumn("_hit", facts).select(*lines.columns, "_hit.*", evidence.alias("evidence"))


def file_matches(files: DataFrame, rules: Sequence[Rule] = RULES, language: str = "smali") -> DataFrame:
    """files (.., text) with the facts, line number and evidence of the first match of each multi-line rule."""
    rules = [r for r in rules if r[7] and r[6] == language and r[8]]

    def hit(rule: Rule) -> Column:
        pattern = F.lit("(?sm)" + rule[8])
        found = F.regexp_substr("text", pattern)
        line = F.regexp_count(F.substring("text", F.lit(1), F.regexp_instr("text", pattern) - 1), F.lit("\n")) + 1
        return F.when(found.isNotNull(), F.struct(_facts(rule).alias("facts"), line.alias("line_no"), found.alias("found")))

    hits = F.filter(F.array(*map(hit, rules)), lambda x: x.isNotNull()) if rules else F.array()
    rows = files.withColumn("_hit", F.explode(hits))
    snippet = F.substring(F.trim(F.replace(F.col("_hit.found"), F.lit("\n"), F.lit(" \u23ce "))), 1, 160)
    return rows.select(*files.columns, "_hit.facts.*", F.col("_hit.line_no").alias("line_no"), F.format_string("Line %d (multiline): %s", F.col("_hit.line_no").cast("long"), snippet).alias("evidence"))


def class_of(lines: DataFrame) -> DataFrame:
    """(file, class_name) by the first `.class` directive in a file's first ten lines."""
    heads = lines.where((F.col("line_no") <= 10) & F.col("line").startswith(".class"))
    return heads.groupBy("file").agg(F.min_by(F.element_at(F.split(F.trim("line"), r"\s+"), -1), "line_no").alias("class_name"))


def gated(rows: DataFrame, reachable: DataFrame | None = None, emitted: DataFrame | None = None) -> DataFrame:
    """Rows (class_name, rule_id, ..) outside test classes, in reachable classes, of rules not yet emitted."""
    out = rows.where(~is_test_class(F.coalesce("class_name", F.lit(""))))
    if reachable is not None:
        out = out.join(reachable.select("class_name").distinct(), "class_name", "left_semi")
    return out if emitted is None else out.join(emitted.select("rule_id").distinct(), "rule_id", "left_anti")
