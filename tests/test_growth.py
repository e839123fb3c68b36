"""Work that a query does once, and no more often as its tables grow."""

from pyspark.sql import functions as F

from strata.functions import text
from strata.operators import manifest, rules, taint
from strata.plans import queries


def shown(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_methods_are_closed_where_they_lie(spark, monkeypatch):
    """no round of joins and checkpoints; a later start that is nearer, a step in no order, a cycle, a lone start."""
    def fail(*_):
        raise AssertionError("a checkpoint")

    monkeypatch.setattr(taint, "keep", fail)
    steps = [(1, 1, 2, "a", "b"), (1, 1, 5, "a", "b"), (1, 1, 4, "b", "c"), (1, 1, None, "c", "a"), (1, 1, 9, "c", "d"), (1, 2, 1, "a", "b")]
    starts = [(1, 1, "s", "a", 3), (1, 1, "s", "a", 2), (1, 1, "t", "b", 1), (1, 3, "s", "a", 7)]
    got = taint.closed(spark.createDataFrame(steps, "app_id long, method long, pos long, read string, write string"), spark.createDataFrame(starts, "app_id long, method long, start string, slot string, since long"))
    want = {(1, 1, "s", "a", 2), (1, 1, "s", "b", 5), (1, 1, "t", "b", 1), (1, 1, "t", "c", 4), (1, 1, "t", "a", 4), (1, 1, "t", "d", 9), (1, 3, "s", "a", 7)}
    assert {tuple(r) for r in got.collect()} == want


def test_methods_are_closed_once_for_static_fields(spark, monkeypatch):
    """a value goes through three fields by methods in no order; a field of another app stays clean."""
    calls, closed = [], taint.closed
    monkeypatch.setattr(taint, "closed", lambda *tables: calls.append(1) or closed(*tables))
    rows = [(1, 9, 1, "source", 0, None, None), (1, 9, 2, "sput", None, 0, "a"), (1, 8, 1, "sget", 0, None, "a"), (1, 8, 2, "sput", None, 0, "b")]
    rows += [(1, 7, 1, "sget", 0, None, "b"), (1, 7, 2, "move", 1, 0, None), (1, 7, 3, "sput", None, 1, "c"), (1, 6, 1, "sput", None, 0, "d"), (1, 6, 2, "sget", 0, None, "c")]
    rows += [(2, 8, 1, "sget", 0, None, "a"), (2, 8, 2, "sput", None, 0, "b")]
    got = taint.static_fields(spark.createDataFrame(rows, "app_id long, method long, pos long, op string, dst int, src int, field string"))
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (1, "b"), (1, "c")} and len(calls) == 1


def test_calls_are_read_once(spark, small, monkeypatch):
    """what goes into the search of calls isn't worked out from the view again in every join."""
    seen, search = [], taint.inter_method
    monkeypatch.setattr(taint, "inter_method", lambda *tables, **more: seen.extend(map(shown, tables)) or search(*tables, **more))
    queries.QUERIES["taint_interproc"](spark, small)
    assert len(seen) == 4 and not any("Window" in plan for plan in seen)


def test_manifests_are_parsed_once(spark, small, monkeypatch):
    """the rules read what the parser has written."""
    seen, every = [], manifest.manifest_rules
    monkeypatch.setattr(manifest, "manifest_rules", lambda rows: seen.append(shown(rows)) or every(rows))
    queries.QUERIES["manifest_xml_rules"](spark, small)
    assert len(seen) == 1 and "from_xml" not in seen[0].lower()


def test_decoders_are_worked_out_once(spark):
    """a decoder stands in the expression once for each place it is used in, not for each test of its result."""
    plan = shown(spark.range(1).select(text.decoded(F.col("id").cast("string"), F.lit("x"))))
    assert plan.count("to_binary") <= 4 and plan.count("unhex") <= 4


def test_words_and_literals_of_patterns(spark):
    """patterns without operators are literals; others are tried where a word of one of their alternatives is."""
    assert rules.literal(r"A\$B;->c\(") == "A$B;->c(" and rules.literal(r"a.b") is None and rules.literal(r"a\d") is None
    assert rules.alternatives(r"a\|b|[|]c|(d|e)") == [r"a\|b", "[|]c", "(d|e)"]
    assert rules.required_words(r"a(b\)cdefg)?xyzw") == "xyzw" and rules.required_words("(?i)abcd") is None and rules.required_words("abcd.*(?i:x)") == "abcd"
    lines = spark.createDataFrame([(1, "Log;->d token"), (2, "x PBKDF2WithHmac"), (3, "app.log"), (4, "A$B;->c()")], "line_no int, line string")
    made = [(f"R{i}", "HIGH", "LOW", "X", "CWE-1", 1.0, "smali", False, p) for i, p in enumerate((r"Log;->\w.*(?i:TOKEN)", "PBKDF2WithHmac|other", r"app\.log|none", r"A\$B;->c\("))]
    assert {(r.line_no, r.rule_id) for r in rules.line_matches(lines, made).collect()} == {(1, "R0"), (2, "R1"), (3, "R2"), (4, "R3")}
