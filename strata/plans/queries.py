"""The catalogue of queries over the general test tables: each operator applied to a view, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.catalogues import android
from strata.catalogues import inventory as kits_
from strata.catalogues import scoring as scores
from strata.functions import text as txt
from strata.operators import code, diff, graph, inventory, plugins, rules, scoring, secrets, taint
from strata.operators.manifest import dangerous, link_rules
from strata.plans import detect, files, flow, report, smali
from strata.plans.keep import keep, small
from strata.plans.views import table, values, view, with_views
from strata.sources.archives import merged
from strata.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with its SQL over the named views."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return put


# ---------------------------------------------------------------- scoring

_LIBRARY = [p for p in scores.LIBRARY_CLASSES if "(?!" not in p]
_IS_LIBRARY = (
    f"(regexp_matches(class_name, '{'|'.join(_LIBRARY)}') or (regexp_matches(class_name, '^Lcom/google/') and not regexp_matches(class_name, '^Lcom/google/android/gms/ads'))"
    " or (regexp_matches(class_name, '^Lcom/google/firebase/') and not regexp_matches(class_name, '^Lcom/google/firebase/(database|firestore|storage)')))"
)
_LOWER = "case {0} when 'HIGH' then 'MEDIUM' when 'MEDIUM' then 'LOW' else {0} end"
_ADJUSTED = f"""adjusted as (
  select * exclude (c1, c2, c3, confidence), confidence as confidence_raw,
    case when rule_id in ({', '.join(f"'{r}'" for r in scores.NEVER_DOWNGRADED)}) then confidence
         when c3 = 'HIGH' and (regexp_matches(class_name, '(?:^|/)(?i:debug)[/$;]') or regexp_matches(class_name, 'BuildConfig(?:\\$|;|$)')) then 'MEDIUM' else c3 end as confidence
  from (select *, case when regexp_matches(class_name, '(?:^|/)(?i:test|mock|stub|fake|espresso|robolectric|junit)[/$]') or regexp_matches(method_name, '(?:^|/)(?i:test|mock|stub|fake|espresso|robolectric|junit)[/$]')
                       then {_LOWER.format('c2')} else c2 end as c3
    from (select *, case when {_IS_LIBRARY} and severity <> 'CRITICAL' then {_LOWER.format('c1')} else c1 end as c2
      from (select *, case when confidence = 'HIGH' and rule_id in ({', '.join(f"'{r}'" for r in scores.NOISY)}) then 'MEDIUM' else confidence end as c1 from findings))))"""
_SEVERITY_RANK = "case severity when 'CRITICAL' then 5 when 'HIGH' then 4 when 'MEDIUM' then 3 when 'LOW' then 2 when 'INFO' then 1 else 0 end"
_CONFIDENCE_RANK = "case confidence when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"
_GRADE = "case when critical > 0 then 'F' when high >= 3 then 'F' when high >= 1 then 'D' when medium >= 5 then 'D' when medium >= 3 then 'C' when medium >= 1 then 'B' else 'A' end"
_COUNTS = ", ".join(f"count(*) filter (severity = '{s}') as {s.lower()}" for s in scoring.SEVERITIES)


@query(f", {_ADJUSTED} select event_id, rule_id, confidence_raw, confidence from adjusted", "findings")
def confidence_adjust(spark: SparkSession, d: str) -> DataFrame:
    return scoring.adjusted_confidence(view(spark, d, "findings")).select("event_id", "rule_id", "confidence_raw", "confidence")


_OWASP = f""", names as (select * from {values(scores.OWASP_NAMES, 'code, name')}), exact as (select * from {values(scores.OWASP_RULES, 'rule_id, code')}),
    prefixes as (select * from {values([(i, *r) for i, r in enumerate(scores.OWASP_PREFIXES)], 'ord, prefix, code')}), cats as (select * from {values(scores.OWASP_BY_CATEGORY, 'category, code')}),
    owasp as (select event_id, f.rule_id, coalesce((select name from names n where n.code = coalesce(e.code,
        (select arg_min(p.code, p.ord) from prefixes p where starts_with(f.rule_id, p.prefix)),
        case when f.rule_id not like 'TAINT_%' then null when regexp_matches(f.rule_id, 'EXEC|COMMAND|WEBVIEW|JS_INJECT|SQL') then 'M4' when regexp_matches(f.rule_id, 'OPEN_REDIRECT|DEEPLINK_REDIRECT|NETWORK') then 'M5'
             when regexp_matches(f.rule_id, 'STORAGE|FILE_WRITE|PREFS') then 'M9' when f.rule_id like '%PENDING_INTENT%' then 'M8' when f.rule_id like '%LOG%' then 'M6' end, c.code)), '') as owasp_category
    from findings f left join exact e on f.rule_id = e.rule_id left join cats c on f.category = c.category)"""


@query(_OWASP + " select * from owasp", "findings")
def owasp_assign(spark: SparkSession, d: str) -> DataFrame:
    return scoring.owasp_category(view(spark, d, "findings")).select("event_id", "rule_id", "owasp_category")


@query(
    f""", flows as (select * from {values(scores.CVSS_FLOWS, 'a, b, v')}), exact as (select * from {values(scores.CVSS_RULES, 'rule_id, v')}), rest as (select * from {values(scores.CVSS_SEVERITIES, 'severity, v')}),
    f as (select *, case when event_id % 5 = 0 then 'INTENT' end as a, case when event_id % 5 = 0 and event_id % 2 = 0 then 'EXEC' when event_id % 5 = 0 then 'NOWHERE' end as b from findings)
    select event_id, coalesce((select v from flows w where w.a = f.a and w.b = f.b), (select v from exact e where e.rule_id = f.rule_id),
        (select arg_max(v, length(e.rule_id)) from exact e where starts_with(f.rule_id, e.rule_id)), (select v from rest r where r.severity = f.severity)) as cvss_vector from f""",
    "findings",
)
def cvss_assign(spark: SparkSession, d: str) -> DataFrame:
    mark = F.col("event_id") % 5 == 0
    rows = view(spark, d, "findings").withColumns({"taint_source": F.when(mark, "INTENT"), "taint_sink": F.when(mark & (F.col("event_id") % 2 == 0), "EXEC").when(mark, "NOWHERE")})
    return scoring.cvss_vector(rows).select("event_id", "cvss_vector")


@query(
    f""", exact as (select * from {values([r for r in scores.PROFILE_RULES if r[0] != 'R'], 'p, rule_id')}), prefixes as (select * from {values([r for r in scores.PROFILE_PREFIXES if r[0] != 'R'], 'p, prefix')})
    select event_id, rule_id from findings f where rule_id in (select rule_id from exact) or exists (select 1 from prefixes p where starts_with(f.rule_id, p.prefix))""",
    "findings",
)
def masvs_filter(spark: SparkSession, d: str) -> DataFrame:
    return scoring.in_profile(view(spark, d, "findings"), "L2").select("event_id", "rule_id")


@query(f"select event_id, severity, confidence from findings where {_SEVERITY_RANK} >= 3 and {_CONFIDENCE_RANK} >= 2", "findings")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    return scoring.at_least(view(spark, d, "findings"), "MEDIUM", "MEDIUM").select("event_id", "severity", "confidence")


@query(
    f"""select * from (select event_id, severity, confidence, rule_id, class_name, method_name, line_number, evidence, cast({_SEVERITY_RANK} as int) as severity_rank, cast({_CONFIDENCE_RANK} as int) as confidence_rank from findings) t
    order by severity_rank desc, confidence_rank desc, rule_id, class_name, method_name, line_number, evidence limit 50""",
    "findings",
)
def finding_order_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "findings").select("event_id", "severity", "confidence", "rule_id", "class_name", "method_name", "line_number", "evidence")
    ranked = rows.withColumns({"severity_rank": scoring.severity_rank(F.col("severity")), "confidence_rank": scoring.confidence_rank(F.col("confidence"))})
    return ranked.orderBy(*scoring.finding_order(ranked)).limit(50)


_SUMMARY = f"select app_id, count(*) as total, {_COUNTS}, " + ", ".join(f"count(*) filter (confidence = '{c}') as confidence_{c.lower()}" for c in scoring.CONFIDENCES) + " from findings group by app_id"


@query(f"select *, {_GRADE} as risk_grade from ({_SUMMARY}) t", "findings")
def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.summary(view(spark, d, "findings"))


@query(f"select app_id, {_GRADE} as risk_grade from (select app_id, {_COUNTS} from findings group by app_id) t", "findings")
def risk_grade(spark: SparkSession, d: str) -> DataFrame:
    return scoring.summary(view(spark, d, "findings")).select("app_id", "risk_grade")


_GROUPS = "select severity, category, class_name, count(*) as n, cast(grouping(severity) as int) as g_severity, cast(grouping(category) as int) as g_category, cast(grouping(class_name) as int) as g_class from findings group by {}"


def _grouped(spark: SparkSession, d: str, by: str) -> DataFrame:
    return spark.sql(_GROUPS.format(by).replace("from findings", "from {findings}"), findings=view(spark, d, "findings"))


@query(_GROUPS.format("grouping sets ((severity), (category), (class_name), ())"), "findings")
def summary_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, "grouping sets ((severity), (category), (class_name), ())")


@query(_GROUPS.format("cube (severity, category, class_name)"), "findings")
def summary_cube(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, "cube (severity, category, class_name)")


@query(_GROUPS.format("rollup (severity, category, class_name)"), "findings")
def summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, "rollup (severity, category, class_name)")


@query(
    f""", parts as (select * from {values([(n, w, t, i, p, c, len(cs)) for n, w, t, cs in scores.BEHAVIOURS for i, (p, c) in enumerate(cs)], 'name, weight, tactic, slot, part, wants, slots')}),
    met as (select app_id, name, weight, tactic, slots, slot, min(rule_id) as rule_id from findings join parts on (part = '' or contains(rule_id, part)) and (wants = '' or wants = category) group by all)
    select app_id, name, weight, case when weight >= 16 then 'CRITICAL' when weight >= 8 then 'HIGH' when weight >= 4 then 'MEDIUM' when weight >= 1 then 'LOW' else 'INFO' end as severity, tactic,
        string_agg(rule_id, ',' order by slot) as contributing from met group by app_id, name, weight, tactic, slots having count(*) = slots""",
    "findings",
)
def behavior_division(spark: SparkSession, d: str) -> DataFrame:
    return scoring.behaviours(view(spark, d, "findings")).withColumn("contributing", F.concat_ws(",", "contributing_rule_ids")).drop("contributing_rule_ids")


@query(f"select app_id, max({_SEVERITY_RANK}) >= 5 as failed from findings group by app_id", "findings")
def gate_exit(spark: SparkSession, d: str) -> DataFrame:
    return scoring.gate(view(spark, d, "findings"), "CRITICAL")


@query(
    """select event_type as status, count(*) as scans, count(distinct user_id) as apps, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total, max(event_id) as last_scan
    from events group by event_type"""
)
def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return rows.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("scans"), F.countDistinct("user_id").alias("apps"), F.sum("k").alias("total"), F.max("event_id").alias("last_scan"))


@query("select event_id, event_type as status, ts from events where event_type = 'error' order by ts desc, event_id limit 8")
def scan_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("event_type").alias("status"), "ts")
    return rows.orderBy(F.desc("ts"), "event_id").limit(8)


@query(_OWASP + " select app_id, owasp_category, count(*) as n from findings join owasp using (event_id) where owasp_category <> '' group by app_id, owasp_category", "findings")
def owasp_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.owasp_category(view(spark, d, "findings")).where("owasp_category <> ''")
    return rows.groupBy("app_id", "owasp_category").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- comparing reports

_FINGERPRINT = "sha1(rule_id || '|' || class_name || '|' || method_name || '|' || trim(regexp_replace(regexp_replace(evidence, '@offset \\d+', '@offset N', 'g'), '0x[0-9a-fA-F]+', '0xN', 'g')))"


@query(f"select event_id, {_FINGERPRINT} as fingerprint from findings", "findings")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return diff.fingerprinted(view(spark, d, "findings")).select("event_id", "fingerprint")


@query(
    f", f as (select *, {_FINGERPRINT} as fingerprint from findings), base as (select distinct fingerprint from f where event_id % 3 = 0) select event_id, fingerprint, case when fingerprint in (select fingerprint from base) then 'known' else 'new' end as baseline_status from f",
    "findings",
)
def baseline_split(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "findings")
    base = diff.fingerprinted(rows.where("event_id % 3 = 0")).select("fingerprint")
    return diff.baseline_split(rows, base).select("event_id", "fingerprint", "baseline_status")


_SIDE = "select * from (select *, row_number() over (partition by app_id, rule_id, class_name, method_name, category order by event_id desc) as rn from findings where event_id % 2 = {}) t where rn = 1"


@query(
    f""", a as ({_SIDE.format(0)}), b as ({_SIDE.format(1)})
    select app_id, rule_id, class_name, method_name, category, case when a.event_id is null then 'NEW' when b.event_id is null then 'FIXED' when a.severity = b.severity and a.confidence = b.confidence then 'UNCHANGED' else 'CHANGED' end as status,
        a.severity as old_severity, b.severity as new_severity, a.confidence as old_confidence, b.confidence as new_confidence
    from a full outer join b using (app_id, rule_id, class_name, method_name, category)""",
    "findings",
)
def report_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "findings")
    return diff.report_diff(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), [F.desc("event_id")])


@query(
    "select class_name, string_agg(distinct rule_id, ',' order by rule_id) filter (rule_id not like 'TAINT%') as rules from findings group by class_name",
    "findings",
)
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    rules_of = view(spark, d, "findings").groupBy("class_name").agg(F.collect_set("rule_id").alias("r"), F.collect_set(F.when(F.col("rule_id").startswith("TAINT"), F.col("rule_id"))).alias("t"))
    return rules_of.select("class_name", F.concat_ws(",", F.sort_array(F.array_except("r", "t"))).alias("rules"))


# ---------------------------------------------------------------- text

#: Rules in the form that operators.rules takes, for prose instead of code.
PROSE_RULES = (
    ("TEXT_LICENSE", "LOW", "HIGH", "LEGAL", "CWE-1104", 2.0, "smali", False, r"[Ll]icen[cs]e"),
    ("TEXT_TOKEN", "HIGH", "HIGH", "SECRETS", "CWE-798", 7.5, "smali", False, r"token = \"[0-9a-f]{40}\""),
    ("TEXT_MAIL", "MEDIUM", "MEDIUM", "PRIVACY", "CWE-359", 5.0, "smali", False, r"[a-z.0-9]+@[a-z0-9.]+\.com"),
    ("TEXT_ADDRESS", "MEDIUM", "LOW", "PRIVACY", "CWE-200", 4.0, "smali", False, r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("TEXT_RIGHTS", "INFO", "HIGH", "LEGAL", "", 0.0, "smali", False, r"^All rights reserved"),
    ("TEXT_SHOUT", "LOW", "LOW", "STYLE", "", 0.0, "smali", True, r"!![ \n].*?!!\n"),
    ("TEXT_PIPES", "LOW", "MEDIUM", "STYLE", "", 0.0, "smali", True, r"\| [^|]{1,40}\n"),
)
_LINES = "lines as (select doc_id as file, cast(line_no as int) as line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents) t)"
_PROSE = values([r[:6] + (r[7], r[8]) for r in PROSE_RULES], "rule_id, severity, confidence, category, cwe_id, cvss, multiline, pattern")


def code_lines(spark: SparkSession, d: str) -> DataFrame:
    """documents as (file, line_no, line)."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


@query(f"with {_LINES} select file, line_no, rule_id, severity, cast(cvss as double) as cvss, 'Line ' || line_no || ': ' || substr(trim(line), 1, 120) as evidence from lines join {_PROSE} on not multiline and regexp_matches(line, pattern)")
def rule_line_match(spark: SparkSession, d: str) -> DataFrame:
    return rules.line_matches(code_lines(spark, d), PROSE_RULES).select("file", "line_no", "rule_id", "severity", "cvss", "evidence")


@query(
    f"""with hits as (select doc_id as file, rule_id, text, regexp_extract(text, '(?sm)' || pattern) as found from documents join {_PROSE} on multiline and regexp_matches(text, '(?sm)' || pattern))
    select file, rule_id, cast(length(substr(text, 1, strpos(text, found) - 1)) - length(replace(substr(text, 1, strpos(text, found) - 1), chr(10), '')) + 1 as int) as line_no from hits"""
)
def rule_multiline_match(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    return rules.file_matches(files, PROSE_RULES).select("file", "rule_id", "line_no")


@query(f"with {_LINES}, hits as (select file, line_no, rule_id from lines join {_PROSE} on not multiline and regexp_matches(line, pattern)) select * from hits where rule_id not in (select rule_id from hits where file % 50 = 0)")
def rule_suppression_anti(spark: SparkSession, d: str) -> DataFrame:
    hits = rules.line_matches(code_lines(spark, d), PROSE_RULES).select("file", "line_no", "rule_id")
    return rules.gated(hits.withColumn("class_name", F.lit("")), emitted=hits.where("file % 50 = 0")).drop("class_name")


@query(f"with {_LINES}, w as (select *, lag(line, 2) over o as before_2, lag(line) over o as before_1, lead(line) over o as after_1, lead(line, 2) over o as after_2 from lines window o as (partition by file order by line_no)) select * from w where regexp_matches(line, '[Ll]icen[cs]e')")
def invocation_context(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("file").orderBy("line_no")
    near = {"before_2": F.lag("line", 2), "before_1": F.lag("line"), "after_1": F.lead("line"), "after_2": F.lead("line", 2)}
    return code_lines(spark, d).withColumns({k: v.over(order) for k, v in near.items()}).where(F.col("line").rlike("[Ll]icen[cs]e"))


@query("select method, dst, num from (select *, row_number() over (partition by method, dst order by pos desc) as rn from instructions where op = 3) t where rn = 1", "instructions")
def string_pool_last_write(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "instructions").where("op = 3").groupBy("method", "dst").agg(F.max_by("num", "pos").alias("num"))


def _entropy_sql(column: str) -> str:
    letters = f"list_distinct(string_split({column}, ''))"
    share = f"((length({column}) - length(replace({column}, c, ''))) / length({column})::double)"
    return f"round(coalesce(list_sum(list_transform(list_filter({letters}, lambda c: c <> ''), lambda c: -{share} * log2{share})), 0.0), 6)"


_TOKENS = """matched as (select doc_id as app_id, regexp_extract(text, '(?i)(?:api_?key|secret|token|passwd|password) ?[=:] ?"([0-9A-Za-z_\\-]{16,})"', 1) as matched from documents)"""


@query(f"with {_TOKENS} select app_id, 'SECRET_GENERIC_API_KEY' as rule_id, matched, {_entropy_sql('matched')} as entropy from matched where matched <> '' and {_entropy_sql('matched')} >= 3.0")
def secret_patterns(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secrets(view(spark, d, "strings")).select("app_id", "rule_id", "matched", "entropy")


@query(f"select p_partkey, {_entropy_sql('p_name')} as entropy, {_entropy_sql('p_type')} as type_entropy from part")
def secret_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", *(F.round(txt.entropy(F.col(c)), 6).alias(a) for c, a in (("p_name", "entropy"), ("p_type", "type_entropy"))))


@query("select p_partkey, p_name as from_hex, p_type as from_base64 from part where length(p_name) >= 3 and length(p_type) >= 6")
def deobf_hex_b64(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").where("length(p_name) >= 3 and length(p_type) >= 6")
    coded = rows.select("p_partkey", F.lower(F.hex("p_name")).alias("h"), F.regexp_replace(F.base64(F.col("p_type").cast("binary")), "=+$", "").alias("b"))
    return coded.select("p_partkey", txt.from_hex(F.col("h")).alias("from_hex"), txt.from_base64(F.col("b")).alias("from_base64"))


@query("select p_partkey, reverse(p_name) as reversed, translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') as rot13 from part")
def deobf_rot13_reverse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.reverse("p_name").alias("reversed"), txt.rotated(F.col("p_type")).alias("rot13"))


@query()
def deobf_xor_search(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "part").select("p_partkey", F.hex(F.replace("p_name", F.lit(" "), F.lit(""))).alias("h"))
    return coded.repartition("p_partkey").select("p_partkey", txt.xor_decoded(F.col("h")).alias("x")).select("p_partkey", "x.key", "x.text")


_PRIVATE = "(?i)http://(?:127\\.|10\\.|192\\.168\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.|localhost|0\\.0\\.0\\.0)"
_URL = r"http://[a-zA-Z0-9._~:/?#\[\]@!$&'()*+,;=%-]+"


@query(f"select page_id, url from (select page_id, unnest(regexp_extract_all(html, $re${_URL}$re$)) as url from resources) t where not regexp_matches(url, '{_PRIVATE}')", "resources")
def resource_html_http(spark: SparkSession, d: str) -> DataFrame:
    urls = view(spark, d, "resources").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_URL), 0)).alias("url"))
    return urls.where(~F.col("url").rlike(_PRIVATE))


@query(f"select page_id, url from pages where regexp_matches(url, '(?i)\\bhttp://') and not regexp_matches(url, '{_PRIVATE}')")
def cleartext_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("url").rlike(r"(?i)\bhttp://") & ~F.col("url").rlike(_PRIVATE)).select("page_id", "url")


@query("select doc_id from key_files where regexp_matches(text, '-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |)PRIVATE KEY-----')", "key_files")
def private_key_scan(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "key_files").where(F.col("text").rlike("-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED |)PRIVATE KEY-----")).select("doc_id")


# ---------------------------------------------------------------- manifests and inventory


@query(
    """select page_id, rule_id from (select page_id, unnest(list_filter([case when scheme = 'http' then 'DEEPLINK_HTTP_SCHEME' end, case when scheme in ('http', 'https') and not auto_verify then 'DEEPLINK_NO_AUTO_VERIFY' end,
        case when host like '*%' then 'DEEPLINK_WILDCARD_HOST' end, case when scheme in ('http', 'https') and not has_path then 'DEEPLINK_NO_PATH_CONSTRAINT' end], lambda x: x is not null)) as rule_id from links) t""",
    "links",
)
def deeplink_checks(spark: SparkSession, d: str) -> DataFrame:
    return link_rules(view(spark, d, "links")).select("page_id", "rule_id")


@query("select component, string_agg(distinct scheme, ',' order by scheme) as schemes from links group by component having count(distinct scheme) > 1", "links")
def deeplink_mixed_schemes(spark: SparkSession, d: str) -> DataFrame:
    sets = view(spark, d, "links").groupBy("component").agg(F.collect_set("scheme").alias("s"))
    return sets.where(F.size("s") > 1).select("component", F.concat_ws(",", F.sort_array("s")).alias("schemes"))


@query(
    f"select app_id, permission, coalesce(data, 'none') as data from (select distinct app_id, unnest([permission_a, permission_b]) as permission from manifests) t left join {values(android.DATA_SAFETY, 'p, data').replace(' as t(', ' as s(')} on permission = p where permission in ({', '.join(repr(p) for p in android.DANGEROUS_PERMISSIONS)})",
    "manifests",
)
def permission_intersection(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "manifests").select("app_id", F.array("permission_a", "permission_b").alias("permissions"))
    return dangerous(rows).select("app_id", "permission", F.coalesce("data", F.lit("none")).alias("data"))


@query(
    f""", s as (select * from {values([(*r, i) for i, r in enumerate(kits_.SDKS)], 'name, prefix, category, risk, cwe_id, ord')})
    select distinct app_id, name, prefix, category, risk, cwe_id from (select app_id, class_name, s.*, row_number() over (partition by app_id, class_name order by ord) as rn from (select distinct * from app_classes) c join s on starts_with(class_name, prefix)) t where rn = 1""",
    "app_classes",
)
def sdk_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    return inventory.kits(view(spark, d, "app_classes"))


@query(
    f""", s as (select * from {values([(*r, i) for i, r in enumerate(kits_.TRACKERS)], 'name, prefix, category, ord')})
    select distinct app_id, 'TRACKER_' || category || '_' || trim(substr(regexp_replace(regexp_replace(upper(name), '[ _.-]', '_', 'g'), '[^\\p{{L}}\\p{{N}}_]', '', 'g'), 1, 40), '_') as rule_id, name, prefix, category
    from (select app_id, class_name, s.*, row_number() over (partition by app_id, class_name order by length(prefix) desc, ord) as rn from (select distinct * from app_classes) c join s on starts_with(class_name, prefix)) t where rn = 1""",
    "app_classes",
)
def tracker_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return inventory.trackers(view(spark, d, "app_classes"))


_SBOM = f"""libs as (select * from {values(kits_.LIBRARIES, 'library, template, prefix')}), found as (select distinct app_id, library, template from app_classes join libs on starts_with(class_name, prefix)),
    best as (select app_id, library, template, arg_min(version, (case when lower(library) = name then 0 else 1 end) || name || version) as v from found join mined_versions using (app_id)
        where lower(library) = name or contains(name, regexp_replace(lower(library), 'androidx-|kotlinx-', '', 'g')) group by all),
    parts as (select app_id, library as name, replace(template, '{{version}}', coalesce(v, 'unknown')) as purl, coalesce(v, 'unknown') as version from found left join best using (app_id, library, template))"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    mined = view(spark, d, "mined_versions").groupBy("app_id", "name").agg(F.min("version").alias("version"))
    return inventory.components(view(spark, d, "app_classes"), mined)


@query(f", {_SBOM} select * from parts", "app_classes", "mined_versions")
def sbom_components(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)


@query(
    f""", {_SBOM}, cves as (select * from {values(kits_.CVES, 'package, fixed, cve, cvss')})
    select app_id, name, purl, version, cve, fixed, cast(cvss as double) as cvss, case when cvss >= 9 then 'CRITICAL' when cvss >= 7 then 'HIGH' when cvss >= 4 then 'MEDIUM' else 'LOW' end as severity
    from parts join cves on split_part(purl, '@', 1) || '@' = package where version <> 'unknown' and list_transform(regexp_extract_all(version, '\\d+'), lambda x: x::bigint) < list_transform(regexp_extract_all(fixed, '\\d+'), lambda x: x::bigint)""",
    "app_classes", "mined_versions",
)
def cve_version_range(spark: SparkSession, d: str) -> DataFrame:
    return inventory.vulnerable(_parts(spark, d)).select("app_id", "name", "purl", "version", "cve", "fixed", "cvss", "severity")


@query(
    """select name, size, split from (select p_name as name, p_size as size, p_partkey as split, row_number() over (partition by p_name order by case when p_brand = 'Brand#13' then 0 else 1 end, p_size desc, p_partkey) as rn from part) t where rn = 1"""
)
def first_wins_merge(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_partkey").alias("split"), (F.col("p_brand") == "Brand#13").alias("is_base"))
    return merged(files).select("name", "size", "split")


# ---------------------------------------------------------------- graphs

_REACH = "reach(node) as (select distinct src from calls where src not in (select dst from calls) union select dst from reach join calls on node = src)"


@query("select distinct src as node from calls where src not in (select dst from calls)", "calls")
def entry_roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.roots(view(spark, d, "calls"))


@query(f", {_REACH} select node from reach", "calls")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    calls = view(spark, d, "calls")
    return graph.reachable(graph.roots(calls), calls).select("node")


@query(f", {_REACH} select node from (select src as node from calls union select dst from calls) t where node not in (select node from reach)", "calls")
def dead_methods(spark: SparkSession, d: str) -> DataFrame:
    calls = view(spark, d, "calls")
    live = graph.reachable(graph.roots(calls), calls)
    return calls.select(F.col("src").alias("node")).union(calls.select("dst")).distinct().join(live, "node", "left_anti")


@query(", walk(node, level) as (select min(src), 0 from calls where src not in (select dst from calls) union select dst, level + 1 from walk join calls on node = src where level < 60) select node, cast(min(level) as int) as level from walk group by node", "calls")
def shortest_call_path(spark: SparkSession, d: str) -> DataFrame:
    calls = view(spark, d, "calls")
    start = graph.roots(calls).agg(F.min("node").alias("node")).where("node is not null")
    return graph.shortest_paths(start, calls).select("node", "level")


@query(", pairs(a, b) as (select distinct src, dst from calls union select a, dst from pairs join calls on b = src) select a as node, max(b) as component from pairs p where a <> b and exists (select 1 from pairs q where q.a = p.b and q.b = p.a) group by a".replace("max(b)", "greatest(a, max(b))"), "calls")
def scc_groups(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(view(spark, d, "calls"))


_CLASS_EDGES = "links as (select r_name as src, n_name as dst from nation join region on n_regionkey = r_regionkey union all select n_name, c_name from customer join nation on c_nationkey = n_nationkey)"


def _class_links(spark: SparkSession, d: str) -> DataFrame:
    nation, region, customer = (table(spark, d, t) for t in ("nation", "region", "customer"))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return up.union(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_name"))


@query(f"with recursive {_CLASS_EDGES}, below(root, node, level) as (select r_name, r_name, 0 from region union select root, dst, level + 1 from below join links on node = src) select root, node, cast(level as int) as level from below")
def class_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(table(spark, d, "region").select(F.col("r_name").alias("node")), _class_links(spark, d)).select("root", "node", "level")


@query(
    f"""with recursive {_CLASS_EDGES}, below(root, node, level) as (select r_name, r_name, 0 from region union select root, dst, level + 1 from below join links on node = src), defs as (select distinct c_name as node, c_mktsegment as method_name from customer)
    select receiver, method_name, target from (select root as receiver, method_name, node as target, row_number() over (partition by root, method_name order by level, node) as n from below join defs using (node) where level > 0) t where n <= 4"""
)
def cha_dispatch(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    segments = keep(customer.select(F.col("c_mktsegment").alias("method_name")).distinct())
    asks = table(spark, d, "region").select(F.col("r_name").alias("receiver")).join(small(segments))  # five regions by five segments
    return graph.dispatch(asks, _class_links(spark, d), customer.select(F.col("c_name").alias("class_name"), F.col("c_mktsegment").alias("method_name")))


# ---------------------------------------------------------------- code


@query("select method, pos, cast(sum(case when pos > 1 and op in (1, 7) then 1 else 0 end) over (partition by method order by pos) as int) as block from instructions", "instructions")
def basic_blocks(spark: SparkSession, d: str) -> DataFrame:
    return code.basic_blocks(view(spark, d, "instructions"), F.col("op").isin(1, 7)).select("method", "pos", "block")


@query(
    """select method, pos, src, (select arg_max(b.num, b.pos) from instructions b where b.method = a.method and b.op = 3 and b.dst = a.src and b.pos < a.pos) as defined from instructions a where op = 1""",
    "instructions",
)
def asof_last_def(spark: SparkSession, d: str) -> DataFrame:
    found = code.last_definition(view(spark, d, "instructions"), F.col("num"), F.col("op") == 3, "dst", "src")
    return found.where("op = 1").select("method", "pos", "src", "defined")


@query("select method, pos, num from (select *, bool_or(op = 5) over (partition by method) as flagged from instructions) t where op = 1 and not flagged", "instructions")
def method_flag_suppression(spark: SparkSession, d: str) -> DataFrame:
    flagged = code.method_flag(view(spark, d, "instructions"), F.col("op") == 5, "flagged")
    return flagged.where("op = 1 and not flagged").select("method", "pos", "num")


@query("select method, count(*) as n from instructions group by method having not bool_or(op = 2) and bool_or(op = 1)", "instructions")
def trustmanager_stub(spark: SparkSession, d: str) -> DataFrame:
    grouped = view(spark, d, "instructions").groupBy("method").agg(F.count("*").alias("n"), F.bool_or(F.col("op") == 2).alias("throws"), F.bool_or(F.col("op") == 1).alias("checks"))
    return grouped.where("not throws and checks").select("method", "n")


@query("select method, pos from (select *, min(pos) filter (op in (6, 7)) over (partition by method) as stop from instructions) t where op <> 3 and (stop is null or pos <= stop)", "instructions")
def stop_at_first(spark: SparkSession, d: str) -> DataFrame:
    return code.up_to_first(view(spark, d, "instructions"), F.col("op").isin(6, 7)).where("op <> 3").select("method", "pos")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return code.basic_blocks(view(spark, d, "instructions"), F.col("op").isin(1, 7))


@query()
def const_propagation(spark: SparkSession, d: str) -> DataFrame:
    rows = _blocks(spark, d)
    edges = code.block_edges(rows, F.col("op") == 7)
    own = rows.where("op in (0, 3)").groupBy("method", "block", F.col("dst").alias("register")).agg(F.max_by(F.struct(F.col("num").alias("value"), (F.col("op") == 3).alias("known")), "pos").alias("z"))
    return code.constants(own.select("method", "block", "register", "z.value", "z.known"), edges)


@query(
    """, t(method, register, since) as (select method, dst, min(pos) from instructions where op = 0 group by method, dst union select i.method, i.dst, i.pos from t join instructions i on i.method = t.method and i.src = t.register and i.pos > t.since and i.op >= 4 and i.src <> i.dst)
    select distinct i.method, i.pos, i.src as register from instructions i join t on i.method = t.method and i.src = t.register and i.pos > t.since where i.op = 1""",
    "instructions",
)
def taint_intra(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "instructions").withColumn("op", F.when(F.col("op") == 0, "source").when(F.col("op") == 1, "sink").when(F.col("op") >= 4, "move").otherwise("other"))
    return taint.intra_method(rows)


_COVERS = (("0", "WEBVIEW"), ("0", "LOG"), ("1", "NETWORK_OUT"), ("2", "SQL_INJECT"), ("3", "LOG"))
_SINK = "case num % 4 when 0 then 'WEBVIEW' when 1 then 'LOG' when 2 then 'NETWORK_OUT' else 'SQL_INJECT' end"


@query(
    f""", s as (select method, pos, {_SINK} as sink_label from instructions where op = 1), cleaned as (select s.method, s.pos, s.sink_label, cast(i.kind as varchar) as sanitizer from s join instructions i on i.method = s.method and i.op = 2 and i.pos < s.pos)
    select s.method, s.pos, s.sink_label, case when exists (select 1 from cleaned c join {values(_COVERS, 'sanitizer, label').replace(' as t(', ' as v(')} on c.sanitizer = v.sanitizer and c.sink_label = v.label where c.method = s.method and c.pos = s.pos) then 'full'
        when exists (select 1 from cleaned c where c.method = s.method and c.pos = s.pos) then 'partial' else 'none' end as neutralisation from s""",
    "instructions",
)
def taint_tristate(spark: SparkSession, d: str) -> DataFrame:
    before = Window.partitionBy("method").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = view(spark, d, "instructions").withColumn("sanitizers", F.coalesce(F.collect_set(F.when(F.col("op") == 2, F.col("kind").cast("string"))).over(before), F.array()))
    flows = rows.where("op = 1").withColumn("sink_label", F.expr(_SINK)).withColumn("flow_id", F.struct("method", "pos"))
    covers = F.broadcast(spark.createDataFrame(_COVERS, "sanitizer string, sink_label string"))
    return taint.sanitised_state(flows, covers).select("method", "pos", "sink_label", "neutralisation")


@query(
    """, chain as (select src as caller, dst as callee from calls), up(src_method, method, n) as (select distinct src, src, 0 from calls where src % 7 = 0 union select src_method, callee, n + 1 from up join chain on method = caller where n < 6)
    select src_method as method, method as sink_method, cast(min(n) as int) as chain from up where method % 5 = 0 group by all""",
    "calls",
)
def taint_interproc(spark: SparkSession, d: str) -> DataFrame:
    edges = keep(view(spark, d, "calls").select(F.lit(0).alias("app_id"), F.col("src").cast("string").alias("method"), F.col("dst").cast("string").alias("callee")))
    nodes = keep(edges.select("app_id", "method").union(edges.select("app_id", "callee")).distinct())
    steps = nodes.select("app_id", "method", F.lit(1).cast("long").alias("pos"), F.lit("p0").alias("read"), F.lit("v0").alias("write"))
    calls = edges.select("app_id", "method", F.lit(3).cast("long").alias("pos"), "callee", F.array(F.lit("v0")).alias("args"), F.lit(None).cast("string").alias("result"))
    mine = edges.where("cast(method as long) % 7 = 0").select("app_id", "method").distinct()
    seeds = mine.select("app_id", "method", F.lit(2).cast("long").alias("pos"), F.lit("v0").alias("slot"), F.lit("INTENT").alias("label"), F.col("method").alias("source"))
    sinks = nodes.where("cast(method as long) % 5 = 0").select("app_id", "method", F.lit(4).cast("long").alias("pos"), F.lit("v0").alias("slot"), F.lit("EXEC").alias("label"))
    found = taint.inter_method(steps, calls, seeds, sinks, depth=6)
    return found.select(F.col("method").cast("long"), F.col("sink_method").cast("long"), "chain")


@query(
    "select app_id, rule_id, class_name, method_name, line_number, event_id from (select *, row_number() over (partition by app_id, rule_id, class_name, method_name, line_number order by length(evidence), event_id) as rn from findings where rule_id like 'TAINT%') t where rn = 1",
    "findings",
)
def taint_dedup(spark: SparkSession, d: str) -> DataFrame:
    flows = view(spark, d, "findings").where("rule_id like 'TAINT%'").select("app_id", "rule_id", "class_name", "method_name", F.col("line_number").alias("sink_pos"), F.length("evidence").alias("chain"), F.col("event_id").alias("source"))
    return taint.first_flows(flows).select("app_id", "rule_id", "class_name", "method_name", F.col("sink_pos").alias("line_number"), F.col("source").alias("event_id"))


_NATIVES = (("*", "click", "A"), ("u1", "*", "B"), ("u1", "click", "C"), ("*", "*", "D"), ("u2", "view", "E"))


@query(f"select event_id, effect from (select event_id, 'u' || (user_id % 4) as c, event_type as m from events) e join {values(_NATIVES, 'class, name, effect')} on (class = '*' or class = c) and (name = '*' or name = m)")
def taint_native(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select("event_id", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("class_name"), F.col("event_type").alias("method_name"))
    return taint.native_effects(calls, F.broadcast(spark.createDataFrame(_NATIVES, "class string, name string, effect string"))).select("event_id", "effect")


# ---------------------------------------------------------------- events


@query("select user_id, event_id, cast(count(*) over (partition by user_id order by epoch(ts) range between 60 preceding and current row) as bigint) as in_minute, count(*) over (partition by user_id order by epoch(ts) range between 60 preceding and current row) > 10 as limited from events")
def rate_limit_sliding(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    order = Window.partitionBy("user_id").orderBy("_s").rangeBetween(-60, 0)
    rows = table(spark, d, "events").withColumn("_s", seconds).withColumn("in_minute", F.count("*").over(order))
    return rows.select("user_id", "event_id", "in_minute", (F.col("in_minute") > 10).alias("limited"))


@query("select cast(epoch(time_bucket(interval '1 hour', ts)) as bigint) as start, event_type, count(*) as n from events group by all")
def event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(table(spark, d, "events"), "1 hour").select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("select s as start, event_type, count(*) as n from (select event_type, unnest([cast(floor(epoch(ts) / 1800) as bigint) * 1800, cast(floor(epoch(ts) / 1800) as bigint) * 1800 - 1800]) as s from events) t group by all")
def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(table(spark, d, "events"), "1 hour", "30 minutes").select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query(
    """select user_id, cast(floor(epoch(min(ts))) as bigint) as start, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from
    (select *, case when epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) < 86400 then 0 else 1 end as new from events) a) b group by user_id, s"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(table(spark, d, "events"), "1 day").select("user_id", F.unix_seconds("start").alias("start"), "n")


@query("select user_id, event_type, count(*) as n from events group by user_id, event_type")
def stream_incremental(spark: SparkSession, d: str) -> DataFrame:
    return events.incremental_counts(spark, f"{d}/events.parquet")


@query()
def plugin_udtf(spark: SparkSession, d: str) -> DataFrame:
    return plugins.run(plugins.example_registry(), view(spark, d, "instructions"))


@query()
def approx_rule_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "findings").groupBy("rule_id").agg(F.approx_count_distinct("app_id").alias("apps"), F.percentile_approx("line_number", 0.5, 1000).alias("middle_line"))


# ---------------------------------------------------------------- detectors, flows and edges

QUERIES |= detect.QUERIES | flow.QUERIES | report.QUERIES | smali.QUERIES | files.QUERIES
SQL |= detect.SQL | flow.SQL | report.SQL | smali.SQL | files.SQL
