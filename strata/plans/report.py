"""Queries of reports, rule catalogues over code text and configuration files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.catalogues.rules import RULES
from strata.operators import reports, rules
from strata.plans.detect import SNIPPETS
from strata.plans.views import VIEWS, view, with_views

QUERIES, SQL = {}, {}


def _query(sql: str, *views: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, with_views(sql, *views) if views else sql
        return f

    return put


def _of(expression: str, names) -> str:
    return f"case {expression} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(names)) + " end"


_REFS = sorted({s[1] for s in SNIPPETS if s[1]})
_TEXTS = sorted({s[2] for s in SNIPPETS if s[2]})
VIEWS["code_text"] = (
    "lineitem",
    f"""select l_orderkey as file, cast(l_linenumber as int) as line_no, case when l_linenumber % 3 = 0 then 'const-string v' || cast(l_suppkey % 4 as varchar(9)) || ', "' || {_of(f"(l_partkey * 3 + l_suppkey) % {len(_TEXTS)}", _TEXTS)} || '"'
        else 'invoke-virtual v0, ' || {_of(f"(l_partkey * 5 + l_suppkey) % {len(_REFS)}", _REFS)} || ' # "' || {_of(f"(l_partkey + l_suppkey * 7) % {len(_TEXTS)}", _TEXTS)} || '"' end as line from lineitem""",
)
_CONFIG_PARTS = (
    ("c_custkey % 4", ("", '<base-config cleartextTrafficPermitted="true"/>', '<base-config cleartextTrafficPermitted="TRUE"><trust-anchors><certificates src="user"/></trust-anchors></base-config>', '<base-config cleartextTrafficPermitted="false"/>')),
    ("c_nationkey % 5", ("", '<domain-config cleartextTrafficPermitted="True"><domain includeSubdomains="true">a.example</domain><domain>b.example</domain></domain-config>', '<domain-config cleartextTrafficPermitted="true"/>', '<domain-config><domain>c.example</domain></domain-config>', '<domain-config cleartextTrafficPermitted="true"><domain>d.example</domain><pin-set expiration="2030-01-01"><pin digest="SHA-256">x</pin></pin-set></domain-config><domain-config><domain>e.example</domain><pin-set expiration="2031-02-03"/></domain-config>')),
    ("c_custkey % 3", ("", '<debug-overrides><trust-anchors><certificates src="user"/><certificates src="system"/></trust-anchors></debug-overrides>', '<debug-overrides/>')),
    ("c_custkey % 11", ("</network-security-config>",) * 10 + ("<broken",)),
)
VIEWS["configs"] = ("customer", "select c_custkey as app_id, '<network-security-config>' || " + " || ".join(_of(e, options) for e, options in _CONFIG_PARTS) + " as xml from customer")


@_query(
    """, n as (select app_id, rule_id, row_number() over (partition by app_id order by rule_id) - 1 as i from (select distinct app_id, rule_id from findings) z)
    select f.app_id, event_id, f.rule_id as "ruleId", cast(i as int) as "ruleIndex", case severity when 'CRITICAL' then 'error' when 'HIGH' then 'error' when 'MEDIUM' then 'warning' when 'LOW' then 'note' when 'INFO' then 'none' else 'warning' end as level,
    replace(replace(class_name, 'L', ''), ';', '') || '.smali' as uri, greatest(line_number, 1) as "startLine" from findings f join n on n.app_id = f.app_id and n.rule_id = f.rule_id""",
    "findings",
)
def report_results(spark: SparkSession, d: str) -> DataFrame:
    return reports.results(view(spark, d, "findings"))


_SINGLE = [r for r in RULES if not r[7] and r[6] == "smali" and r[8]]


@_query(
    "select * from ("
    + " union all ".join(f"select file, line_no, '{r[0]}' as rule_id, '{r[1]}' as severity, cast({float(r[5])} as double) as cvss, 'Line ' || line_no || ': ' || substr(trim(line), 1, 120) as evidence from code_text where regexp_matches(line, $re${r[8]}$re$)" for r in _SINGLE)
    + ") t",
    "code_text",
)
def rule_catalogue_lines(spark: SparkSession, d: str) -> DataFrame:
    return rules.line_matches(view(spark, d, "code_text")).select("file", "line_no", "rule_id", "severity", "cvss", "evidence")


@_query("""select distinct file, value from (select file, regexp_extract(line, 'const-string(?:/jumbo)? [vp]\\d+, "((?:[^"\\\\]|\\\\.)*)"', 1) as value from code_text) t where length(value) >= 4""", "code_text")
def code_text_strings(spark: SparkSession, d: str) -> DataFrame:
    return reports.code_strings(view(spark, d, "code_text"))


@_query(
    r""", whole as (select * from configs where ends_with(xml, '</network-security-config>')), domains as (select app_id, unnest(regexp_extract_all(xml, '<domain-config[^>]*/>|<domain-config.*?</domain-config>')) as d from whole),
    debug as (select app_id, regexp_extract(xml, '<debug-overrides>.*</debug-overrides>') as d from whole)
    select app_id, 'NETWORK_NSC_CLEARTEXT' as rule_id, 'HIGH' as severity, 'base' as detail from whole where lower(regexp_extract(xml, '<base-config[^>]*cleartextTrafficPermitted="([^"]*)"', 1)) = 'true'
    union all select app_id, 'NETWORK_NSC_DOMAIN_CLEARTEXT', 'MEDIUM', coalesce(nullif(array_to_string(regexp_extract_all(d, '<domain( [^>]*)?>([^<]*)</domain>', 2), ', '), ''), '(unspecified)') from domains where lower(regexp_extract(d, '^<domain-config[^>]*cleartextTrafficPermitted="([^"]*)"', 1)) = 'true'
    union all select app_id, 'NETWORK_NSC_USER_CA', 'MEDIUM', 'user' from (select app_id, unnest(regexp_extract_all(d, '<certificates src="user"/>')) from debug) t
    union all select app_id, 'NETWORK_PIN_EXPIRY', 'INFO', unnest(regexp_extract_all(xml, '<pin-set expiration="([^"]+)"', 1)) from whole
    union all select app_id, 'NETWORK_PINNING_MISSING', 'LOW', '' from whole where not contains(xml, '<pin-set')""",
    "configs",
)
def network_config_xml(spark: SparkSession, d: str) -> DataFrame:
    return reports.network_config(view(spark, d, "configs"))
