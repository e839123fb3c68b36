"""Queries of call edges, entry points, reflection, flow findings and manifests over views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.catalogues import android
from strata.catalogues import flows as labels
from strata.catalogues import taint as values
from strata.functions import text as txt
from strata.operators import code, graph, manifest, taint
from strata.plans.views import VIEWS, view, with_views

QUERIES, SQL = {}, {}


def _query(sql: str, *views: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, with_views(sql, *views) if views else sql
        return f

    return put


def _of(expression: str, names) -> str:
    return f"case {expression} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(names)) + " end"


def _list(names) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in names)


def _starts(column: str, prefixes) -> str:
    return "(" + " or ".join(f"starts_with({column}, '{p}')" for p in prefixes) + ")"


_ORDER = "order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax"
_SOURCES = ("DEVICE_ID", "LOCATION", "USER_INPUT", "INTENT", "SHARED_PREFS", "DEEP_LINK_DATA", "CONTENT_URI", "CLIPBOARD", "CAMERA_MIC")
_SINKS = ("LOG", "NETWORK_OUT", "EXEC", "SQL_INJECT", "WEBVIEW", "STORAGE", "FILE_WRITE", "OPEN_REDIRECT", "PENDING_INTENT", "WEBVIEW_JS_INJECT", "CRYPTO_SINK")
_SPECS = [(c, m) for c, m, *_ in values.SOURCES + values.SINKS + values.SANITIZERS] + [("Lcom/app/Own;", "run"), ("Lcom/google/common/hash/Hashing;", "murmur")]
_CLASSES = ("Lcom/app/Main;", "Landroidx/core/A;", "Lkotlin/B;", "Lcom/google/android/gms/C;", "Ljava/lang/String;", "Lcom/app/net/D;", "Lkotlinx/coroutines/E;", "Lokhttp3/F;")

VIEWS["label_flows"] = (
    "events",
    f"select event_id, {_of(f'(event_id * 3 + user_id) % {len(_SOURCES)}', _SOURCES)} as source_label, {_of(f'(event_id + user_id * 5) % {len(_SINKS)}', _SINKS)} as sink_label, cast(event_id % 12 as int) as chain, case event_id % 5 when 0 then 'full' when 1 then 'partial' else 'none' end as neutralisation from events",
)
VIEWS["spec_calls"] = (
    "lineitem",
    f"select l_orderkey as method, l_linenumber as pos, {_of(f'(l_partkey * 7 + l_suppkey * 3 + l_linenumber) % {len(_SPECS)}', [c for c, _ in _SPECS])} as class_name, {_of(f'(l_partkey * 7 + l_suppkey * 3 + l_linenumber) % {len(_SPECS)}', [m for _, m in _SPECS])} as method_name from lineitem",
)
VIEWS["accesses"] = (
    "lineitem",
    f"""select cast(l_orderkey % 20 as bigint) as app_id, l_orderkey as method, row_number() over (partition by l_orderkey {_ORDER}) as pos,
        {_of("(l_partkey + l_suppkey * 3) % 7", ("source", "sink", "move", "iput", "iget", "add", "get"))} as op, cast(l_suppkey % 2 as int) as dst, cast(l_partkey % 2 as int) as src,
        cast(l_linenumber % 2 as int) as obj, 'f' || cast(l_partkey % 40 as varchar(9)) as field from lineitem""",
)
VIEWS["class_calls"] = (
    "lineitem",
    f"""select cast(l_orderkey % 20 as bigint) as app_id, l_partkey as caller, l_suppkey as callee, cast(l_orderkey * 10 + l_linenumber as bigint) as site,
        {_of(f'l_partkey % {len(_CLASSES)}', _CLASSES)} as caller_class, {_of(f'l_suppkey % {len(_CLASSES)}', _CLASSES)} as callee_class from lineitem""",
)
_NAMES = ("onCreate", "run", "onResume", "helper", "onReceive", "doWork")
VIEWS["app_methods"] = ("orders", f"select cast(0 as bigint) as app_id, o_orderkey as method_id, 'Lc' || cast(o_custkey as varchar(20)) || ';' as class_name, {_of('o_orderkey % 6', _NAMES)} as method_name from orders")
VIEWS["app_tree"] = (
    "customer",
    f"""select cast(0 as bigint) as app_id, 'Lc' || cast(c_custkey as varchar(20)) || ';' as class_name,
        case when c_custkey % 20 = 0 then '{android.COMPONENT_BASES[0]}' when c_custkey % 10 = 0 then null when c_custkey % 10 in (3, 5) then 'Ljava/lang/Object;' else 'Lc' || cast(c_custkey - c_custkey % 10 as varchar(20)) || ';' end as super_name,
        case when c_custkey % 13 = 0 then '{android.CALLBACK_INTERFACES[0]}' end as face from customer""",
)
VIEWS["reflections"] = (
    "lineitem",
    f"""select cast(0 as bigint) as app_id, l_orderkey as method, row_number() over (partition by l_orderkey {_ORDER}) as pos, {_of("(l_partkey * 5 + l_suppkey) % 4", ("const_string", "class_for_name", "get_method", "invoke"))} as kind,
        cast(l_suppkey % 2 as int) as dst, cast(l_partkey % 2 as int) as src, {_of("l_partkey % 5", ("com.app.Main", "run", "com.app.Other", "load", "com.app.Main"))} as value from lineitem""",
)
VIEWS["flagged"] = (
    "customer",
    f"""select c_custkey as app_id, c_custkey % 3 = 0 as debuggable, c_custkey % 4 = 0 as uses_cleartext_traffic, c_custkey % 5 = 0 as allow_backup, case when c_custkey % 2 = 0 then 'xml/nsc' end as network_security_config,
        cast(c_custkey % 35 as int) as target_sdk, {_of("c_custkey % 4", ("android.permission.ACCESS_BACKGROUND_LOCATION", "android.permission.ACCESS_NETWORK_STATE", "android.permission.READ_SMS", "android.permission.CAMERA"))} as perm_a,
        {_of("c_nationkey % 3", ("android.permission.ACCESS_FINE_LOCATION", "android.permission.INTERNET", "android.permission.READ_CONTACTS"))} as perm_b,
        {_of("c_custkey % 4", ("activity", "service", "receiver", "provider"))} as kind, c_nationkey % 2 = 0 as exported, case when c_custkey % 7 = 0 then 'own.permission' end as permission,
        c_nationkey % 4 = 0 as grants, {_of("c_custkey % 3", ("http", "myapp", "https"))} as scheme_a, {_of("c_nationkey % 3", ("myapp", "https", "http"))} as scheme_b from customer""",
)


# ---------------------------------------------------------------- flows

_PII = f"source_label in ({_list(labels.PERSONAL)})"
_EFFECTIVE = f"select event_id, source_label, chain, neutralisation, case when {_PII} and sink_label = 'LOG' then 'PII_LOG' when {_PII} and sink_label = 'NETWORK_OUT' then 'PII_NETWORK' else sink_label end as sink_label from label_flows"
_SEVERITY = "case " + " ".join(f"when sink_label = '{k}'" + (f" and source_label in ({_list(of)})" if of else "") + f" then '{w}'" for k, of, w in labels.SEVERITIES) + " else 'MEDIUM' end"
_CERTAIN = "(" + " or ".join(f"source_label = '{a}' and sink_label = '{b}'" for a, b in labels.CERTAIN_PAIRS) + ")"
_CWE = "case when sink_label in ('PII_LOG', 'PII_NETWORK') then 'CWE-359' " + " ".join(f"when source_label = '{a}' and sink_label = '{b}' then '{c}'" for a, b, c in labels.WEAKNESSES) + " else 'CWE-200' end"


@_query(
    f""", e as ({_EFFECTIVE}) select event_id, 'TAINT_' || source_label || '_TO_' || sink_label as rule_id, {_SEVERITY} as severity, case when neutralisation = 'full' then 'LOW' when neutralisation = 'partial' then 'MEDIUM' when source_label in ({_list(labels.NOISY_SOURCES)}) then 'LOW' when {_CERTAIN} and chain <= 5 then 'HIGH'
        when chain <= 3 then 'HIGH' when chain <= 8 then 'MEDIUM' else 'LOW' end as confidence, {_CWE} as cwe_id, case when starts_with(sink_label, 'PII_') then 'PRIVACY' else 'TAINT' end as category from e""",
    "label_flows",
)
def taint_flow_findings(spark: SparkSession, d: str) -> DataFrame:
    return taint.classified(view(spark, d, "label_flows")).select("event_id", "rule_id", "severity", "confidence", "cwe_id", "category")


_TABLE = ", ".join(
    [f"('source', '{c}', '{m}', '{k}', {p})" for c, m, k, p in values.SOURCES] + [f"('sink', '{c}', '{m}', '{k}', {p})" for c, m, k, p in values.SINKS]
    + [f"('sanitizer', '{c}', '{m}', '{k}', null)" for c, m, k, _ in values.SANITIZERS]
)


@_query(f"select method, pos, role, label, cast(param as int) as param from spec_calls c join (values {_TABLE}) as v(role, class, name, label, param) on c.class_name = v.class and v.name in ('*', c.method_name)", "spec_calls")
def taint_spec_match(spark: SparkSession, d: str) -> DataFrame:
    return taint.matched(view(spark, d, "spec_calls")).select("method", "pos", "role", "label", "param")


_READ = "case when op in ('move', 'iput', 'add') then 'v' || src when op = 'iget' then 'v' || obj || '.' || field when op = 'get' then 'v' || obj || '[]' end"
_WRITE = "case when op in ('move', 'iget', 'get') then 'v' || dst when op = 'iput' then 'v' || obj || '.' || field when op = 'add' then 'v' || obj || '[]' end"


@_query(
    f""", steps as (select method, pos, {_READ} as r, {_WRITE} as w from accesses), t(method, slot, since) as (select method, 'v' || dst, min(pos) from accesses where op = 'source' group by method, dst
        union select s.method, s.w, s.pos from t join steps s on s.method = t.method and s.r = t.slot and s.pos > t.since and s.r <> s.w)
        select distinct a.method, a.pos from accesses a join t on a.op = 'sink' and a.method = t.method and t.slot = 'v' || a.src and a.pos > t.since""",
    "accesses",
)
def taint_container_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "accesses").withColumn("app_id", F.lit(0))
    starts = rows.where("op = 'source'").select("app_id", "method", F.lit("t").alias("start"), F.concat(F.lit("v"), "dst").alias("slot"), F.col("pos").cast("long").alias("since"))
    state = taint.closed(taint.access_steps(rows), starts)
    sinks = rows.where("op = 'sink'").select("app_id", "method", F.col("pos"), F.concat(F.lit("v"), "src").alias("slot"))
    return sinks.join(state, ["app_id", "method", "slot"]).where("pos > since").select("method", "pos").distinct()


@_query(
    """, edges as (select app_id, method as from_method, pos, 'v' || src as r, method as to_method, 'v' || dst as w from accesses where op = 'move' and src <> dst
        union all select app_id, method, pos, 'v' || src, -1, 's:' || field from accesses where op = 'iput'
        union all select app_id, -1, pos, 's:' || field, method, 'v' || dst from accesses where op = 'iget'),
        t(app_id, method, slot, since) as (select app_id, method, 'v' || dst, min(pos) from accesses where op = 'source' group by app_id, method, dst
        union select e.app_id, e.to_method, e.w, case when e.to_method = -1 then 0 else e.pos end from t join edges e on e.app_id = t.app_id and e.from_method = t.method and e.r = t.slot and e.pos > t.since)
        select distinct app_id, substring(slot, 3) as field from t where method = -1""",
    "accesses",
)
def taint_static_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "accesses").where("op in ('source', 'move', 'iput', 'iget')")
    return taint.static_fields(rows.withColumn("op", F.when(F.col("op") == "iput", "sput").when(F.col("op") == "iget", "sget").otherwise(F.col("op"))))


# ---------------------------------------------------------------- edges and entries

_INFRA = android.INFRA_PREFIXES + android.KOTLIN_INFRA_PREFIXES
_FRAME = _INFRA + android.FRAMEWORK_BULK_PREFIXES


@_query(
    f"select app_id, caller, callee, max(site) as site from class_calls where not {_starts('caller_class', _INFRA)} and (not {_starts('caller_class', _FRAME)} or not {_starts('callee_class', _FRAME)}) group by app_id, caller, callee",
    "class_calls",
)
def call_edges_build(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_edges(view(spark, d, "class_calls").withColumnRenamed("site", "offset")).withColumnRenamed("offset", "site")


@_query(
    f""", up as (select coalesce(super_name, 'Ljava/lang/Object;') as src, class_name as dst from app_tree where coalesce(super_name, 'Ljava/lang/Object;') <> class_name union all select face, class_name from app_tree where face is not null),
        tree(node) as (select '{android.COMPONENT_BASES[0]}' union select dst from tree join up on src = node),
        own as (select node from tree union select class_name from app_tree where face in ({_list(android.CALLBACK_INTERFACES)})), called as (select o_orderkey + 6 as id from orders where o_orderkey % 4 = 0)
        select distinct app_id, method_id from app_methods where method_name in ({_list(android.LIFECYCLE_METHODS)}) and (class_name in (select node from own) or method_id not in (select id from called))""",
    "app_methods", "app_tree",
)
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    tree = view(spark, d, "app_tree")
    classes = tree.select("app_id", "class_name", "super_name", F.array_compact(F.array("face")).alias("interfaces"))
    edges = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 4 = 0").select(F.lit(0).cast("long").alias("app_id"), (F.col("o_orderkey") + 6).alias("callee"))
    return graph.entry_points(view(spark, d, "app_methods"), classes, edges)


_TARGETS = (("Lcom/app/Main;", "run", 1), ("Lcom/app/Main;", "run", 2), ("Lcom/app/Other;", "load", 3), ("Lcom/app/Main;", "load", 4))
_LAST = "(select arg_max({0}, y.pos) from named y where y.method = n.method and y.kind = '{1}' and y.pos <= n.pos and y.defined is not null)"


@_query(
    f""", named as (select *, (select arg_max(c.value, c.pos) from reflections c where c.method = r.method and c.kind = 'const_string' and c.dst = r.src and c.pos < r.pos) as defined from reflections r),
        held as (select *, {_LAST.format("'L' || replace(y.defined, '.', '/') || ';'", "class_for_name")} as cls, {_LAST.format("y.defined", "get_method")} as name from named n)
        select method as caller, callee, pos as site from held join (values {', '.join(str(x) for x in _TARGETS)}) as m(class_name, method_name, callee) on cls = class_name and name = method_name
        where kind = 'invoke' and not (method % 9 = 0 and callee = 1)""",
    "reflections",
)
def reflection_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "reflections").withColumn("block", F.lit(0))
    methods = spark.createDataFrame([(0, *t) for t in _TARGETS], "app_id long, class_name string, method_name string, method_id int")
    known = rows.where("method % 9 = 0").select("app_id", F.col("method").alias("caller"), F.lit(1).alias("callee")).distinct()
    return code.reflection_edges(rows, methods, known).select("caller", "callee", F.col("offset").alias("site"))


# ---------------------------------------------------------------- manifests and names


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "flagged")
    links = F.array(F.struct(F.col("scheme_a").alias("scheme")), F.struct(F.col("scheme_b").alias("scheme")))
    component = F.struct(F.concat(F.lit("c"), "app_id").alias("name"), "kind", "exported", "permission", F.col("grants").alias("grant_uri_permissions"), links.alias("deep_links"))
    return rows.select("app_id", "debuggable", "uses_cleartext_traffic", "allow_backup", "network_security_config", "target_sdk", F.array("perm_a", "perm_b").alias("permissions"), F.array(component).alias("components"))


def _either(p: str) -> str:
    return f"(perm_a = 'android.permission.{p}' or perm_b = 'android.permission.{p}')"


_DATA = [p for p, _ in android.DATA_SAFETY]
_COMPONENT_RULES = (
    ("MANIFEST_EXPORTED_ACTIVITY", "exported and permission is null and kind = 'activity'"), ("MANIFEST_EXPORTED_SERVICE", "exported and permission is null and kind = 'service'"),
    ("MANIFEST_EXPORTED_BROADCASTRECEIVER", "exported and permission is null and kind = 'receiver'"), ("MANIFEST_EXPORTED_CONTENTPROVIDER", "exported and permission is null and kind = 'provider'"),
    ("MANIFEST_PROVIDER_GRANT_URI", "exported and permission is null and kind = 'provider' and grants"),
    ("DEEPLINK_UNPROTECTED", "'myapp' in (scheme_a, scheme_b) and permission is null and kind in ('activity', 'service')"),
    ("DEEPLINK_MIXED_SCHEMES", "'myapp' in (scheme_a, scheme_b) and (scheme_a in ('http', 'https') or scheme_b in ('http', 'https'))"),
)
_FLAG_RULES = (
    ("MANIFEST_DEBUGGABLE", "debuggable"), ("MANIFEST_CLEARTEXT", "uses_cleartext_traffic"), ("STORAGE_BACKUP_ENABLED", "allow_backup"), ("MANIFEST_NSC_MISSING", "network_security_config is null"),
    ("MANIFEST_TARGET_SDK_LOW", "target_sdk > 0 and target_sdk < 30"), ("PRIVACY_LOCATION_BACKGROUND", _either("ACCESS_BACKGROUND_LOCATION")),
    ("PRIVACY_NETWORK_STATE_COMBINED", _either("ACCESS_NETWORK_STATE") + " and " + _either("ACCESS_FINE_LOCATION")),
)


@_query(" union all ".join(f"select app_id, 'c' || app_id as name, '{r}' as rule_id from flagged where {test}" for r, test in _COMPONENT_RULES), "flagged")
def component_rules(spark: SparkSession, d: str) -> DataFrame:
    return manifest.component_rules(_manifests(spark, d))


@_query(
    " union all ".join(f"select app_id, '{r}' as rule_id from flagged where {test}" for r, test in (*_FLAG_RULES, *_COMPONENT_RULES))
    + f" union all select app_id, 'PRIVACY_PERM_' || string_split(p, '.')[-1] from (select distinct app_id, unnest([perm_a, perm_b]) as p from flagged) z where p in ({_list(sorted({*_DATA} & {*android.DANGEROUS_PERMISSIONS}))})",
    "flagged",
)
def manifest_rules(spark: SparkSession, d: str) -> DataFrame:
    return manifest.manifest_rules(_manifests(spark, d))


_TEST_NAMES = ("Lcom/app/LoginTest;", "Lcom/app/MockUser;", "Lcom/app/Latest;", "Lcom/app/test/A;", "Lcom/app/BuildConfig;", "Lcom/app/R$id;", "Lcom/app/Stubble;", "Lorg/junit/Runner;", "Lcom/app/Faker;", "Lcom/app/A$FakeB;", "Lcom/app/Debugger;", "Lcom/app/UserTests;")


@_query(f"select p_partkey, {' or '.join(f'regexp_matches(n, $re${p}$re$)' for p in labels.TEST_CLASSES)} as is_test from (select p_partkey, {_of(f'p_partkey % {len(_TEST_NAMES)}', _TEST_NAMES)} as n from part) t")
def test_classes(spark: SparkSession, d: str) -> DataFrame:
    names = F.expr(_of(f"p_partkey % {len(_TEST_NAMES)}", _TEST_NAMES))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", txt.is_test_class(names).alias("is_test"))


_ROT = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')"


@_query(f"""select p_partkey, case p_partkey % 4 when 0 then case when length(p_type) >= 4 then p_type end when 1 then case when length(p_name) >= 3 then p_name end when 2 then reverse(p_name) else {_ROT.format('p_name')} end as text from part""")
def decoded_strings(spark: SparkSession, d: str) -> DataFrame:
    rows, k = spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey") % 4
    coded = F.when(k == 0, F.base64(F.col("p_type").cast("binary"))).when(k == 1, F.hex("p_name")).otherwise(F.col("p_name"))
    hint = F.when(k == 0, "Base64.decode").when(k == 1, "Hex.fromHex").when(k == 2, "reverse").otherwise("rot13")
    return rows.select("p_partkey", txt.decoded(coded, hint).alias("text"))
