"""The analysis' relations as views over the general test tables.

Each view is plain SQL that Spark and DuckDB both run. It only renames and derives inputs; what a query finds
is computed by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _case(expression: str, values) -> str:
    return f"case {expression} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


RULE_IDS = (
    "CRYPTO_ECB_MODE", "CRYPTO_CONSTANT_KEY", "SECRET_AWS_KEY", "NETWORK_CLEARTEXT", "NETWORK_RETROFIT_VERIFY", "TAINT_INTENT_TO_EXEC",
    "TAINT_ACCOUNT_TO_PII_LOG", "OBFUSC_DYNAMIC_DEX", "ANTIANALYSIS_ROOT_CHECK", "MANIFEST_EXPORTED_SERVICE", "PRIVACY_PERM_READ_SMS",
    "STORAGE_PREFS_PLAINTEXT", "CUSTOM_CHECK", "TAINT_FILE_TO_SQL_INJECT", "DEX_CLASS_LOADER_USE", "CRYPTO_ECB_MODE_EXTRA", "TRACKER_ADVERTISING_X",
)
CATEGORIES = ("CRYPTO", "NETWORK", "STORAGE", "SECRETS", "TAINT", "MANIFEST", "WEBVIEW", "OBFUSCATION", "PRIVACY", "SDK", "REFLECTION", "OTHER")
CLASSES = (
    "Lcom/app/Main;", "Lcom/google/firebase/analytics/A;", "Lcom/google/android/gms/ads/B;", "Lcom/app/test/Case;", "Lcom/app/debug/Menu;",
    "Lokhttp3/Call;", "Lcom/app/BuildConfig;", "Lcom/app/ui/Screen$1;", "Lcom/google/firebase/storage/C;", "Lcom/app/Latest;",
)
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
PERMISSIONS = ("android.permission.CAMERA", "android.permission.READ_SMS", "android.permission.INTERNET", "android.permission.ACCESS_FINE_LOCATION", "android.permission.VIBRATE", "android.permission.READ_CONTACTS")
SDK_CLASSES = (
    "Lcom/facebook/ads/internal/A;", "Lcom/google/android/gms/ads/doubleclick/B;", "Lcom/google/android/gms/ads/C;", "Lokhttp3/internal/Version;", "Lokhttp3/Call;",
    "Lretrofit2/Retrofit;", "Lcom/app/Main;", "Lcom/google/firebase/analytics/D;", "Lcom/applovin/E;", "Lcom/google/gson/Gson;", "Lio/sentry/F;",
)

VIEWS: dict[str, tuple[str, str]] = {
    # view: (table it reads, SQL)
    "findings": (
        "events",
        f"""select cast(user_id % 97 as bigint) as app_id, event_id,
            {_case(f"(event_id * 7 + user_id) % {len(RULE_IDS)}", RULE_IDS)} as rule_id,
            {_case("cast(floor(value) as bigint) % 5", SEVERITIES)} as severity,
            {_case("(event_id + user_id) % 3", CONFIDENCES)} as confidence,
            {_case(f"(event_id * 5 + user_id) % {len(CATEGORIES)}", CATEGORIES)} as category,
            {_case(f"(event_id + user_id * 3) % {len(CLASSES)}", CLASSES)} as class_name,
            case when event_id % 11 = 0 then 'mock/run' else event_type end as method_name,
            cast(event_id % 50 as int) as line_number,
            'call @offset ' || cast(event_id as varchar(20)) || ' to 0xA' || cast(user_id as varchar(20)) || ' by ' || event_type as evidence,
            ts from events""",
    ),
    "calls": (
        "lineitem",
        """select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as dst,
            l_returnflag, l_quantity from lineitem) t where l_returnflag = 'R' and l_quantity >= 45 and dst is not null and src <> dst
            union select -100 + l_partkey % 12, -99 + l_partkey % 12 from lineitem union select 10000000 + l_suppkey % 10, 10000000 + (l_suppkey + 1) % 10 from lineitem""",
    ),
    "instructions": (
        "lineitem",
        """select l_orderkey as method, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as pos,
            cast(l_partkey % 8 as int) as op, cast(l_suppkey % 4 as int) as dst, cast((l_partkey + l_linenumber) % 4 as int) as src, cast(l_suppkey % 5 as int) as kind, cast(l_quantity as int) as num from lineitem""",
    ),
    "strings": ("documents", "select doc_id as app_id, text as value from documents"),
    "manifests": (
        "customer",
        f"""select c_custkey as app_id, {_case(f"c_custkey % {len(PERMISSIONS)}", PERMISSIONS)} as permission_a, {_case(f"(c_custkey + c_nationkey) % {len(PERMISSIONS)}", PERMISSIONS)} as permission_b,
            cast(16 + c_custkey % 20 as int) as target_sdk, c_custkey % 3 = 0 as debuggable, c_custkey % 4 = 0 as cleartext, c_mktsegment as package from customer""",
    ),
    "links": (
        "pages",
        """select page_id, lower(split_part(url, '://', 1)) as scheme, split_part(split_part(url, '://', 2), '/', 1) as host,
            page_id % 3 = 0 as auto_verify, page_id % 5 = 0 as has_path, cast(page_id % 7 as bigint) as component from pages""",
    ),
    "resources": (
        "pages",
        """select page_id, html || case page_id % 4 when 0 then ' src="http://cdn.example.com/lib.js"' when 1 then ' src="http://10.0.0.1/x.js" href="http://localhost/y"' else '' end as html from pages""",
    ),
    "key_files": ("documents", "select doc_id, case doc_id % 50 when 0 then '-----BEGIN RSA PRIVATE KEY-----' when 1 then '-----BEGIN PRIVATE KEY-----' when 2 then '-----BEGIN PUBLIC KEY-----' else '' end || coalesce(text, '') as text from documents"),
    "app_classes": ("part", f"select cast(p_size % 23 as bigint) as app_id, {_case(f'p_partkey % {len(SDK_CLASSES)}', SDK_CLASSES)} as class_name from part"),
    "mined_versions": (
        "part",
        """select distinct cast(p_size % 23 as bigint) as app_id, case p_partkey % 3 when 0 then 'okhttp' when 1 then 'x-retrofit' else 'gson' end as name,
            '4.' || cast(p_size % 12 as varchar(9)) || '.' || cast(p_size % 4 as varchar(9)) as version from part where p_partkey % 2 = 0""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a frame."""
    source, sql = VIEWS[name]
    sql = sql.replace("{", "{{").replace("}", "}}").replace(f"from {source}", f"from {{{source}}}")
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


def with_views(sql: str, *names: str) -> str:
    """SQL for DuckDB with the views before it."""
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in names) + "\n" + sql


def values(rows, columns: str) -> str:
    """A fixed table as a SQL relation."""
    def one(x) -> str:
        return "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"(values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as t({columns})"
