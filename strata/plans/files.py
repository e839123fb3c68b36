"""Queries over files of packages: native binaries, metadata folders, string resources, limits of a scan and the reuse of
earlier results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import detectors, manifest, reuse
from strata.plans import smali as code_plans
from strata.plans.keep import written
from strata.plans.views import VIEWS, view, with_views
from strata.sources import archives, binaries, smali

QUERIES, SQL = {}, {}


def _query(sql: str, *views: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, with_views(sql, *views) if views else sql
        return f

    return put


def _number(value: int, size: int, little: bool) -> str:
    return value.to_bytes(size, "little" if little else "big").hex()


def _elf(kind: int, headers: tuple[tuple[int, int], ...], wide: bool, little: bool) -> str:
    """A made header and its table, in hexadecimal digits."""
    n = lambda value, size: _number(value, size, little)
    head = "7f454c46" + ("02" if wide else "01") + ("01" if little else "02") + "01" + "00" * 9
    word, step, first = (8, 56, 64) if wide else (4, 32, 52)
    head += n(kind, 2) + n(62, 2) + n(1, 4) + n(0, word) + n(first, word) + n(0, word) + n(0, 4) + n(first, 2) + n(step, 2) + n(len(headers), 2) + n(0, 2) * 3
    rows = [n(what, 4) + n(flags, 4) + "00" * 48 if wide else n(what, 4) + "00" * 20 + n(flags, 4) + "00" * 4 for what, flags in headers]
    return head + "".join(rows)


_KINDS = (2, 3, 4)
_TABLES = ((), ((0x6474E551, 6),), ((1, 5), (0x6474E551, 7)), ((0x6474E552, 4), (0x6474E551, 6)), ((0x6474E552, 4),))
_MADE = [_elf(k, t, wide, little) for k in _KINDS for t in _TABLES for wide in (True, False) for little in (True, False)]
_MARKS = ("", b"..__stack_chk_fail..".hex(), b"__stack_chk_guard .debug_str".hex(), b".debug_info".hex())
_CASE = lambda e, options: f"case {e} " + " ".join(f"when {i} then '{o}'" for i, o in enumerate(options)) + " end"
#: Every seventh is text, every eleventh is cut within its header, every thirteenth within its table.
VIEWS["native_files"] = (
    "part",
    f"""select p_partkey % 17 as app_id, 'lib/' || cast(p_partkey as varchar(20)) || '.so' as path, unhex(case when p_partkey % 7 = 0 then '23212f62696e' when p_partkey % 11 = 0 then substr(made, 1, 80)
        when p_partkey % 13 = 0 then substr(made, 1, length(made) - 20) else made || mark end) as content, made, mark from (select p_partkey, {_CASE(f'p_partkey % {len(_MADE)}', _MADE)} as made, {_CASE('p_size % 4', _MARKS)} as mark from part) t""",
)


@_query(
    f"""with parts as (select p_partkey as k, p_partkey % {len(_MADE)} // 20 as kind, p_partkey % {len(_MADE)} % 20 // 4 as t, p_size % 4 as mark from part where p_partkey % 7 <> 0 and p_partkey % 11 <> 0),
    told as (select k, kind, t, mark, k % 13 = 0 as short from parts)
    select k % 17 as app_id, 'lib/' || k || '.so' as path, rule_id, severity, confidence from told, (values ('NATIVE_NO_PIE', 'MEDIUM', 'HIGH'), ('NATIVE_NO_NX', 'HIGH', 'HIGH'), ('NATIVE_NO_RELRO', 'MEDIUM', 'HIGH'),
        ('NATIVE_NO_STACK_CANARY', 'MEDIUM', 'MEDIUM'), ('NATIVE_DEBUG_SYMBOLS', 'LOW', 'HIGH')) as r(rule_id, severity, confidence)
    where case rule_id when 'NATIVE_NO_PIE' then kind = 0 when 'NATIVE_NO_NX' then not (t = 1 and not short or t = 3 and not short) when 'NATIVE_NO_RELRO' then not (t = 3 or t = 4 and not short)
        when 'NATIVE_NO_STACK_CANARY' then short or mark not in (1, 2) else not short and mark in (2, 3) end"""
)
def native_binaries(spark: SparkSession, d: str) -> DataFrame:
    return binaries.native_rules(binaries.elf_facts(view(spark, d, "native_files")))


VIEWS["meta_files"] = (
    "part",
    """select p_size % 23 as app_id, case p_partkey % 6 when 0 then 'original/META-INF/MANIFEST.MF' when 1 then 'META-INF/lib' || cast(p_partkey % 9 as varchar(9)) || '.version' when 2 then 'META-INF/x/Lib' || cast(p_partkey % 9 as varchar(9)) || '.properties'
        when 3 then 'META-INF/lib' || cast(p_partkey % 9 as varchar(9)) || '.kotlin_module' when 4 then 'META-INF/lib1.properties.version' else 'res/lib2.version' end as path,
        case p_partkey % 4 when 0 then 'Manifest-Version: 1.0' || chr(10) || chr(10) || 'Implementation-Title: Lib' || cast(p_size % 5 as varchar(9)) || chr(10) || 'Implementation-Version: 1.' || cast(p_partkey % 10 as varchar(9)) || chr(10) || chr(10) || 'Implementation-Title: only'
        when 1 then '# made' || chr(10) || '  2.' || cast(p_partkey % 10 as varchar(9)) || chr(10) when 2 then 'a=b' || chr(10) || 'version=3.' || cast(p_partkey % 10 as varchar(9)) || '-rc' || chr(10) || 'Bundle-Version: 9x!' else 'Specification-Version: 4.0' || chr(10) || 'Bundle-Version: 5.' || cast(p_partkey % 10 as varchar(9)) end as text from part""",
)


@_query(
    r""", files as (select distinct app_id, path, text, string_split(path, '/')[-1] as file from meta_files where contains(path, 'META-INF/')),
    sections as (select app_id, path, i, regexp_extract(s[i], '(?m)^Implementation-Title:\s*(.+)$', 1) as title, regexp_extract(s[i], '(?m)^Implementation-Version:\s*([\d][\w.\-+]*)', 1) as version
        from (select app_id, path, string_split(text, chr(10) || chr(10)) as s, unnest(range(1, 1 + len(string_split(text, chr(10) || chr(10))))) as i from files where file = 'MANIFEST.MF') t),
    named as (select app_id, path, lower(regexp_replace(regexp_replace(regexp_replace(file, '\.version$', ''), '\.properties$', ''), '\.kotlin_module$', '')) as name,
        coalesce(nullif(regexp_extract(text, '(?m)^Implementation-Version:\s*([\d][\w.\-+]*)$', 1), ''), nullif(regexp_extract(text, '(?m)^Bundle-Version:\s*([\d][\w.\-+]*)$', 1), ''), nullif(regexp_extract(text, '(?m)^version=([\d][\w.\-+]*)$', 1), ''),
            nullif(regexp_extract(text, '(?m)^Specification-Version:\s*([\d][\w.\-+]*)$', 1), ''), case when not ends_with(file, '.kotlin_module') then nullif(regexp_extract(text, '(?m)^ *([\d][\w.\-+]*) *$', 1), '') end) as version
        from files where regexp_matches(file, '\.(version|properties|kotlin_module)$')),
    every as (select app_id, lower(trim(title)) as name, version, 0 as by_name, path, i from sections where title <> '' and version <> '' union all select app_id, name, version, 1, path, 0 from named where version is not null)
    select app_id, name, version from every qualify row_number() over (partition by app_id, name order by by_name desc, path desc, i desc, version desc) = 1""",
    "meta_files",
)
def meta_inf_versions(spark: SparkSession, d: str) -> DataFrame:
    return binaries.mined_versions(view(spark, d, "meta_files").distinct())


VIEWS["string_files"] = (
    "pages",
    """select page_id % 11 as app_id, 'res/values/strings-' || cast(page_id as varchar(20)) || '.xml' as path, '<resources><string name="a' || cast(page_id % 3 as varchar(9)) || '">' || case page_id % 5 when 0 then 'see http://example.com/' || cast(page_id as varchar(20)) || ' and http://b.example'
        when 1 then 'http://10.0.0.1/x' when 2 then 'https://example.com' when 3 then 'HTTP://up.example http://LOCALHOST:80 http://172.20.1.1' else 'http://172.32.1.1/a?b=c' end || '</string><string>http://c.example</string><item>http://d.example</item></resources>' as text from pages""",
)


@_query(
    """, urls as (select app_id, path, 'a' || (cast(regexp_extract(path, '-([0-9]+)', 1) as bigint) % 3) as name, unnest(regexp_extract_all(split_part(split_part(text, '</string>', 1), '">', 2), 'http://[^ <]+')) as url from string_files
        union all select app_id, path, '?', 'http://c.example' from string_files)
    select app_id, path, 'RES_CLEARTEXT_URL_IN_STRINGS' as rule_id, '<string name="' || name || '">' || url || '</string>' as evidence from urls where not starts_with(url, 'http://10.') and not starts_with(lower(url), 'http://localhost') and not starts_with(url, 'http://172.20.')""",
    "string_files",
)
def cleartext_strings(spark: SparkSession, d: str) -> DataFrame:
    return binaries.cleartext_strings(view(spark, d, "string_files"))


VIEWS["tree_files"] = (
    "pages",
    """select page_id % 3 as app_id, 'res/' || cast(page_id % 97 as varchar(9)) || '/' || cast(page_id as varchar(20)) || case page_id % 4 when 0 then '.xml' when 1 then '.TXT' when 2 then '.png' else '.js' end as path, cast(length(html) as bigint) as length from pages""",
)


@_query(
    """select app_id, path, length, case when length > 600 then 'size' when row_number() over (partition by app_id, length > 600 order by path) > 20 then 'count' end as skipped from tree_files where not ends_with(path, '.png')""",
    "tree_files",
)
def walk_limits(spark: SparkSession, d: str) -> DataFrame:
    return binaries.within_limits(view(spark, d, "tree_files"), (".xml", ".txt", ".js"), 600, 20)


@_query(code_plans.SQL["smali_logs"])
def smali_reuse(spark: SparkSession, d: str) -> DataFrame:
    """The findings of all code, where those of methods whose code an earlier state had are taken over from it."""
    lines = code_plans.lines(spark, d)
    earlier = lines.where("file % 3 <> 0 and not (file % 5 = 0 and line like '%Log;%')")
    logs = lambda code: detectors.logs(smali.for_detectors(code))
    read = lambda of: written(smali.instructions(of).select(*reuse.READ))
    kept = reuse.analysed(read(earlier), logs)
    return reuse.current(read(lines), kept, logs)


_A = 'xmlns:android="http://schemas.android.com/apk/res/android"'
_SDKS, _SCHEMES = (19, 22, 28, 30, 31, 34), ("https", "myapp", "com.app.oauth", "http", "file")
VIEWS["manifest_files"] = (
    "customer",
    f"""select c_custkey as app_id, '<manifest {_A} package="com.app.c' || cast(c_custkey as varchar(20)) || '"><uses-sdk android:targetSdkVersion="' || {_CASE(f'c_custkey % {len(_SDKS)}', _SDKS)} || '"/><uses-permission android:name="android.permission.CAMERA"/>'
        || case c_custkey % 3 when 0 then '<permission android:name="own.P"/>' when 1 then '<permission android:name="own.S" android:protectionLevel="signature"/>' else '' end
        || '<application' || case c_nationkey % 3 when 0 then ' android:allowBackup="false" android:debuggable="TRUE"' when 1 then ' android:allowBackup="true" android:networkSecurityConfig="@xml/nsc"' else ' android:usesCleartextTraffic="true"' end || '><activity android:name=".Main"'
        || case c_custkey % 4 when 0 then ' android:exported="false"' when 1 then ' android:exported="true"' else '' end || '>' || case when c_custkey % 5 < 4 then '<intent-filter android:autoVerify="true"><action android:name="android.intent.action.VIEW"/><data android:scheme="' || {_CASE('c_nationkey % 5', _SCHEMES)} || '" android:host="' || case c_custkey % 2 when 0 then 'login.example' else 'example.com' end || '"/><data android:mimeType="a/b"/></intent-filter>' else '' end
        || '</activity><provider android:name=".P" android:grantUriPermissions="true"' || case c_nationkey % 2 when 0 then ' android:authorities="a.b"' else '' end || '/></application></manifest' || case when c_custkey % 13 = 0 then '' else '>' end as xml from customer""",
)


@_query(
    f""", f as (select app_id, c_nationkey as n, app_id % 5 < 4 as filtered, {_CASE(f'app_id % {len(_SDKS)}', _SDKS)}::int as sdk, {_CASE('c_nationkey % 5', _SCHEMES)} as scheme, app_id % 4 as e from (select c_custkey as app_id, c_nationkey from customer where c_custkey % 13 <> 0) t),
    x as (select *, e = 1 or (e <> 0 and filtered) as open, n % 2 = 0 as given from f)
    select app_id, 'MANIFEST_DEBUGGABLE' as rule_id from x where n % 3 = 0 union all select app_id, 'MANIFEST_CLEARTEXT' from x where n % 3 = 2 union all select app_id, 'STORAGE_BACKUP_ENABLED' from x where n % 3 = 1 or (n % 3 = 2 and sdk < 31)
    union all select app_id, 'MANIFEST_NSC_MISSING' from x where n % 3 <> 1 union all select app_id, 'MANIFEST_TARGET_SDK_LOW' from x where sdk < 30 union all select app_id, 'PRIVACY_PERM_CAMERA' from x
    union all select app_id, 'MANIFEST_EXPORTED_ACTIVITY' from x where open union all select app_id, unnest(['MANIFEST_EXPORTED_CONTENTPROVIDER', 'MANIFEST_PROVIDER_GRANT_URI']) from x where given
    union all select app_id, 'DEEPLINK_UNPROTECTED' from x where open and filtered and scheme not in ('http', 'https')
    union all select app_id, 'MANIFEST_CUSTOM_PERMISSION_NORMAL' from x where app_id % 3 = 0 union all select app_id, 'MANIFEST_TAPJACKING_RISK' from x where open and sdk < 23
    union all select app_id, 'DEEPLINK_OAUTH_HIJACK' from x where open and filtered and (scheme like '%oauth%' or app_id % 2 = 0)
    union all select c_custkey, 'malformed' from customer where c_custkey % 13 = 0"""
    .replace(", f as", "with f as", 1)
)
def manifest_xml_rules(spark: SparkSession, d: str) -> DataFrame:
    manifests = written(manifest.parsed(view(spark, d, "manifest_files")))
    fine = manifests.where("error is null")
    found = manifest.manifest_rules(fine).unionByName(manifest.declared_rules(fine).select("app_id", "rule_id"))
    return found.unionByName(manifests.where("error is not null").select("app_id", F.col("error").alias("rule_id")))


_PATHS = ("base/dex/classes.dex", "feat/lib/arm/x.so", "base/res/a.xml", "base/manifest/AndroidManifest.xml", "base/root/r.txt", "BundleConfig.pb", "feat/assets/d/e.bin", "base/other/z")
_TARGETS = ("classes.dex", "lib/arm/x.so", "res/a.xml", "AndroidManifest.xml", "r.txt", None, "assets/d/e.bin", None)
_PACKAGES = (("a.aab", "aab"), ("b.XAPK", "xapk"), ("c.apks", "apks"), ("d.apkm", "apkm"), ("e.apk", "apk"), ("f", "apk"))
VIEWS["bundle_files"] = ("part", f"select p_partkey, {_CASE(f'p_partkey % {len(_PACKAGES)}', [p for p, _ in _PACKAGES])} as package, {_CASE(f'p_size % {len(_PATHS)}', _PATHS)} as path from part")


@_query(
    f"""select p_partkey, {_CASE(f'p_partkey % {len(_PACKAGES)}', [k for _, k in _PACKAGES])} as kind, case p_size % {len(_PATHS)} {' '.join(f"when {i} then '{t}'" for i, t in enumerate(_TARGETS) if t)} end as target,
    case when p_size % {len(_PATHS)} = 0 then case when row_number() over (partition by p_partkey % {len(_PACKAGES)}, p_size % {len(_PATHS)} = 0 order by p_partkey) = 1 then 'classes.dex'
        else 'classes' || row_number() over (partition by p_partkey % {len(_PACKAGES)}, p_size % {len(_PATHS)} = 0 order by p_partkey) || '.dex' end end as code_name from part"""
)
def bundle_files(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of bundles by suffix, where a bundle's files go in a package, and the names that its code files get."""
    files = view(spark, d, "bundle_files").withColumns({"kind": archives.bundle_kind(F.col("package")), "target": archives.flattened_path(F.col("path"))})
    named = archives.dex_names(files.where("target = 'classes.dex'").select("package", F.col("p_partkey").alias("split"), F.col("path").alias("name")), ("package",))
    return files.join(named.select(F.col("split").alias("p_partkey"), F.col("target").alias("code_name")), "p_partkey", "left").select("p_partkey", "kind", "target", "code_name")
