"""Rules over manifests: permissions, deep links, components and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.catalogues import android
from strata.plans.keep import fixed


def dangerous(manifests: DataFrame) -> DataFrame:
    """(app_id, permission, data): dangerous permissions that an app declares, with the data to be disclosed."""
    wanted = F.array(*map(F.lit, android.DANGEROUS_PERMISSIONS))
    each = manifests.select("app_id", F.explode(F.array_intersect("permissions", wanted)).alias("permission"))
    return each.join(fixed(manifests.sparkSession, android.DATA_SAFETY, "permission string, data string"), "permission", "left").select("app_id", "permission", "data")


def tagged(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with rule_id, once for each of the rules whose condition holds."""
    hits = F.filter(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules)), lambda x: x.isNotNull())
    return rows.withColumn("rule_id", F.explode(hits))


def link_rules(links: DataFrame) -> DataFrame:
    """links (scheme, host, auto_verify, has_path, ..) with the rules that each breaks."""
    web = F.col("scheme").isin("http", "https")
    return tagged(links, [
        ("DEEPLINK_HTTP_SCHEME", F.col("scheme") == "http"),
        ("DEEPLINK_NO_AUTO_VERIFY", web & ~F.col("auto_verify")),
        ("DEEPLINK_WILDCARD_HOST", F.col("host").startswith("*")),
        ("DEEPLINK_NO_PATH_CONSTRAINT", web & ~F.col("has_path")),
    ])


#: What is read of a manifest; attributes lose their namespace.
_LINKS = "`intent-filter`: array<struct<_autoVerify: string, data: array<struct<_scheme: string, _host: string, _path: string, _pathPrefix: string, _pathPattern: string>>>>"
_COMPONENT = f"array<struct<_name: string, _exported: string, _permission: string, _authorities: string, _grantUriPermissions: string, {_LINKS}>>"
_MANIFEST = (
    "_package string, `uses-permission` array<struct<_name: string>>, permission array<struct<_name: string, _protectionLevel: string>>, `uses-sdk` struct<_targetSdkVersion: string>,"
    " application struct<_debuggable: string, _allowBackup: string, _usesCleartextTraffic: string, _networkSecurityConfig: string, "
    + ", ".join(f"{kind}: {_COMPONENT}" for kind in ("activity", "service", "receiver", "provider"))
    + ">, _corrupt_record string"
)


def parsed(files: DataFrame) -> DataFrame:
    """Manifests from their XML (app_id, xml): package, permissions, target_sdk, flags, custom_permissions and the
    exported components with their deep links, as manifest_rules reads them, and error.

    A component without `exported` is exported if it has an intent filter, a provider also if it has authorities;
    backups are allowed below version 31 unless it is said. Text that is no XML has the error `malformed` and nulls.
    """
    rows = files.select("app_id", F.from_xml("xml", _MANIFEST, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("m"))
    fine = F.col("m").isNotNull() & F.col("m._corrupt_record").isNull() & F.col("m.application").isNotNull()
    true_ = lambda c: F.lower(F.coalesce(c, F.lit("false"))) == "true"
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    each_of = lambda c: F.coalesce(c, F.array())
    sdk = F.coalesce(F.expr("try_cast(m.`uses-sdk`._targetSdkVersion as int)"), F.lit(0))

    def links(c: Column) -> Column:
        of_filter = lambda f: F.transform(
            F.filter(each_of(f["data"]), lambda d: some(d["_scheme"])),
            lambda d: F.struct(d["_scheme"].alias("scheme"), F.coalesce(d["_host"], F.lit("")).alias("host"), true_(f["_autoVerify"]).alias("auto_verify"), (some(d["_path"]) | some(d["_pathPrefix"]) | some(d["_pathPattern"])).alias("has_path")),
        )
        return F.flatten(F.transform(each_of(c["intent-filter"]), of_filter))

    def components(kind: str) -> Column:
        said = lambda c: F.coalesce(c["_exported"], F.lit(""))
        filtered = lambda c: F.coalesce(F.size(c["intent-filter"]), F.lit(0)) > 0
        implied = (lambda c: filtered(c) | some(c["_authorities"])) if kind == "provider" else filtered
        exported = F.filter(each_of(F.col(f"m.application.{kind}")), lambda c: (said(c) == "true") | ((said(c) != "false") & implied(c)))
        return F.transform(exported, lambda c: F.struct(F.lit(kind).alias("kind"), F.coalesce(c["_name"], F.lit("")).alias("name"), c["_permission"].alias("permission"), F.lit(True).alias("exported"), true_(c["_grantUriPermissions"]).alias("grant_uri_permissions"), links(c).alias("deep_links")))

    flag = lambda name: F.when(fine, true_(F.col(f"m.application.{name}")))
    return rows.select(
        "app_id", F.when(~fine, "malformed").alias("error"), F.when(fine, F.col("m._package")).alias("package"),
        F.when(fine, F.transform(each_of(F.col("m.`uses-permission`")), lambda p: p["_name"])).alias("permissions"),
        F.when(fine, sdk).alias("target_sdk"), flag("_debuggable").alias("debuggable"), flag("_usesCleartextTraffic").alias("uses_cleartext_traffic"),
        F.when(fine, F.when(F.col("m.application._allowBackup").isNotNull(), true_(F.col("m.application._allowBackup"))).otherwise(sdk < 31)).alias("allow_backup"),
        F.when(fine, F.coalesce("m.application._networkSecurityConfig", F.lit(""))).alias("network_security_config"),
        F.when(fine, F.transform(each_of(F.col("m.permission")), lambda p: F.struct(p["_name"].alias("name"), p["_protectionLevel"].alias("protection_level")))).alias("custom_permissions"),
        F.when(fine, F.concat(*(components(k) for k in ("activity", "service", "receiver", "provider")))).alias("components"),
    )


def declared_rules(manifests: DataFrame) -> DataFrame:
    """(app_id, name, rule_id): permissions of an app's own that any app gets, activities that another app may cover, and
    links of custom schemes that take log-ins; of manifests as parsed gives them."""
    own = manifests.select("app_id", F.explode("custom_permissions").alias("p"))
    weak = F.coalesce(F.lower("p.protection_level"), F.lit("normal"))
    normal = own.where(F.contains(weak, F.lit("normal")) | (weak == "")).select("app_id", F.col("p.name").alias("name"), F.lit("MANIFEST_CUSTOM_PERMISSION_NORMAL").alias("rule_id"))
    open_activity = F.exists("components", lambda c: c["kind"] == "activity")
    covered = manifests.where(F.col("target_sdk").between(1, 22) & open_activity).select("app_id", F.lit("").alias("name"), F.lit("MANIFEST_TAPJACKING_RISK").alias("rule_id"))
    links = manifests.select("app_id", F.explode("components").alias("c")).where("c.kind != 'provider'").select("app_id", F.col("c.name").alias("name"), F.explode("c.deep_links").alias("l"))
    words = "|".join(android.LOGIN_WORDS)
    taken = links.where(F.lower("l.scheme").rlike(words) | F.lower("l.host").rlike(words)).select("app_id", "name", F.lit("DEEPLINK_OAUTH_HIJACK").alias("rule_id"))
    return normal.unionByName(covered).unionByName(taken)


def manifest_rules(manifests: DataFrame) -> DataFrame:
    """(app_id, rule_id) for the flags of manifests and what their permissions say together."""
    has = lambda p: F.array_contains("permissions", f"android.permission.{p}")
    flags = tagged(manifests, [
        ("MANIFEST_DEBUGGABLE", F.col("debuggable")),
        ("MANIFEST_CLEARTEXT", F.col("uses_cleartext_traffic")),
        ("STORAGE_BACKUP_ENABLED", F.col("allow_backup")),
        ("MANIFEST_NSC_MISSING", F.coalesce("network_security_config", F.lit("")) == ""),
        ("MANIFEST_TARGET_SDK_LOW", F.col("target_sdk").between(1, 29)),
        ("PRIVACY_LOCATION_BACKGROUND", has("ACCESS_BACKGROUND_LOCATION")),
        ("PRIVACY_NETWORK_STATE_COMBINED", has("ACCESS_NETWORK_STATE") & has("ACCESS_FINE_LOCATION")),
    ]).select("app_id", "rule_id")
    perms = dangerous(manifests).where("data is not null").select("app_id", F.concat(F.lit("PRIVACY_PERM_"), F.substring_index("permission", ".", -1)).alias("rule_id"))
    return flags.unionByName(perms).unionByName(component_rules(manifests).select("app_id", "rule_id"))


def component_rules(manifests: DataFrame) -> DataFrame:
    """(app_id, name, rule_id) for exported components without a permission, and unprotected custom schemes."""
    each = manifests.select("app_id", F.explode("components").alias("c")).select("app_id", "c.*")
    open_ = F.col("exported") & (F.coalesce("permission", F.lit("")) == "")
    schemes = F.transform("deep_links", lambda x: x["scheme"])
    custom = F.size(F.array_except(schemes, F.array(F.lit("http"), F.lit("https"), F.lit("")))) > 0
    web = F.size(F.array_intersect(schemes, F.array(F.lit("http"), F.lit("https")))) > 0
    return tagged(each, [
        ("MANIFEST_EXPORTED_ACTIVITY", open_ & (F.col("kind") == "activity")),
        ("MANIFEST_EXPORTED_SERVICE", open_ & (F.col("kind") == "service")),
        ("MANIFEST_EXPORTED_BROADCASTRECEIVER", open_ & (F.col("kind") == "receiver")),
        ("MANIFEST_EXPORTED_CONTENTPROVIDER", open_ & (F.col("kind") == "provider")),
        ("MANIFEST_PROVIDER_GRANT_URI", (F.col("kind") == "provider") & F.col("grant_uri_permissions") & open_),
        ("DEEPLINK_UNPROTECTED", custom & (F.coalesce("permission", F.lit("")) == "") & F.col("kind").isin("activity", "service")),
        ("DEEPLINK_MIXED_SCHEMES", custom & web),
    ]).select("app_id", "name", "rule_id")
