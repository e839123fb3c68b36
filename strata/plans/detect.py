"""Queries of the method-level detectors over a view of instructions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.catalogues import detectors as fixed
from strata.operators import detectors
from strata.plans.views import VIEWS, view

#: Instructions by eight kinds of methods, twelve of each: (kind, ref, text, num).
_S, _N, _I = "const-string", "const", "invoke"
SNIPPETS = (
    (_S, None, "DES/CBC/PKCS5Padding", None), (_S, None, "AES/ECB/PKCS5Padding", None), (_S, None, "AES/CBC/NoPadding", None), (_S, None, "MD5", None),
    (_S, None, "AES/GCM/NoPadding", None), (_S, None, "sha-1", None), (_I, "Ljavax/crypto/Cipher;->getInstance(Ljava/lang/String;)", None, None),
    (_I, "Ljavax/crypto/Cipher;->getInstance(Ljava/lang/String;)", None, None), (_I, "Ljava/security/MessageDigest;->getInstance(Ljava/lang/String;)", None, None),
    (_I, "Ljava/util/Random;-><init>()V", None, None), (_I, "Ljava/util/Random;->nextInt()I", None, None), (_S, None, "AndroidKeyStore", None),
    (_S, None, "RSA", None), (_S, None, "AES", None), (_S, None, "AndroidKeyStore", None), ("new-array", None, None, None), ("fill-array-data", None, None, None),
    (_I, "Ljavax/crypto/spec/SecretKeySpec;-><init>([B)V", None, None), (_I, "Ljavax/crypto/spec/IvParameterSpec;-><init>([B)V", None, None),
    (_I, "Ljava/security/KeyPairGenerator;->initialize(I)V", None, 1024), (_I, "Ljavax/crypto/KeyGenerator;->init(I)V", None, 112),
    (_I, "Ljavax/crypto/KeyGenerator;->getInstance(Ljava/lang/String;)", None, None), (_I, "Ljava/security/KeyPairGenerator;->getInstance(Ljava/lang/String;)", None, None),
    (_I, "Ljava/security/KeyPairGenerator;->initialize(I)V", None, 4096),
    (_S, None, "TLSv1", None), (_S, None, "TLSv1.2", None), (_I, "Ljavax/net/ssl/SSLContext;->getInstance(Ljava/lang/String;)", None, None),
    ("sget", "Lorg/apache/http/conn/ssl/SSLSocketFactory;->ALLOW_ALL_HOSTNAME_VERIFIER", None, None), (_I, "Lcom/app/TrustAllCerts;-><init>()V", None, None),
    (_I, "Lokhttp3/OkHttpClient$Builder;->hostnameVerifier(Ljavax/net/ssl/HostnameVerifier;)", None, None), (_I, "Lokhttp3/CertificatePinner$Builder;->add()", None, None),
    (_I, "Lretrofit2/Retrofit$Builder;->client(Lokhttp3/OkHttpClient;)", None, None), ("throw", None, None, None), ("new-instance", "Ljava/security/cert/CertificateException;", None, None),
    (_I, "Ljavax/net/ssl/SSLContext;->getInstance(Ljava/lang/String;)", None, None), ("return-void", None, None, None),
    (_S, None, "password", None), (_S, None, "true", None), (_S, None, "create table t (token text)", None), (_S, None, "theme", None),
    (_I, "Landroid/content/Context;->openFileOutput(Ljava/lang/String;I)", None, 1), (_I, "Landroid/content/Context;->openFileOutput(Ljava/lang/String;I)", None, 0),
    (_I, "Landroid/os/Environment;->getExternalStorageDirectory()", None, None), (_I, "Landroid/content/Context;->getExternalFilesDirs()", None, None),
    (_I, "Landroid/content/SharedPreferences$Editor;->putString(Ljava/lang/String;Ljava/lang/String;)", None, None), (_I, "Landroid/database/sqlite/SQLiteDatabase;->execSQL(Ljava/lang/String;)", None, None),
    (_I, "Lnet/sqlcipher/database/SQLiteDatabase;->open()", None, None), (_I, "Landroid/content/SharedPreferences$Editor;->putString(Ljava/lang/String;Ljava/lang/String;)", None, None),
    (_N, None, None, 0), (_N, None, None, 1), (_S, None, "http://example.com/start", None), (_I, "Landroid/webkit/WebSettings;->setJavaScriptEnabled(Z)V", None, None),
    (_I, "Landroid/webkit/WebView;->addJavascriptInterface(Ljava/lang/Object;Ljava/lang/String;)V", None, None), (_I, "Landroid/webkit/WebSettings;->setAllowFileAccess(Z)V", None, None),
    (_I, "Landroid/webkit/WebSettings;->setAllowUniversalAccessFromFileURLs(Z)V", None, None), (_I, "Landroid/webkit/WebSettings;->setAllowContentAccess(Z)V", None, None),
    (_I, "Landroid/webkit/WebSettings;->setMixedContentMode(I)V", None, None), (_I, "Landroid/webkit/WebView;->setWebContentsDebuggingEnabled(Z)V", None, None),
    (_I, "Landroid/webkit/WebView;->loadUrl(Ljava/lang/String;)V", None, None), (_S, None, ":android:show_fragment", None),
    (_I, "Landroid/content/Context;->sendStickyBroadcast(Landroid/content/Intent;)V", None, None), (_I, "Landroid/app/PendingIntent;->getActivity(Landroid/content/Context;)", None, None),
    (_N, None, None, 67108864), (_I, "Landroid/content/Intent;->getParcelableExtra(Ljava/lang/String;)", None, None), (_I, "Landroid/app/Activity;->startActivity(Landroid/content/Intent;)", None, None),
    (_I, "Landroid/app/Activity;->getIntent()", None, None), (_S, None, "user email", None), (_S, None, "plain words", None), (_I, "Landroid/util/Log;->d(Ljava/lang/String;)I", None, None),
    (_I, "Landroid/util/Log;->e(Ljava/lang/String;)I", None, None), (_I, "Ljava/io/PrintStream;->println(Ljava/lang/String;)V", None, None), (_I, "Ljava/lang/Exception;->printStackTrace()V", None, None),
    (_S, None, "com.google.Safe", None), (_S, None, "com.evil.Unsafe", None), (_S, None, "/sdcard/plugin.dex", None), (_I, "Ljava/lang/Class;->forName(Ljava/lang/String;)", None, None),
    (_I, "Ljava/lang/reflect/Method;->invoke(Ljava/lang/Object;)", None, None), (_I, "Ldalvik/system/DexClassLoader;-><init>()V", None, None), (_I, "Ljava/lang/System;->loadLibrary(Ljava/lang/String;)V", None, None),
    (_I, "Ljava/lang/Runtime;->load(Ljava/lang/String;)V", None, None), (_I, "Ljava/lang/reflect/Proxy;->newProxyInstance()", None, None), (_I, "Ljava/lang/System;->load(Ljava/lang/String;)V", None, None),
    (_I, "Lcom/google/android/gms/ads/identifier/AdvertisingIdClient;->getAdvertisingIdInfo()", None, None), (_S, None, "library", None),
    (_S, None, "/system/xbin/su", None), (_S, None, "Genymotion", None), (_S, None, "frida-server", None), (_S, None, "de.robv.android.xposed.X", None), (_S, None, "/proc/self/maps", None), (_S, None, "5037", None),
    (_I, "Landroid/os/Debug;->isDebuggerConnected()Z", None, None), (_I, "Landroid/os/Debug;->waitingForDebugger()Z", None, None), ("sget", "Landroid/content/pm/PackageManager;->GET_SIGNATURES", None, None),
    (_I, "Lcom/google/android/play/core/integrity/IntegrityManager;->request()", None, None), (_I, "Landroid/webkit/WebView;->evaluateJavascript(Ljava/lang/String;)V", None, None), (_S, None, "http://example.com/next", None),
)
CLASSES = ("Lcom/app/Main;", "Lcom/app/net/Client;", "Lcom/app/util/Logger;", "Lretrofit2/Invoker;", "Lcom/app/ui/Screen;", "Lorg/mockito/Mock;", "Lcom/squareup/Picker;")
METHODS = ("run", "checkServerTrusted", "onCreate", "checkClientTrusted", "load")


def _pick(index: str, column: int) -> str:
    """A CASE over the snippets that have a value there, null for the others."""
    one = lambda x: str(x) if isinstance(x, int) else "'" + x + "'"
    return f"case {index} " + " ".join(f"when {i} then {one(s[column])}" for i, s in enumerate(SNIPPETS) if s[column] is not None) + " end"


def _of(expression: str, values) -> str:
    return f"case {expression} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


VIEWS["code"] = (
    "lineitem",
    f"""select method, pos, {_of(f'method % {len(CLASSES)}', CLASSES)} as class_name, {_of('method % 5', METHODS)} as method_name, {_pick('snippet', 0)} as kind, {_pick('snippet', 1)} as ref,
        {_pick('snippet', 2)} as text, cast({_pick('snippet', 3)} as int) as num, dst, arg1, arg2 from (select l_orderkey as method,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as pos,
        cast((l_orderkey % 8) * 12 + (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 12 as int) as snippet,
        cast(l_suppkey % 2 as int) as dst, cast(l_partkey % 2 as int) as arg1, cast(l_linenumber % 2 as int) as arg2 from lineitem) t""",
)

_POOL = "pool as (select method, dst, arg_max(text, pos) as text from code where kind = 'const-string' group by method, dst)"
_FACTS = "facts as (select c.*, coalesce(c.ref, c.text, '') as raw, p.text as s1, q.text as s2 from code c left join pool p on p.method = c.method and p.dst = c.arg1 left join pool q on q.method = c.method and q.dst = c.arg2)"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _has(column: str, *parts: str) -> str:
    return "(" + " or ".join(f"contains({column}, {_quoted(p)})" for p in parts) + ")"


def _calls(*parts: str) -> str:
    return f"(kind = 'invoke' and {_has('ref', *parts)})"


def _among(column: str, values) -> str:
    return f"{column} in ({', '.join(map(_quoted, values))})"


def _any(test: str) -> str:
    """Whether a string x.text of the method's registers meets a test."""
    return f"exists (select 1 from pool x where x.method = f.method and {test})"


def _somewhere(test: str) -> str:
    """Whether an instruction y of the method meets a test."""
    return f"exists (select 1 from facts y where y.method = f.method and {test})"


def _rules(*rules: tuple[str, str, str, str]) -> str:
    """SQL for rules (rule_id, severity, confidence, condition); the middle two are SQL expressions or names."""
    text = lambda x: x if x.startswith("case") else f"'{x}'"
    each = [f"select method, pos, '{r}' as rule_id, {text(s)} as severity, {text(c)} as confidence from facts f where {test}" for r, s, c, test in rules]
    return f"with code as ({VIEWS['code'][1]}), {_POOL}, {_FACTS} " + "\nunion all ".join(each)


QUERIES, SQL = {}, {}


def _query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_CIPHER = _calls("Ljavax/crypto/Cipher;->getInstance") + " and s1 is not null and "
_PART = "trim(string_split(upper(s1), '/')[{}])"
_BY_STRING = "case when starts_with(s1, '" + "') or starts_with(s1, '".join(fixed.SAFE_CLASS_NAMES) + "') then 'LOW' else 'MEDIUM' end"


@_query(
    _rules(
        ("CRYPTO_WEAK_ALGORITHM", "HIGH", "HIGH", _CIPHER + _among(_PART.format(1), fixed.WEAK_CIPHERS)),
        ("CRYPTO_ECB_MODE", "HIGH", "HIGH", _CIPHER + _PART.format(2) + " = 'ECB'"),
        ("CRYPTO_NO_PADDING", "HIGH", "HIGH", _CIPHER + _PART.format(2) + " = 'CBC' and " + _PART.format(3) + " = 'NOPADDING'"),
        ("CRYPTO_WEAK_HASH", "MEDIUM", "HIGH", _calls("MessageDigest;->getInstance") + " and " + _among("replace(upper(s1), '-', '')", fixed.WEAK_HASHES)),
        ("CRYPTO_CONSTANT_KEY", "HIGH", "MEDIUM", _calls("SecretKeySpec;-><init>") + " and not " + _somewhere(_has("y.raw", *fixed.KEYSTORE_PROVIDERS))),
        ("CRYPTO_INSECURE_RANDOM", "MEDIUM", "MEDIUM", _calls("Ljava/util/Random;-><init>", "Ljava/util/Random;->next")),
        ("CRYPTO_STATIC_IV", "HIGH", "MEDIUM", _calls("IvParameterSpec;-><init>") + " and " + _somewhere("y.kind in ('new-array', 'fill-array-data') and y.pos < f.pos and y.dst in (f.arg1, f.arg2)")),
        ("CRYPTO_KEYSTORE_BYPASS", "MEDIUM", "LOW", _calls("KeyGenerator;->getInstance", "KeyPairGenerator;->getInstance") + " and s1 <> ''"),
    )
)
def crypto_detectors(spark: SparkSession, d: str) -> DataFrame:
    return detectors.crypto(view(spark, d, "code"))


_SIZES = "(values " + ", ".join(f"('{a}', {n}, {i})" for i, (a, n) in enumerate(fixed.MIN_KEY_SIZE)) + ") as m(name, least, i)"


@_query(
    f"""with code as ({VIEWS['code'][1]}), {_POOL}, {_FACTS}, mins as (select * from {_SIZES}),
        own as (select method, arg_min(least, dst * 100 + i) as least from pool join mins on contains(upper(text), name) group by method),
        made as (select class_name, s1, arg_min(least, i) as least from facts join mins on contains(upper(s1), name) where {_calls("KeyPairGenerator;->getInstance", "KeyGenerator;->getInstance")} group by class_name, s1),
        index as (select class_name, arg_min(least, s1) as least from made group by class_name)
        select f.method, pos, 'CRYPTO_SMALL_KEY' as rule_id, 'HIGH' as severity, 'MEDIUM' as confidence from facts f left join own using (method) left join index on index.class_name = f.class_name
        where {_calls("KeyPairGenerator;->initialize", "KeyGenerator;->init")} and num between 64 and 16384 and num < coalesce(own.least, index.least, 2048)"""
)
def crypto_small_keys(spark: SparkSession, d: str) -> DataFrame:
    return detectors.small_keys(view(spark, d, "code"))


@_query(
    _rules(
        ("NETWORK_SSL_DISABLED", "CRITICAL", "HIGH", _has("raw", *fixed.ALLOW_ALL_VERIFIERS)),
        ("NETWORK_SSL_DISABLED", "CRITICAL", "MEDIUM", f"({_has('raw', *fixed.TRUST_ALL)} or {_has('raw', 'SSLSocketFactory')} and {_has('raw', 'setSocketFactory')})"),
        ("NETWORK_OKHTTP_CUSTOM_VERIFIER", "HIGH", "MEDIUM", _has("raw", "Lokhttp3/OkHttpClient$Builder;->hostnameVerifier")),
        ("NETWORK_OKHTTP_CERT_PINNER", "INFO", "HIGH", _has("raw", "Lokhttp3/CertificatePinner")),
        ("NETWORK_WEAK_TLS", "HIGH", "HIGH", _has("raw", "Ljavax/net/ssl/SSLContext;->getInstance") + " and " + _among("lower(s1)", fixed.WEAK_TLS)),
        ("NETWORK_RETROFIT_VERIFY", "INFO", "LOW", _has("raw", "Lretrofit2/Retrofit$Builder;->client", "Lretrofit2/Retrofit$Builder;->callFactory")),
    )
)
def network_detectors(spark: SparkSession, d: str) -> DataFrame:
    return detectors.network(view(spark, d, "code"))


@_query(
    f"with code as ({VIEWS['code'][1]}) select distinct method, 'NETWORK_TRUSTMANAGER_STUB' as rule_id from code c where method_name in ('checkServerTrusted', 'checkClientTrusted')"
    " and not exists (select 1 from code y where y.method = c.method and (y.kind = 'throw' or contains(coalesce(y.ref, y.text, ''), 'CertificateException')))"
)
def trust_stub_methods(spark: SparkSession, d: str) -> DataFrame:
    return detectors.trust_stubs(view(spark, d, "code"))


@_query(
    _rules(
        ("STORAGE_WORLD_READABLE", "HIGH", "HIGH", _has("raw", "openFileOutput") + " and num in (1, 2)"),
        *(("STORAGE_EXTERNAL_PUBLIC", "HIGH", "MEDIUM", _has("raw", m)) for m in fixed.EXTERNAL_PUBLIC),
        *(("STORAGE_EXTERNAL_ISOLATED", "LOW", "MEDIUM", _has("raw", m)) for m in fixed.EXTERNAL_ISOLATED),
        ("STORAGE_PREFS_PLAINTEXT", "HIGH", "HIGH", _has("raw", "SharedPreferences$Editor") + f" and regexp_matches(s1, {_quoted(fixed.SENSITIVE_KEY)}) and coalesce(lower(s2), '') not in ('true', 'false', '0', '1', 'null')"),
        ("STORAGE_SQLITE_PLAINTEXT", "MEDIUM", "MEDIUM", _has("raw", "execSQL", "rawQuery") + f" and regexp_matches(s1, {_quoted(fixed.SENSITIVE_KEY)}) and not " + _somewhere(_has("y.raw", *fixed.ENCRYPTED_DATABASES))),
    )
)
def storage_detectors(spark: SparkSession, d: str) -> DataFrame:
    return detectors.storage(view(spark, d, "code"))


_SET = "(select arg_max(y.num, y.pos) from facts y where y.method = {0}.method and y.kind = 'const' and y.dst = {0}.arg1 and y.pos < {0}.pos and y.num is not null)"
_ON = f"coalesce({_SET}, 1) <> 0".format("f")
_ON_Y = "coalesce((select arg_max(z.num, z.pos) from facts z where z.method = y.method and z.kind = 'const' and z.dst = y.arg1 and z.pos < y.pos), 1) <> 0"
_CONTENT = _somewhere("contains(y.ref, 'setAllowContentAccess') and " + _ON_Y)


@_query(
    _rules(
        ("WEBVIEW_JS_INTERFACE", "CRITICAL", "HIGH", _calls("addJavascriptInterface")),
        ("WEBVIEW_FILE_ACCESS", "case when contains(ref, 'Universal') then 'CRITICAL' else 'HIGH' end", "MEDIUM", _calls("setAllowFileAccess", "setAllowUniversalAccessFromFileURLs") + " and " + _ON),
        ("WEBVIEW_MIXED_CONTENT", "HIGH", "HIGH", _calls("setMixedContentMode") + " and " + _SET.format("f") + " = 0"),
        ("WEBVIEW_REMOTE_DEBUG", "MEDIUM", "HIGH", _calls("setWebContentsDebuggingEnabled") + " and " + _ON),
        ("WEBVIEW_UNSAFE_LOAD", "HIGH", "HIGH", _calls("Landroid/webkit/WebView;->loadUrl") + " and starts_with(s1, 'http://')"),
        ("WEBVIEW_JS_ENABLED", f"case when {_CONTENT} then 'MEDIUM' else 'LOW' end", "MEDIUM", "pos = (select max(y.pos) from facts y where y.method = f.method) and "
            + _somewhere("contains(y.ref, 'setJavaScriptEnabled') and " + _ON_Y) + " and not " + _somewhere("contains(y.ref, 'addJavascriptInterface')")),
    )
)
def webview_detectors(spark: SparkSession, d: str) -> DataFrame:
    return detectors.webview(view(spark, d, "code"))


@_query(
    _rules(
        ("INTENT_STICKY_BROADCAST", "MEDIUM", "HIGH", _has("raw", *(f"->{m}(" for m in fixed.STICKY_METHODS))),
        ("INTENT_PENDING_MUTABLE", "HIGH", "MEDIUM", _has("raw", "Landroid/app/PendingIntent;->") + " and " + _has("raw", *(f"->{m}(" for m in fixed.PENDING_INTENT_METHODS)) + " and not " + _somewhere(f"({_has('y.raw', *fixed.FLAG_IMMUTABLE)} or coalesce(y.num, 0) = 67108864)")),
        ("INTENT_GET_PARCELABLE_UNCHECKED", "MEDIUM", "HIGH", _has("raw", "->getParcelableExtra(Ljava/lang/String;)")),
        ("INTENT_REDIRECTION", "HIGH", "LOW", _has("raw", "->startActivity(Landroid/content/Intent;)") + " and " + _somewhere(_has("y.raw", "getIntent()", "getParcelableExtra"))),
    )
)
def intent_detectors(spark: SparkSession, d: str) -> DataFrame:
    return detectors.intents(view(spark, d, "code"))


_LEVEL = f"regexp_extract(raw, {_quoted(fixed.LOG_METHOD)}, 1)"
_SECRET = _any(f"length(x.text) >= 4 and length(x.text) < 200 and regexp_matches(x.text, {_quoted(fixed.SENSITIVE_WORD)})")
_OUT, _TRACE = (f"regexp_matches({{}}raw, {_quoted(p)})" for p in (fixed.SYSTEM_OUT, fixed.PRINT_STACKTRACE))
_KEPT = f"not contains(class_name, 'Logger') and not contains(class_name, 'Logging') and not {_somewhere(f'y.pos < f.pos and ({_OUT.format("y.")} or {_TRACE.format("y.")})')} and "


@_query(
    _rules(
        ("LOG_SENSITIVE_LITERAL", f"case {_LEVEL} " + " ".join(f"when '{k}' then '{v}'" for k, v in fixed.LOG_SEVERITIES) + " end", "MEDIUM", f"{_KEPT}{_LEVEL} <> '' and {_SECRET}"),
        ("LOG_VERBOSE_DEBUG", "LOW", "LOW", f"{_KEPT}{_LEVEL} in ('v', 'd') and not {_SECRET}"),
        ("LOG_SYSTEM_OUT", "LOW", "HIGH", _KEPT + _OUT.format("f.")),
        ("LOG_PRINT_STACKTRACE", "LOW", "HIGH", _KEPT + _TRACE.format("f.")),
    )
)
def log_detectors(spark: SparkSession, d: str) -> DataFrame:
    return detectors.logs(view(spark, d, "code"))


_OWN = "not (" + " or ".join(f"starts_with(class_name, '{p}')" for p in fixed.FRAMEWORK_HOSTS) + ") and "
_BAD = _any(f"regexp_matches(x.text, {_quoted(fixed.SUSPICIOUS_PATH)})")
_RUNTIME = "(contains(ref, 'Runtime;->load') and not contains(ref, 'loadLibrary'))"


@_query(
    _rules(
        ("OBFUSC_REFLECTION_CLASS", "MEDIUM", _BY_STRING, _OWN + _calls("Ljava/lang/Class;->forName")),
        ("OBFUSC_REFLECTION_INVOKE", "MEDIUM", "MEDIUM", _OWN + _calls("Ljava/lang/reflect/Method;->invoke")),
        ("OBFUSC_DYNAMIC_DEX", f"case when {_BAD} then 'CRITICAL' else 'HIGH' end", f"case when {_BAD} then 'HIGH' else 'MEDIUM' end", _OWN + _calls(*fixed.CLASS_LOADERS)),
        ("OBFUSC_LOAD_LIBRARY", f"case when {_RUNTIME} then 'MEDIUM' else 'LOW' end", f"case when {_RUNTIME} then 'MEDIUM' else 'LOW' end", _OWN + _calls("Ljava/lang/System;->loadLibrary", "Ljava/lang/Runtime;->load")),
        ("OBFUSC_DYNAMIC_PROXY", "LOW", "LOW", _OWN + _calls("Ljava/lang/reflect/Proxy;->newProxyInstance") + " and not (" + " or ".join(f"starts_with(class_name, '{p}')" for p in fixed.PROXY_HOSTS) + ")"),
        ("NATIVE_SUSPICIOUS_RUNTIME", "HIGH", "HIGH", _calls("Ljava/lang/Runtime;->load(", "Ljava/lang/System;->load(") + " and " + _any("(" + " or ".join(f"starts_with(x.text, '{p}')" for p in fixed.WRITABLE_PATHS) + ")")),
        ("PRIVACY_ADVERTISING_ID", "MEDIUM", "HIGH", _calls("getAdvertisingId")),
    )
)
def obfuscation_detectors(spark: SparkSession, d: str) -> DataFrame:
    return detectors.obfuscation(view(spark, d, "code"))


def _holds(*tokens: str) -> str:
    return "kind = 'const-string' and " + _any(_has("lower(x.text)", *tokens))


@_query(
    "select method, min(pos) as pos, rule_id, severity, confidence from ("
    + _rules(
        ("ANTIANALYSIS_ROOT_CHECK", "LOW", "MEDIUM", f"({_holds(*fixed.ROOT_STRINGS)} or kind = 'const-string' and {_any(f'regexp_matches(x.text, {_quoted(fixed.ROOT_FILE)})')})"),
        ("ANTIANALYSIS_EMULATOR_CHECK", "MEDIUM", "MEDIUM", _holds(*fixed.EMULATOR_STRINGS)),
        ("ANTIANALYSIS_FRIDA_DETECT", "MEDIUM", "HIGH", _holds(*fixed.FRIDA_STRINGS)),
        ("ANTIANALYSIS_HOOK_DETECT", "LOW", "HIGH", _holds(*fixed.HOOK_STRINGS)),
        ("ANTIANALYSIS_PROC_CHECK", "MEDIUM", "HIGH", _holds(*fixed.PROC_STRINGS)),
        ("ANTIANALYSIS_PORT_SCAN", "MEDIUM", "MEDIUM", _holds(*fixed.PORT_STRINGS)),
        ("ANTIANALYSIS_DEBUGGER_CHECK", "LOW", "HIGH", _has("raw", "isDebuggerConnected")),
        ("ANTIANALYSIS_DEBUGGER_WAIT", "LOW", "HIGH", _has("raw", "waitingForDebugger")),
        ("ANTIANALYSIS_PACKAGE_TAMPER", "LOW", "HIGH", _has("raw", "GET_SIGNATURES", "GET_SIGNING_CERTIFICATES")),
        ("ANTIANALYSIS_INTEGRITY_API", "INFO", "LOW", _has("raw", "SafetyNet", "Integrity")),
    )
    + ") t group by method, rule_id, severity, confidence"
)
def _anti(spark: SparkSession, d: str) -> DataFrame:
    return detectors.anti_analysis(view(spark, d, "code"))


QUERIES["anti_analysis_detectors"] = QUERIES.pop("_anti")
SQL["anti_analysis_detectors"] = f"select method, pos, case rule_id when 'ANTIANALYSIS_DEBUGGER_WAIT' then 'ANTIANALYSIS_DEBUGGER_CHECK' else rule_id end as rule_id, severity, confidence from ({SQL.pop('_anti')}) u"


@_query(
    f"with code as ({VIEWS['code'][1]}), hits as (select method, class_name, pos, 'DEEPLINK_FRAGMENT_INJECTION' as rule_id, class_name as key from code where kind = 'const-string' and {_among('text', fixed.FRAGMENT_EXTRAS)}"
    f" union all select method, class_name, pos, 'DEEPLINK_JS_BRIDGE_ABUSE', class_name from code where {_calls(*fixed.JS_BRIDGES)}"
    " union all select method, class_name, pos, 'DEEPLINK_SCHEME_DOWNGRADE', text from code where kind = 'const-string' and starts_with(lower(text), 'http://'))"
    " select method, class_name, rule_id, key, min(pos) as pos from hits group by method, class_name, rule_id, key"
)
def deep_link_code(spark: SparkSession, d: str) -> DataFrame:
    return detectors.deep_links(view(spark, d, "code"))
