"""Catalogues of the scoring: categories, vectors, profiles and behaviours."""

#: Patterns of classes that belong to libraries.
LIBRARY_CLASSES = (
    '^Lcom/google/(?!android/gms/ads)',
    '^Lcom/facebook/',
    '^Lcom/squareup/',
    '^Lokhttp3/',
    '^Lretrofit2/',
    '^Lio/reactivex[23]?/',
    '^Lorg/apache/',
    '^Lcom/amazonaws/',
    '^Lkotlinx?/',
    '^Lcom/bumptech/glide/',
    '^Lcom/github/',
    '^Lcom/airbnb/',
    '^Lcom/jakewharton/',
    '^Lio/github/',
    '^Lorg/greenrobot/',
    '^Lcom/mixpanel/',
    '^Lcom/amplitude/',
    '^Lcom/segment/',
    '^Lcom/bugsnag/',
    '^Lio/sentry/',
    '^Lcom/crashlytics/',
    '^Lcom/google/firebase/(?!database|firestore|storage)',
    '^Ldagger/',
    '^Lhilt_aggregated_deps/',
    '^Lorg/junit/',
    '^Lorg/mockito/',
    '^Landroidx/test/',
)

#: Rules whose confidence stays.
NEVER_DOWNGRADED = (
    'CRYPTO_CONSTANT_KEY',
    'SECRET_AWS_KEY',
    'SECRET_PRIVATE_KEY_HEADER',
    'NETWORK_SSL_DISABLED',
    'NETWORK_TRUSTMANAGER_STUB',
    'WEBVIEW_JS_INTERFACE',
    'OBFUSC_DYNAMIC_DEX',
)

#: Rules whose confidence is MEDIUM at most.
NOISY = (
    'OBFUSC_REFLECTION_CLASS',
    'OBFUSC_DYNAMIC_PROXY',
    'ANTIANALYSIS_ROOT_CHECK',
    'ANTIANALYSIS_EMULATOR_CHECK',
    'NETWORK_RETROFIT_VERIFY',
    'CRYPTO_KEYSTORE_BYPASS',
)

#: Fixed values: (code, category).
OWASP_NAMES = (
    ('M1', 'M1: Improper Credential Usage'),
    ('M2', 'M2: Inadequate Supply Chain Security'),
    ('M3', 'M3: Insecure Authentication/Authorization'),
    ('M4', 'M4: Insufficient Input/Output Validation'),
    ('M5', 'M5: Insecure Communication'),
    ('M6', 'M6: Inadequate Privacy Controls'),
    ('M7', 'M7: Insufficient Binary Protections'),
    ('M8', 'M8: Security Misconfiguration'),
    ('M9', 'M9: Insecure Data Storage'),
    ('M10', 'M10: Insufficient Cryptography'),
)

#: Fixed values: (rule, code).
OWASP_RULES = (
    ('CRYPTO_CONSTANT_KEY', 'M1'),
    ('OBFUSC_DYNAMIC_DEX', 'M2'),
    ('OBFUSC_LOAD_LIBRARY', 'M2'),
    ('DEEPLINK_UNPROTECTED', 'M3'),
    ('DEEPLINK_OAUTH_HIJACK', 'M3'),
    ('DEEPLINK_NO_AUTO_VERIFY', 'M3'),
    ('DEEPLINK_FRAGMENT_INJECTION', 'M3'),
    ('WEBVIEW_JS_INTERFACE', 'M3'),
    ('DEEPLINK_JS_BRIDGE_ABUSE', 'M4'),
    ('DEEPLINK_SCHEME_DOWNGRADE', 'M4'),
    ('DEEPLINK_WILDCARD_HOST', 'M4'),
    ('DEEPLINK_NO_PATH_CONSTRAINT', 'M4'),
    ('WEBVIEW_MIXED_CONTENT', 'M4'),
    ('MANIFEST_CLEARTEXT', 'M5'),
    ('DEEPLINK_HTTP_SCHEME', 'M5'),
    ('NETWORK_SSL_DISABLED', 'M5'),
    ('NETWORK_TRUSTMANAGER_STUB', 'M5'),
    ('NETWORK_WEAK_TLS', 'M5'),
    ('NETWORK_CLEARTEXT', 'M5'),
    ('NETWORK_NSC_CLEARTEXT', 'M5'),
    ('NETWORK_NSC_DOMAIN_CLEARTEXT', 'M5'),
    ('NETWORK_NSC_USER_CA', 'M5'),
    ('NETWORK_PINNING_MISSING', 'M5'),
    ('NETWORK_PIN_EXPIRY', 'M5'),
    ('NETWORK_OKHTTP_CUSTOM_VERIFIER', 'M5'),
    ('NETWORK_OKHTTP_CERT_PINNER', 'M5'),
    ('NETWORK_RETROFIT_VERIFY', 'M5'),
    ('MANIFEST_DEBUGGABLE', 'M7'),
    ('WEBVIEW_REMOTE_DEBUG', 'M7'),
    ('OBFUSC_REFLECTION_CLASS', 'M7'),
    ('OBFUSC_REFLECTION_INVOKE', 'M7'),
    ('OBFUSC_DYNAMIC_PROXY', 'M7'),
    ('STORAGE_BACKUP_ENABLED', 'M8'),
    ('STORAGE_WORLD_READABLE', 'M8'),
    ('DEEPLINK_MIXED_SCHEMES', 'M8'),
    ('STORAGE_PREFS_PLAINTEXT', 'M9'),
    ('STORAGE_SQLITE_PLAINTEXT', 'M9'),
    ('STORAGE_EXTERNAL_PUBLIC', 'M9'),
    ('STORAGE_EXTERNAL_ISOLATED', 'M9'),
    ('CRYPTO_ECB_MODE', 'M10'),
    ('CRYPTO_WEAK_ALGORITHM', 'M10'),
    ('CRYPTO_WEAK_HASH', 'M10'),
    ('CRYPTO_INSECURE_RANDOM', 'M10'),
    ('CRYPTO_STATIC_IV', 'M10'),
    ('CRYPTO_NO_PADDING', 'M10'),
    ('CRYPTO_SMALL_KEY', 'M10'),
    ('CRYPTO_KEYSTORE_BYPASS', 'M10'),
)

#: Fixed values: (prefix of a rule, code), the first that fits.
OWASP_PREFIXES = (
    ('SECRET_', 'M1'),
    ('SDK_', 'M2'),
    ('TAINT_USER_INPUT_TO_EXEC', 'M4'),
    ('TAINT_USER_INPUT_TO_WEBVIEW', 'M4'),
    ('TAINT_USER_INPUT_TO_SQL', 'M4'),
    ('TAINT_INTENT_TO_EXEC', 'M4'),
    ('TAINT_INTENT_TO_WEBVIEW', 'M4'),
    ('TAINT_CONTENT_URI_TO_SQL', 'M4'),
    ('TAINT_DEEP_LINK_DATA_TO_WEBVIEW', 'M4'),
    ('TAINT_DEEP_LINK_DATA_TO_SQL', 'M4'),
    ('TAINT_DEEP_LINK_DATA_TO_EXEC', 'M4'),
    ('TAINT_DEVICE_ID_TO_NETWORK', 'M5'),
    ('TAINT_LOCATION_TO_NETWORK', 'M5'),
    ('TAINT_ACCOUNT_TO_NETWORK', 'M5'),
    ('TAINT_DEEP_LINK_DATA_TO_NETWORK', 'M5'),
    ('TAINT_DEEP_LINK_DATA_TO_OPEN', 'M5'),
    ('TAINT_CONTENT_URI_TO_OPEN', 'M5'),
    ('TAINT_INTENT_TO_OPEN', 'M5'),
    ('NETWORK_', 'M5'),
    ('TAINT_CONTACT_TO_', 'M6'),
    ('TAINT_LOCATION_TO_', 'M6'),
    ('TAINT_DEVICE_ID_TO_', 'M6'),
    ('TAINT_ACCOUNT_TO_', 'M6'),
    ('TAINT_CLIPBOARD_TO_', 'M6'),
    ('PRIVACY_', 'M6'),
    ('OBFUSC_', 'M7'),
    ('ANTIANALYSIS_', 'M7'),
    ('MANIFEST_EXPORTED_', 'M8'),
    ('MANIFEST_', 'M8'),
    ('DEEPLINK_', 'M8'),
    ('STORAGE_EXTERNAL', 'M8'),
    ('STORAGE_', 'M9'),
    ('TAINT_USER_INPUT_TO_STORAGE', 'M9'),
    ('TAINT_INTENT_TO_STORAGE', 'M9'),
    ('CRYPTO_', 'M10'),
)

#: Fixed values: (category of a finding, code).
OWASP_BY_CATEGORY = (
    ('CRYPTO', 'M10'),
    ('NETWORK', 'M5'),
    ('STORAGE', 'M9'),
    ('SECRETS', 'M1'),
    ('TAINT', 'M6'),
    ('MANIFEST', 'M8'),
    ('WEBVIEW', 'M4'),
    ('OBFUSCATION', 'M7'),
    ('PRIVACY', 'M6'),
    ('SDK', 'M2'),
    ('DEEPLINK', 'M8'),
    ('ANTIANALYSIS', 'M7'),
)

#: Fixed values: (rule, vector).
CVSS_RULES = (
    ('SECRET_AWS_KEY', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H'),
    ('SECRET_AWS_SECRET', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H'),
    ('SECRET_GOOGLE_API_KEY', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:L/A:N'),
    ('SECRET_PRIVATE_KEY_HEADER', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H'),
    ('SECRET_JWT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:L/A:N'),
    ('SECRET_FIREBASE_KEY', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N'),
    ('SECRET_STRIPE_KEY', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N'),
    ('SECRET_SLACK_TOKEN', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:L/A:N'),
    ('SECRET_GITHUB_PAT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:L'),
    ('SECRET_DB_CONN_STRING', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H'),
    ('SECRET_GENERIC_API_KEY', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:L/A:N'),
    ('CRYPTO_ECB_MODE', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N'),
    ('CRYPTO_WEAK_ALGORITHM', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N'),
    ('CRYPTO_WEAK_HASH', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:L/I:H/A:N'),
    ('CRYPTO_CONSTANT_KEY', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:N'),
    ('CRYPTO_INSECURE_RANDOM', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:L/I:L/A:N'),
    ('CRYPTO_STATIC_IV', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N'),
    ('CRYPTO_NO_PADDING', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:L/A:N'),
    ('CRYPTO_SMALL_KEY', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N'),
    ('CRYPTO_KEYSTORE_BYPASS', 'CVSS:3.1/AV:L/AC:H/PR:L/UI:N/S:U/C:H/I:N/A:N'),
    ('NETWORK_CLEARTEXT', 'CVSS:3.1/AV:A/AC:H/PR:N/UI:N/S:U/C:H/I:L/A:N'),
    ('NETWORK_SSL_DISABLED', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:N'),
    ('NETWORK_TRUSTMANAGER_STUB', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:N'),
    ('NETWORK_WEAK_TLS', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:L/A:N'),
    ('NETWORK_NSC_CLEARTEXT', 'CVSS:3.1/AV:A/AC:H/PR:N/UI:N/S:U/C:H/I:L/A:N'),
    ('NETWORK_NSC_DOMAIN_CLEARTEXT', 'CVSS:3.1/AV:A/AC:H/PR:N/UI:R/S:U/C:H/I:L/A:N'),
    ('NETWORK_NSC_USER_CA', 'CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N'),
    ('NETWORK_PINNING_MISSING', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:L/I:L/A:N'),
    ('NETWORK_PIN_EXPIRY', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:L/I:N/A:N'),
    ('NETWORK_OKHTTP_CUSTOM_VERIFIER', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:N'),
    ('NETWORK_OKHTTP_CERT_PINNER', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:N/I:N/A:N'),
    ('NETWORK_RETROFIT_VERIFY', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:L/I:N/A:N'),
    ('STORAGE_WORLD_READABLE', 'CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N'),
    ('STORAGE_PREFS_PLAINTEXT', 'CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N'),
    ('STORAGE_SQLITE_PLAINTEXT', 'CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:L/I:N/A:N'),
    ('STORAGE_EXTERNAL_PUBLIC', 'CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N'),
    ('STORAGE_EXTERNAL_ISOLATED', 'CVSS:3.1/AV:L/AC:H/PR:N/UI:N/S:U/C:L/I:N/A:N'),
    ('STORAGE_BACKUP_ENABLED', 'CVSS:3.1/AV:P/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N'),
    ('MANIFEST_DEBUGGABLE', 'CVSS:3.1/AV:P/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H'),
    ('MANIFEST_CLEARTEXT', 'CVSS:3.1/AV:A/AC:H/PR:N/UI:N/S:U/C:H/I:L/A:N'),
    ('DEEPLINK_UNPROTECTED', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:H/A:N'),
    ('DEEPLINK_HTTP_SCHEME', 'CVSS:3.1/AV:A/AC:H/PR:N/UI:R/S:U/C:H/I:L/A:N'),
    ('DEEPLINK_NO_AUTO_VERIFY', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:N/I:H/A:N'),
    ('DEEPLINK_WILDCARD_HOST', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:H/A:N'),
    ('DEEPLINK_NO_PATH_CONSTRAINT', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:L/A:N'),
    ('DEEPLINK_OAUTH_HIJACK', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:H/A:N'),
    ('DEEPLINK_MIXED_SCHEMES', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:L/A:N'),
    ('DEEPLINK_FRAGMENT_INJECTION', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:N'),
    ('DEEPLINK_JS_BRIDGE_ABUSE', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:N'),
    ('DEEPLINK_SCHEME_DOWNGRADE', 'CVSS:3.1/AV:A/AC:H/PR:N/UI:R/S:U/C:L/I:L/A:N'),
    ('WEBVIEW_JS_INTERFACE', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:H'),
    ('WEBVIEW_FILE_ACCESS', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:N/A:N'),
    ('WEBVIEW_REMOTE_DEBUG', 'CVSS:3.1/AV:P/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N'),
    ('WEBVIEW_UNSAFE_LOAD', 'CVSS:3.1/AV:A/AC:H/PR:N/UI:R/S:U/C:H/I:L/A:N'),
    ('WEBVIEW_MIXED_CONTENT', 'CVSS:3.1/AV:A/AC:H/PR:N/UI:R/S:C/C:H/I:H/A:N'),
    ('WEBVIEW_JS_ENABLED', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:L/A:N'),
    ('OBFUSC_DYNAMIC_DEX', 'CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:C/C:H/I:H/A:L'),
    ('OBFUSC_REFLECTION_INVOKE', 'CVSS:3.1/AV:N/AC:H/PR:L/UI:N/S:U/C:L/I:L/A:N'),
    ('OBFUSC_REFLECTION_CLASS', 'CVSS:3.1/AV:N/AC:H/PR:L/UI:N/S:U/C:L/I:N/A:N'),
    ('OBFUSC_LOAD_LIBRARY', 'CVSS:3.1/AV:L/AC:H/PR:L/UI:N/S:U/C:L/I:L/A:N'),
    ('OBFUSC_DYNAMIC_PROXY', 'CVSS:3.1/AV:N/AC:H/PR:L/UI:N/S:U/C:N/I:L/A:N'),
)

#: Fixed values: (source label, sink label, vector).
CVSS_FLOWS = (
    ('DEVICE_ID', 'NETWORK_OUT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N'),
    ('LOCATION', 'NETWORK_OUT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N'),
    ('ACCOUNT', 'NETWORK_OUT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N'),
    ('CONTACT', 'NETWORK_OUT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N'),
    ('CLIPBOARD', 'NETWORK_OUT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N'),
    ('USER_INPUT', 'EXEC', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H'),
    ('INTENT', 'EXEC', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:H'),
    ('DEEP_LINK_DATA', 'EXEC', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:H'),
    ('INTENT', 'WEBVIEW', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:N'),
    ('USER_INPUT', 'WEBVIEW', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:N'),
    ('DEEP_LINK_DATA', 'WEBVIEW', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:N'),
    ('DEEP_LINK_DATA', 'WEBVIEW_JS_INJECT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:H'),
    ('INTENT', 'SQL_INJECT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:H/A:N'),
    ('USER_INPUT', 'SQL_INJECT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:H/A:N'),
    ('DEEP_LINK_DATA', 'SQL_INJECT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:H/A:N'),
    ('CONTENT_URI', 'SQL_INJECT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:H/A:N'),
    ('DEEP_LINK_DATA', 'OPEN_REDIRECT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:H/A:N'),
    ('DEEP_LINK_DATA', 'DEEPLINK_REDIRECT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:N/I:H/A:N'),
    ('CONTENT_URI', 'OPEN_REDIRECT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:H/A:N'),
    ('INTENT', 'OPEN_REDIRECT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:H/A:N'),
    ('DEEP_LINK_DATA', 'NETWORK_OUT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:N/A:N'),
    ('INTENT', 'FILE_WRITE', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:H/A:N'),
    ('USER_INPUT', 'FILE_WRITE', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:H/A:N'),
    ('DEEP_LINK_DATA', 'FILE_WRITE', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:H/A:N'),
    ('INTENT', 'PENDING_INTENT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:H/A:N'),
    ('USER_INPUT', 'PENDING_INTENT', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:H/A:N'),
    ('DEVICE_ID', 'LOG', 'CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N'),
    ('ACCOUNT', 'LOG', 'CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N'),
    ('LOCATION', 'LOG', 'CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:L/I:N/A:N'),
)

#: Fixed values: (severity, vector).
CVSS_SEVERITIES = (
    ('CRITICAL', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N'),
    ('HIGH', 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N'),
    ('MEDIUM', 'CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:L/I:L/A:N'),
    ('LOW', 'CVSS:3.1/AV:L/AC:H/PR:L/UI:R/S:U/C:L/I:N/A:N'),
    ('INFO', 'CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N'),
)

#: Fixed values: (profile that a rule first belongs to, rule).
PROFILE_RULES = (
    ('L1', 'MANIFEST_DEBUGGABLE'),
    ('L1', 'MANIFEST_CLEARTEXT'),
    ('L1', 'MANIFEST_NSC_MISSING'),
    ('L1', 'MANIFEST_TARGET_SDK_LOW'),
    ('L1', 'MANIFEST_TAPJACKING_RISK'),
    ('L1', 'MANIFEST_CUSTOM_PERMISSION_NORMAL'),
    ('L1', 'MANIFEST_PROVIDER_GRANT_URI'),
    ('L1', 'DEEPLINK_UNPROTECTED'),
    ('L1', 'NETWORK_CLEARTEXT'),
    ('L1', 'NETWORK_SSL_DISABLED'),
    ('L1', 'NETWORK_TRUSTMANAGER_STUB'),
    ('L1', 'NETWORK_OKHTTP_CUSTOM_VERIFIER'),
    ('L1', 'NETWORK_OKHTTP_CERT_PINNER'),
    ('L1', 'NETWORK_RETROFIT_VERIFY'),
    ('L1', 'NETWORK_NSC_CLEARTEXT'),
    ('L1', 'NETWORK_NSC_DOMAIN_CLEARTEXT'),
    ('L1', 'NETWORK_NSC_USER_CA'),
    ('L1', 'NETWORK_PINNING_MISSING'),
    ('L1', 'NETWORK_PIN_EXPIRY'),
    ('L1', 'NETWORK_WEAK_TLS'),
    ('L1', 'CRYPTO_WEAK_ALGORITHM'),
    ('L1', 'CRYPTO_ECB_MODE'),
    ('L1', 'CRYPTO_NO_PADDING'),
    ('L1', 'CRYPTO_CONSTANT_KEY'),
    ('L1', 'CRYPTO_WEAK_HASH'),
    ('L1', 'CRYPTO_KEYSTORE_BYPASS'),
    ('L1', 'CRYPTO_INSECURE_RANDOM'),
    ('L1', 'CRYPTO_STATIC_IV'),
    ('L1', 'CRYPTO_SMALL_KEY'),
    ('L1', 'STORAGE_WORLD_READABLE'),
    ('L1', 'STORAGE_BACKUP_ENABLED'),
    ('L1', 'WEBVIEW_JS_ENABLED'),
    ('L1', 'WEBVIEW_FILE_ACCESS'),
    ('L1', 'WEBVIEW_JS_INTERFACE'),
    ('L1', 'WEBVIEW_MIXED_CONTENT'),
    ('L1', 'WEBVIEW_REMOTE_DEBUG'),
    ('L1', 'WEBVIEW_UNSAFE_LOAD'),
    ('L1', 'INTENT_PENDING_MUTABLE'),
    ('L1', 'INTENT_GET_PARCELABLE_UNCHECKED'),
    ('L1', 'INTENT_REDIRECTION'),
    ('L1', 'INTENT_STICKY_BROADCAST'),
    ('L2', 'PRIVACY_PII_IN_LOG'),
    ('L2', 'PRIVACY_LOCATION_BACKGROUND'),
    ('L2', 'PRIVACY_NETWORK_STATE_COMBINED'),
    ('L2', 'PRIVACY_ADVERTISING_ID'),
    ('L2', 'PRIVACY_CONSENT_MISSING'),
    ('L2', 'LOG_SENSITIVE_LITERAL'),
    ('L2', 'LOG_VERBOSE_DEBUG'),
    ('L2', 'LOG_SYSTEM_OUT'),
    ('L2', 'LOG_PRINT_STACKTRACE'),
    ('L2', 'ANTIANALYSIS_ROOT_CHECK'),
    ('L2', 'ANTIANALYSIS_EMULATOR_CHECK'),
    ('L2', 'ANTIANALYSIS_FRIDA_DETECT'),
    ('L2', 'ANTIANALYSIS_HOOK_DETECT'),
    ('L2', 'ANTIANALYSIS_DEBUGGER_CHECK'),
    ('R', 'ANTIANALYSIS_PROC_CHECK'),
    ('R', 'ANTIANALYSIS_PORT_SCAN'),
    ('R', 'ANTIANALYSIS_PACKAGE_TAMPER'),
    ('R', 'ANTIANALYSIS_INTEGRITY_API'),
)

#: Fixed values: (profile, prefix of rules).
PROFILE_PREFIXES = (
    ('L1', 'MANIFEST_EXPORTED_'),
    ('L1', 'STORAGE_EXTERNAL_'),
    ('L1', 'STORAGE_PREFS_'),
    ('L1', 'STORAGE_SQLITE_'),
    ('L1', 'SECRET_'),
    ('L1', 'DEEPLINK_'),
    ('L1', 'NATIVE_'),
    ('L2', 'TAINT_'),
    ('L2', 'PII_'),
    ('R', 'OBFUSC_'),
)

#: Fixed values: (name, weight, tactic, components: (part of a rule id, category)).
BEHAVIOURS = (
    ('ROOT_DETECT_AND_EXEC', 8, 'TA0004 — Privilege Escalation', (('ANTI_ROOT', ''), ('EXEC', ''))),
    ('STEALTH_INSTALL', 10, 'TA0003 — Persistence', (('HIDE_LAUNCHER', ''), ('PACKAGE_INSTALLER', ''))),
    ('EXFIL_OVER_NETWORK', 6, 'TA0010 — Exfiltration', (('', 'PRIVACY'), ('', 'NETWORK'))),
    ('DYNAMIC_CODE_LOAD', 7, 'TA0005 — Defense Evasion', (('DEX_CLASS_LOADER', ''), ('', 'REFLECTION'))),
    ('CRYPTO_RANSOM_PROFILE', 9, 'TA0040 — Impact', (('HARDCODED_KEY', ''), ('', 'STORAGE'))),
    ('OVERLAY_KEYLOG', 10, 'TA0009 — Collection', (('ACCESSIBILITY', ''), ('OVERLAY', ''))),
    ('SMS_INTERCEPT', 9, 'TA0009 — Collection', (('SMS', ''), ('', 'NETWORK'))),
    ('DEBUG_DETECT_AND_BAIL', 5, 'TA0005 — Defense Evasion', (('ANTI_DEBUG', ''), ('ANTI_EMULATOR', ''))),
)
