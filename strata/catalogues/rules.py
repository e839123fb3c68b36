"""Catalogue of the pattern rules over code text."""

#: Fixed values: (rule, severity, confidence, category, weakness, CVSS, language, multiline, pattern).
RULES = (
    ('CRYPTO_ECB_MODE', 'HIGH', 'HIGH', 'CRYPTO', 'CWE-327', 7.5, 'smali', False, 'Cipher;->getInstance.*"[Aa][Ee][Ss]/[Ee][Cc][Bb]'),
    ('CRYPTO_WEAK_DES', 'HIGH', 'HIGH', 'CRYPTO', 'CWE-327', 7.5, 'smali', False, 'Cipher;->getInstance.*"[Dd][Ee][Ss]'),
    ('CRYPTO_MD5_HASH', 'MEDIUM', 'HIGH', 'CRYPTO', 'CWE-328', 5.3, 'smali', False, 'MessageDigest;->getInstance.*"[Mm][Dd]5"'),
    ('CRYPTO_SHA1_SIGNATURE', 'MEDIUM', 'MEDIUM', 'CRYPTO', 'CWE-328', 5.3, 'smali', False, 'MessageDigest;->getInstance.*"[Ss][Hh][Aa]-?1"'),
    ('CRYPTO_STATIC_SEED_SECRANDOM', 'HIGH', 'MEDIUM', 'CRYPTO', 'CWE-336', 7.5, 'smali', False, 'SecureRandom;->setSeed'),
    ('CRYPTO_RSA_PKCS1_PADDING', 'HIGH', 'HIGH', 'CRYPTO', 'CWE-780', 7.4, 'smali', False, 'Cipher;->getInstance.*"RSA/ECB/PKCS1Padding"'),
    ('CRYPTO_RSA_NO_PADDING', 'HIGH', 'HIGH', 'CRYPTO', 'CWE-780', 7.5, 'smali', False, 'Cipher;->getInstance.*"RSA/.*?/NoPadding"'),
    ('CRYPTO_BLOWFISH', 'MEDIUM', 'HIGH', 'CRYPTO', 'CWE-327', 5.9, 'smali', False, 'Cipher;->getInstance.*"[Bb]lowfish'),
    ('CRYPTO_PBKDF2_LOW_ITERATIONS', 'MEDIUM', 'LOW', 'CRYPTO', 'CWE-916', 5.0, 'smali', False, 'PBKDF2WithHmac|PBEKeySpec.*const/16 v\\d+, 0x[0-9a-f]?[0-9a-f]?[0-9a-f]?\\b'),
    ('CRYPTO_HARDCODED_IV', 'HIGH', 'LOW', 'CRYPTO', 'CWE-329', 6.8, 'smali', False, 'IvParameterSpec;-><init>\\(\\[B\\)V'),
    ('CRYPTO_BC_PROVIDER_KNOWN_BAD', 'MEDIUM', 'LOW', 'CRYPTO', 'CWE-1104', 5.3, 'smali', False, 'Lorg/bouncycastle/jce/provider/BouncyCastleProvider'),
    ('NETWORK_ALLOW_ALL_HOSTNAME', 'CRITICAL', 'HIGH', 'NETWORK', 'CWE-297', 9.1, 'smali', False, 'ALLOW_ALL_HOSTNAME_VERIFIER'),
    ('NETWORK_EMPTY_TRUSTMANAGER', 'CRITICAL', 'MEDIUM', 'NETWORK', 'CWE-295', 9.1, 'smali', False, 'checkServerTrusted'),
    ('NETWORK_SSLV3', 'HIGH', 'HIGH', 'NETWORK', 'CWE-326', 7.4, 'smali', False, 'SSLContext;->getInstance.*"SSLv3"'),
    ('NETWORK_HTTP_URL', 'MEDIUM', 'HIGH', 'NETWORK', 'CWE-319', 6.5, 'smali', False, '"http://'),
    ('NETWORK_TLS10_TLS11_REQUEST', 'HIGH', 'HIGH', 'NETWORK', 'CWE-326', 7.4, 'smali', False, 'SSLContext;->getInstance.*"TLSv1(\\.[01])?"'),
    ('NETWORK_OKHTTP_DEFAULT_HOSTNAME_VERIFIER', 'CRITICAL', 'MEDIUM', 'NETWORK', 'CWE-297', 9.1, 'smali', False, 'OkHttpClient\\$Builder;->hostnameVerifier'),
    ('NETWORK_DISABLE_CERT_PINNING', 'HIGH', 'LOW', 'NETWORK', 'CWE-295', 6.5, 'smali', False, 'CertificatePinner\\$Builder;->build'),
    ('NETWORK_HTTP_RETROFIT_BASE_URL', 'HIGH', 'HIGH', 'NETWORK', 'CWE-319', 7.5, 'smali', False, 'Retrofit\\$Builder;->baseUrl.*"http://'),
    ('NETWORK_NSC_USER_TRUST', 'HIGH', 'HIGH', 'NETWORK', 'CWE-295', 7.5, 'smali', False, '<certificates src="user"'),
    ('STORAGE_WORLD_READABLE', 'HIGH', 'HIGH', 'STORAGE', 'CWE-732', 6.5, 'smali', False, 'openFileOutput'),
    ('STORAGE_SQLITE_NO_ENCRYPTION', 'MEDIUM', 'LOW', 'STORAGE', 'CWE-312', 5.3, 'smali', False, 'SQLiteOpenHelper'),
    ('STORAGE_PREFS_SENSITIVE', 'HIGH', 'HIGH', 'STORAGE', 'CWE-312', 7.5, 'smali', False, 'SharedPreferences\\$Editor;->putString'),
    ('STORAGE_EXTERNAL_DIR', 'HIGH', 'MEDIUM', 'STORAGE', 'CWE-922', 6.5, 'smali', False, 'getExternalStorageDirectory|getExternalStoragePublicDirectory'),
    ('STORAGE_TEMP_FILE_INSECURE', 'MEDIUM', 'LOW', 'STORAGE', 'CWE-377', 5.3, 'smali', False, 'File;->createTempFile'),
    ('STORAGE_BACKUP_ALLOWED', 'MEDIUM', 'LOW', 'STORAGE', 'CWE-200', 4.3, 'smali', False, 'android:allowBackup="true"'),
    ('STORAGE_LOG_TO_FILE', 'LOW', 'LOW', 'STORAGE', 'CWE-532', 3.7, 'smali', False, 'FileWriter;-><init>.*log|"app\\.log"|"debug\\.log"'),
    ('STORAGE_HARDCODED_DB_KEY', 'HIGH', 'MEDIUM', 'STORAGE', 'CWE-798', 7.4, 'smali', False, 'SQLiteDatabase;->openOrCreateDatabase.*const-string'),
    ('WEBVIEW_JS_INTERFACE_RCE', 'CRITICAL', 'HIGH', 'WEBVIEW', 'CWE-749', 9.8, 'smali', False, 'WebView;->addJavascriptInterface'),
    ('WEBVIEW_FILE_ACCESS_UNIVERSAL', 'HIGH', 'HIGH', 'WEBVIEW', 'CWE-200', 7.5, 'smali', False, 'setAllowUniversalAccessFromFileURLs'),
    ('WEBVIEW_DEBUG_ENABLED', 'MEDIUM', 'HIGH', 'WEBVIEW', 'CWE-489', 5.5, 'smali', False, 'setWebContentsDebuggingEnabled'),
    ('WEBVIEW_MIXED_CONTENT_ALWAYS_ALLOW', 'HIGH', 'HIGH', 'WEBVIEW', 'CWE-319', 7.4, 'smali', False, 'setMixedContentMode.*const/4 v\\d+, 0x0'),
    ('WEBVIEW_FILE_ACCESS_FROM_FILE_URLS', 'HIGH', 'HIGH', 'WEBVIEW', 'CWE-200', 7.0, 'smali', False, 'setAllowFileAccessFromFileURLs'),
    ('WEBVIEW_GEOLOCATION_AUTO_GRANT', 'MEDIUM', 'MEDIUM', 'WEBVIEW', 'CWE-280', 5.4, 'smali', False, 'GeolocationPermissions\\$Callback;->invoke\\(Ljava/lang/String;ZZ\\)V'),
    ('WEBVIEW_LOAD_DATA_INJECTION', 'MEDIUM', 'LOW', 'WEBVIEW', 'CWE-79', 5.3, 'smali', False, 'WebView;->loadData(WithBaseURL)?'),
    ('WEBVIEW_USER_AGENT_LEAK', 'MEDIUM', 'LOW', 'WEBVIEW', 'CWE-359', 4.3, 'smali', False, 'WebSettings;->setUserAgentString'),
    ('DANGEROUS_DEX_CLASS_LOADER', 'HIGH', 'MEDIUM', 'OBFUSCATION', 'CWE-94', 7.4, 'smali', False, 'Ldalvik/system/(DexClassLoader|PathClassLoader|InMemoryDexClassLoader)'),
    ('DANGEROUS_RUNTIME_EXEC', 'HIGH', 'MEDIUM', 'GENERAL', 'CWE-78', 7.8, 'smali', False, 'Runtime;->exec'),
    ('DANGEROUS_PROCESSBUILDER', 'HIGH', 'MEDIUM', 'GENERAL', 'CWE-78', 7.8, 'smali', False, 'Ljava/lang/ProcessBuilder;'),
    ('INSECURE_RANDOM', 'MEDIUM', 'LOW', 'CRYPTO', 'CWE-330', 5.3, 'smali', False, 'Ljava/util/Random;-><init>'),
    ('LOG_SENSITIVE_KEYWORD', 'MEDIUM', 'LOW', 'PRIVACY', 'CWE-532', 4.3, 'smali', False, 'Landroid/util/Log;->\\w.*(?i:password|token|secret|jwt|apikey|api_key|authorization)'),
    ('DANGEROUS_SETUSESCONNECT_INSECURE', 'HIGH', 'LOW', 'NETWORK', 'CWE-295', 6.5, 'smali', False, 'setUseInsecure|setSslDisabled|setVerifySsl.*const/4 v\\d+, 0x0'),
    ('DANGEROUS_REFLECTION_INVOKE', 'LOW', 'LOW', 'OBFUSCATION', 'CWE-470', 3.7, 'smali', False, 'Ljava/lang/reflect/Method;->invoke'),
    ('DANGEROUS_NATIVE_LOAD', 'MEDIUM', 'LOW', 'OBFUSCATION', 'CWE-426', 5.5, 'smali', False, 'Ljava/lang/System;->load\\('),
    ('CRYPTO_DSA_LEGACY', 'MEDIUM', 'MEDIUM', 'CRYPTO', 'CWE-327', 5.5, 'smali', False, 'Signature;->getInstance\\(.*"(SHA1withDSA|SHA256withDSA|DSA)"'),
    ('CRYPTO_PBE_DEFAULT_ITERATIONS', 'HIGH', 'MEDIUM', 'CRYPTO', 'CWE-916', 7.0, 'smali', False, 'PBEKeySpec;-><init>\\(\\[C\\[B\\)V'),
    ('CRYPTO_AES_GCM_REUSED_NONCE', 'CRITICAL', 'LOW', 'CRYPTO', 'CWE-323', 9.0, 'smali', True, 'Cipher;->init\\(I.*GCMParameterSpec[\\s\\S]{0,200}goto'),
    ('CRYPTO_RC4_LIBRARY_PRESENT', 'HIGH', 'HIGH', 'CRYPTO', 'CWE-327', 7.5, 'smali', False, 'Cipher;->getInstance\\(.*"(RC4|ARCFOUR)"'),
    ('CRYPTO_NULL_CIPHER', 'CRITICAL', 'HIGH', 'CRYPTO', 'CWE-326', 9.0, 'smali', False, 'Ljavax/crypto/NullCipher;'),
    ('CRYPTO_MAC_NO_KEY', 'MEDIUM', 'LOW', 'CRYPTO', 'CWE-916', 5.5, 'smali', False, 'Mac;->init\\(Ljava/security/Key;\\)V'),
    ('STORAGE_AUTOBACKUP_NO_RULES', 'MEDIUM', 'LOW', 'STORAGE', 'CWE-359', 5.3, 'smali', False, 'android:allowBackup="true"'),
    ('STORAGE_LARGE_HEAP_OPT_IN', 'LOW', 'HIGH', 'STORAGE', 'CWE-789', 3.1, 'smali', False, 'android:largeHeap="true"'),
    ('STORAGE_KEYSTORE_BIO_NOT_BOUND', 'MEDIUM', 'MEDIUM', 'STORAGE', 'CWE-522', 5.3, 'smali', False, 'KeyGenParameterSpec\\$Builder;->setUserAuthenticationRequired\\(Z\\)L'),
    ('STORAGE_INTERNAL_CLEARTEXT_DB', 'MEDIUM', 'MEDIUM', 'STORAGE', 'CWE-311', 5.5, 'smali', False, 'SQLiteDatabase;->open(Or)?(C|c)reateDatabase\\('),
    ('NETWORK_OKHTTP_PINNER_NOOP', 'HIGH', 'MEDIUM', 'NETWORK', 'CWE-295', 7.0, 'smali', True, 'CertificatePinner\\$Builder;-><init>\\(\\)V[\\s\\S]{0,200}CertificatePinner\\$Builder;->build'),
    ('NETWORK_SSL_INSECURE_FACTORY', 'HIGH', 'HIGH', 'NETWORK', 'CWE-326', 7.0, 'smali', False, 'SSLContext;->getInstance\\(.*"(SSL|TLSv1|TLSv1\\.1)"'),
    ('NETWORK_DEFAULT_HOSTNAME_VERIFIER_DISABLED', 'CRITICAL', 'HIGH', 'NETWORK', 'CWE-297', 9.0, 'smali', True, 'HttpsURLConnection;->setDefaultHostnameVerifier[\\s\\S]{0,80}ALLOW_ALL_HOSTNAME_VERIFIER'),
    ('NETWORK_TRUSTMANAGER_X509_EMPTY', 'CRITICAL', 'MEDIUM', 'NETWORK', 'CWE-295', 9.0, 'smali', True, '\\.method.*checkServerTrusted[\\s\\S]{0,80}\\.locals 0[\\s\\S]{0,80}return-void'),
    ('NETWORK_INSECURE_HTTP_CONNECT', 'MEDIUM', 'MEDIUM', 'NETWORK', 'CWE-319', 5.5, 'smali', False, 'const-string[/\\w]* \\w+, "http://[^"]+'),
    ('NETWORK_KTOR_TRUST_ALL', 'HIGH', 'MEDIUM', 'NETWORK', 'CWE-295', 7.5, 'smali', False, 'Lio/ktor/client/engine/[\\w/]+;->setSslContext\\(Ljavax/net/ssl/SSLContext;\\)V'),
    ('WEBVIEW_INTERCEPT_REQUEST_HTTP', 'MEDIUM', 'LOW', 'WEBVIEW', 'CWE-319', 5.0, 'smali', False, 'shouldInterceptRequest.*"http://'),
    ('WEBVIEW_DOM_STORAGE_ENABLED', 'LOW', 'HIGH', 'WEBVIEW', 'CWE-922', 3.5, 'smali', False, 'setDomStorageEnabled\\(Z\\)V'),
    ('WEBVIEW_SET_USERNAME_PASSWORD', 'HIGH', 'HIGH', 'WEBVIEW', 'CWE-256', 7.0, 'smali', False, 'WebView;->setHttpAuthUsernamePassword'),
    ('IPC_SEND_BROADCAST_NO_PERMISSION', 'MEDIUM', 'LOW', 'IPC', 'CWE-925', 5.0, 'smali', False, 'Context;->sendBroadcast\\(Landroid/content/Intent;\\)V'),
    ('IPC_PENDING_INTENT_FLAG_MUTABLE', 'HIGH', 'HIGH', 'IPC', 'CWE-927', 7.0, 'smali', False, 'PendingIntent;->getActivity\\([\\s\\S]{0,40}0x2000000'),
    ('IPC_ACTIVITY_INTENT_FILTER_ACTION_VIEW_NO_BROWSE', 'LOW', 'LOW', 'IPC', 'CWE-940', 3.5, 'smali', True, 'android.intent.action.VIEW.*\\n.*android.intent.category.DEFAULT'),
    ('IPC_GRANT_URI_PERMISSION_BROAD', 'MEDIUM', 'LOW', 'IPC', 'CWE-925', 5.0, 'smali', True, 'addFlags\\(I\\)Landroid/content/Intent;[\\s\\S]{0,40}0x1'),
    ('PRIVACY_ANDROID_ID_READ', 'MEDIUM', 'HIGH', 'PRIVACY', 'CWE-359', 5.0, 'smali', False, 'Settings\\$Secure;->ANDROID_ID'),
    ('PRIVACY_AAID_LIMIT_AD_TRACKING_IGNORED', 'MEDIUM', 'LOW', 'PRIVACY', 'CWE-359', 5.0, 'smali', False, 'AdvertisingIdClient;->getAdvertisingIdInfo\\(Landroid/content/Context;\\)Lcom/google/android/gms/ads/identifier/AdvertisingIdClient\\$Info;'),
    ('PRIVACY_LOCATION_BACKGROUND', 'HIGH', 'MEDIUM', 'PRIVACY', 'CWE-359', 6.5, 'smali', False, 'FusedLocationProviderClient;->requestLocationUpdates\\('),
    ('PRIVACY_PHONE_NUMBER_READ', 'HIGH', 'HIGH', 'PRIVACY', 'CWE-359', 6.0, 'smali', False, 'TelephonyManager;->getLine1Number\\('),
    ('ANTITAMPER_NO_SIGNATURE_CHECK', 'LOW', 'LOW', 'ANTITAMPER', 'CWE-345', 3.0, 'smali', False, 'PackageManager;->getPackageInfo\\(Ljava/lang/String;I\\)Landroid/content/pm/PackageInfo;'),
    ('ANTITAMPER_DEBUGGER_CHECK_PRESENT', 'INFO', 'HIGH', 'ANTITAMPER', 'CWE-693', 0.0, 'smali', False, 'Landroid/os/Debug;->isDebuggerConnected\\(\\)Z'),
    ('LOG_PII_AAID', 'HIGH', 'MEDIUM', 'LOGGING', 'CWE-532', 6.0, 'smali', True, 'AdvertisingIdClient\\$Info;->getId\\(\\)[\\s\\S]{0,200}Log;->[diwev]'),
    ('LOG_EXCEPTION_PRINT_STACK', 'LOW', 'MEDIUM', 'LOGGING', 'CWE-209', 3.5, 'smali', False, 'Throwable;->printStackTrace\\(\\)V'),
    ('RESOURCE_CRT_FILE_BUNDLED', 'LOW', 'HIGH', 'RESOURCE', 'CWE-321', 3.5, 'smali', False, 'invoke-virtual.*open\\(.*"(.*\\.(crt|pem|key|p12|pfx))"'),
    ('DANGEROUS_INVOKE_HIDDEN_API', 'MEDIUM', 'LOW', 'OBFUSCATION', 'CWE-749', 5.0, 'smali', False, 'Method;->setAccessible\\(Z\\)V'),
    ('DANGEROUS_LIBRARY_ZIP_TRAVERSAL', 'HIGH', 'LOW', 'GENERAL', 'CWE-22', 7.0, 'smali', False, 'ZipFile;->entries\\(\\)Ljava/util/Enumeration;'),
    ('DANGEROUS_LOAD_ASSET_DEX', 'HIGH', 'MEDIUM', 'OBFUSCATION', 'CWE-94', 7.0, 'smali', True, 'AssetManager;->open\\(Ljava/lang/String;\\).*"\\.(dex|jar|apk)"'),
    ('ANDROID_BIOMETRIC_FALLBACK_TO_CRED', 'LOW', 'HIGH', 'AUTH', 'CWE-287', 3.5, 'smali', True, 'BiometricPrompt\\$PromptInfo\\$Builder;->setAllowedAuthenticators\\(I\\)L.*BIOMETRIC_WEAK[\\s\\S]{0,40}DEVICE_CREDENTIAL'),
    ('ANDROID_DOWNLOAD_MANAGER_CLEARTEXT', 'MEDIUM', 'MEDIUM', 'NETWORK', 'CWE-319', 5.5, 'smali', False, 'Landroid/app/DownloadManager\\$Request;-><init>\\(Landroid/net/Uri;\\)V'),
    ('AUTH_FIDO2_NO_USER_VERIFICATION', 'MEDIUM', 'LOW', 'AUTH', 'CWE-308', 5.0, 'smali', False, 'PublicKeyCredentialCreationOptions\\$Builder;->setUserVerification\\(.*DISCOURAGED'),
    ('NETWORK_GRPC_INSECURE_CHANNEL', 'HIGH', 'HIGH', 'NETWORK', 'CWE-319', 7.5, 'smali', False, 'ManagedChannelBuilder;->usePlaintext\\(\\)L'),
    ('SAFETYNET_LEGACY_USED', 'MEDIUM', 'MEDIUM', 'GENERAL', 'CWE-1357', 5.3, 'smali', False, 'Lcom/google/android/gms/safetynet/SafetyNetClient;->attest'),
    ('PLAY_INTEGRITY_NO_SERVER_VERIFY', 'HIGH', 'LOW', 'GENERAL', 'CWE-345', 6.5, 'smali', True, 'IntegrityTokenResponse;->token\\(\\).*deviceIntegrity'),
    ('ACCESSIBILITY_SERVICE_DECLARED', 'MEDIUM', 'MEDIUM', 'PRIVACY', 'CWE-250', 6.0, 'smali', False, 'Landroid/accessibilityservice/AccessibilityService;'),
    ('MEDIA_PROJECTION_REQUEST', 'HIGH', 'MEDIUM', 'PRIVACY', 'CWE-359', 7.0, 'smali', False, 'Landroid/media/projection/MediaProjectionManager;->createScreenCaptureIntent'),
    ('NOTIFICATION_LISTENER_DECLARED', 'MEDIUM', 'HIGH', 'PRIVACY', 'CWE-359', 5.5, 'smali', False, 'Landroid/service/notification/NotificationListenerService;'),
    ('SYSTEM_ALERT_WINDOW_USED', 'HIGH', 'MEDIUM', 'GENERAL', 'CWE-1021', 7.0, 'smali', False, 'TYPE_APPLICATION_OVERLAY|TYPE_SYSTEM_ALERT_WINDOW'),
    ('BIOMETRIC_AUTH_NOT_REQUIRED', 'HIGH', 'MEDIUM', 'CRYPTO', 'CWE-287', 6.8, 'smali', True, 'setUserAuthenticationRequired.*const/4 v\\d+, 0x0'),
    ('KEYCHAIN_EXPOSED', 'MEDIUM', 'LOW', 'CRYPTO', 'CWE-522', 5.4, 'smali', False, 'Landroid/security/KeyChain;->getPrivateKey'),
    ('CONTENTRESOLVER_QUERY_STRING_CONCAT', 'HIGH', 'MEDIUM', 'STORAGE', 'CWE-89', 7.0, 'smali', True, 'ContentResolver;->query.*StringBuilder.*query'),
    ('AUTOFILL_LEAK_OPT_IN', 'LOW', 'LOW', 'PRIVACY', 'CWE-359', 3.7, 'smali', True, 'setImportantForAutofill.*const/4 v\\d+, 0x1'),
    ('ALLOW_BACKUP_ENABLED', 'LOW', 'LOW', 'STORAGE', 'CWE-200', 4.0, 'smali', False, 'allowBackup.*true'),
    ('CLIPBOARD_PERSISTENT_LISTENER', 'MEDIUM', 'MEDIUM', 'PRIVACY', 'CWE-359', 5.3, 'smali', False, 'addPrimaryClipChangedListener'),
    ('WEBVIEW_SAFE_BROWSING_DISABLED', 'MEDIUM', 'MEDIUM', 'WEBVIEW', 'CWE-1188', 5.5, 'smali', True, 'setSafeBrowsingEnabled.*const/4 v\\d+, 0x0'),
    ('WEBVIEW_GEOLOCATION_ALWAYS_GRANT', 'MEDIUM', 'MEDIUM', 'WEBVIEW', 'CWE-862', 5.5, 'smali', True, 'onGeolocationPermissionsShowPrompt.*invoke.*const/4 v\\d+, 0x1'),
    ('TLS_TRUSTALL_HOSTNAME_VERIFIER', 'CRITICAL', 'HIGH', 'NETWORK', 'CWE-295', 8.6, 'smali', True, 'verify\\(Ljava/lang/String;Ljavax/net/ssl/SSLSession;\\)Z[\\s\\S]{0,200}const/4 v\\d+, 0x1[\\s\\S]{0,40}return v\\d+'),
    ('HTTP_CLEARTEXT_PERMITTED', 'HIGH', 'HIGH', 'NETWORK', 'CWE-319', 7.4, 'smali', False, 'cleartextTrafficPermitted="true"'),
    ('LOCAL_SOCKET_BIND', 'LOW', 'LOW', 'GENERAL', 'CWE-927', 4.0, 'smali', False, 'Landroid/net/LocalServerSocket;-><init>'),
    ('KOTLIN_LAMBDA_CAPTURES_PASSWORD', 'MEDIUM', 'MEDIUM', 'PRIVACY', 'CWE-200', 5.5, 'java', True, 'final\\s+(?:String|char\\[\\])\\s+(password|secret|token|api_?key)[\\s\\S]{0,400}\\$Lambda\\$'),
    ('COROUTINE_STATE_MACHINE_LEAKS_TOKEN', 'MEDIUM', 'LOW', 'PRIVACY', 'CWE-316', 4.3, 'java', True, 'extends\\s+kotlin\\.coroutines\\.jvm\\.internal\\.(?:ContinuationImpl|SuspendLambda)[\\s\\S]{0,800}(?:bearer|access_?token|refresh_?token|jwt)'),
    ('SEALED_CLASS_DESERIALIZED_FROM_INTENT', 'HIGH', 'MEDIUM', 'IPC', 'CWE-502', 7.5, 'java', True, 'getSerializableExtra\\([\\s\\S]{0,80}sealed[\\s\\S]{0,400}'),
    ('COMPOSE_REMEMBER_HOLDS_SECRET', 'LOW', 'LOW', 'PRIVACY', 'CWE-316', 3.7, 'java', True, 'remember\\([\\s\\S]{0,100}mutableStateOf\\([^)]*?(password|secret|pin|token)'),
    ('KOTLIN_LAZY_INIT_REFLECTION', 'HIGH', 'MEDIUM', 'REFLECTION', 'CWE-470', 7.8, 'java', True, 'kotlin\\.Lazy[\\s\\S]{0,300}Class\\.forName\\([\\s\\S]{0,200}(getSharedPreferences|getStringExtra|getIntent)'),
)
