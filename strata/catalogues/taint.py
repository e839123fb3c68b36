"""Catalogues of the data-flow analysis: what makes, takes and cleans tainted values."""

#: Fixed values: (class, method, label, parameter; -1 for the result).
SOURCES = (
    ('Landroid/telephony/TelephonyManager;', 'getDeviceId', 'DEVICE_ID', -1),
    ('Landroid/telephony/TelephonyManager;', 'getImei', 'DEVICE_ID', -1),
    ('Landroid/telephony/TelephonyManager;', 'getMeid', 'DEVICE_ID', -1),
    ('Landroid/telephony/TelephonyManager;', 'getSubscriberId', 'DEVICE_ID', -1),
    ('Landroid/telephony/TelephonyManager;', 'getSimSerialNumber', 'DEVICE_ID', -1),
    ('Landroid/telephony/TelephonyManager;', 'getLine1Number', 'DEVICE_ID', -1),
    ('Landroid/telephony/TelephonyManager;', 'getNetworkOperatorName', 'DEVICE_ID', -1),
    ('Landroid/provider/Settings$Secure;', 'getString', 'DEVICE_ID', -1),
    ('Landroid/provider/Settings$System;', 'getString', 'DEVICE_ID', -1),
    ('Landroid/os/Build;', 'getSerial', 'DEVICE_ID', -1),
    ('Lcom/google/android/gms/ads/identifier/AdvertisingIdClient;', 'getAdvertisingIdInfo', 'DEVICE_ID', -1),
    ('Landroid/location/LocationManager;', 'getLastKnownLocation', 'LOCATION', -1),
    ('Landroid/location/LocationManager;', 'requestLocationUpdates', 'LOCATION', -1),
    ('Landroid/location/Location;', 'getLatitude', 'LOCATION', -1),
    ('Landroid/location/Location;', 'getLongitude', 'LOCATION', -1),
    ('Landroid/location/Location;', 'getAltitude', 'LOCATION', -1),
    ('Landroid/location/Location;', 'getSpeed', 'LOCATION', -1),
    ('Lcom/google/android/gms/location/FusedLocationProviderClient;', 'getLastLocation', 'LOCATION', -1),
    ('Lcom/google/android/gms/location/LocationResult;', 'getLastLocation', 'LOCATION', -1),
    ('Landroid/widget/EditText;', 'getText', 'USER_INPUT', -1),
    ('Landroid/widget/TextView;', 'getText', 'USER_INPUT', -1),
    ('Landroid/widget/SearchView;', 'getQuery', 'USER_INPUT', -1),
    ('Landroid/widget/AutoCompleteTextView;', 'getText', 'USER_INPUT', -1),
    ('Landroid/content/Intent;', 'getStringExtra', 'INTENT', -1),
    ('Landroid/content/Intent;', 'getIntExtra', 'INTENT', -1),
    ('Landroid/content/Intent;', 'getLongExtra', 'INTENT', -1),
    ('Landroid/content/Intent;', 'getBooleanExtra', 'INTENT', -1),
    ('Landroid/content/Intent;', 'getFloatExtra', 'INTENT', -1),
    ('Landroid/content/Intent;', 'getDoubleExtra', 'INTENT', -1),
    ('Landroid/content/Intent;', 'getByteArrayExtra', 'INTENT', -1),
    ('Landroid/content/Intent;', 'getSerializableExtra', 'INTENT', -1),
    ('Landroid/content/Intent;', 'getParcelableExtra', 'INTENT', -1),
    ('Landroid/content/Intent;', 'getBundleExtra', 'INTENT', -1),
    ('Landroid/content/Intent;', 'getExtras', 'INTENT', -1),
    ('Landroid/os/Bundle;', 'getString', 'INTENT', -1),
    ('Landroid/os/Bundle;', 'getInt', 'INTENT', -1),
    ('Landroid/os/Bundle;', 'getLong', 'INTENT', -1),
    ('Landroid/os/Bundle;', 'getBoolean', 'INTENT', -1),
    ('Landroid/os/Bundle;', 'getFloat', 'INTENT', -1),
    ('Landroid/os/Bundle;', 'getDouble', 'INTENT', -1),
    ('Landroid/os/Bundle;', 'getByteArray', 'INTENT', -1),
    ('Landroid/os/Bundle;', 'getSerializable', 'INTENT', -1),
    ('Landroid/os/Bundle;', 'getParcelable', 'INTENT', -1),
    ('Landroid/content/BroadcastReceiver;', 'onReceive', 'INTENT', 1),
    ('Landroid/app/Service;', 'onStartCommand', 'INTENT', 1),
    ('Landroidx/fragment/app/Fragment;', 'getArguments', 'INTENT', -1),
    ('Landroid/app/Fragment;', 'getArguments', 'INTENT', -1),
    ('Landroid/content/ClipboardManager;', 'getPrimaryClip', 'CLIPBOARD', -1),
    ('Landroid/content/ClipData$Item;', 'getText', 'CLIPBOARD', -1),
    ('Landroid/content/ClipData$Item;', 'getUri', 'CLIPBOARD', -1),
    ('Landroid/content/ContentResolver;', 'query', 'CONTACT', -1),
    ('Landroid/database/Cursor;', 'getString', 'CONTACT', -1),
    ('Landroid/database/Cursor;', 'getInt', 'CONTACT', -1),
    ('Landroid/database/Cursor;', 'getLong', 'CONTACT', -1),
    ('Landroid/database/Cursor;', 'getBlob', 'CONTACT', -1),
    ('Landroid/accounts/AccountManager;', 'getAccounts', 'ACCOUNT', -1),
    ('Landroid/accounts/AccountManager;', 'getAccountsByType', 'ACCOUNT', -1),
    ('Landroid/accounts/AccountManager;', 'blockingGetAuthToken', 'ACCOUNT', -1),
    ('Landroid/accounts/AccountManager;', 'getAuthToken', 'ACCOUNT', -1),
    ('Landroid/accounts/AccountManager;', 'peekAuthToken', 'ACCOUNT', -1),
    ('Ljava/io/InputStream;', 'read', 'NETWORK_IN', -1),
    ('Ljava/io/BufferedReader;', 'readLine', 'NETWORK_IN', -1),
    ('Lokhttp3/ResponseBody;', 'string', 'NETWORK_IN', -1),
    ('Lokhttp3/ResponseBody;', 'bytes', 'NETWORK_IN', -1),
    ('Lokhttp3/Response;', 'body', 'NETWORK_IN', -1),
    ('Lretrofit2/Response;', 'body', 'NETWORK_IN', -1),
    ('Ljava/net/HttpURLConnection;', 'getInputStream', 'NETWORK_IN', -1),
    ('Lorg/apache/http/HttpEntity;', 'getContent', 'NETWORK_IN', -1),
    ('Ljava/io/FileInputStream;', 'read', 'FILE_READ', -1),
    ('Ljava/io/FileReader;', 'read', 'FILE_READ', -1),
    ('Ljava/nio/file/Files;', 'readAllBytes', 'FILE_READ', -1),
    ('Ljava/nio/file/Files;', 'readString', 'FILE_READ', -1),
    ('Landroid/content/Context;', 'openFileInput', 'FILE_READ', -1),
    ('Landroid/content/SharedPreferences;', 'getString', 'SHARED_PREFS', -1),
    ('Landroid/content/SharedPreferences;', 'getInt', 'SHARED_PREFS', -1),
    ('Landroid/content/SharedPreferences;', 'getLong', 'SHARED_PREFS', -1),
    ('Landroid/content/SharedPreferences;', 'getBoolean', 'SHARED_PREFS', -1),
    ('Landroid/content/SharedPreferences;', 'getFloat', 'SHARED_PREFS', -1),
    ('Landroid/content/SharedPreferences;', 'getStringSet', 'SHARED_PREFS', -1),
    ('Landroid/content/SharedPreferences;', 'getAll', 'SHARED_PREFS', -1),
    ('Landroid/content/pm/PackageManager;', 'getPackageInfo', 'PACKAGE_INFO', -1),
    ('Landroid/content/pm/PackageManager;', 'getApplicationInfo', 'PACKAGE_INFO', -1),
    ('Landroid/content/pm/PackageManager;', 'getInstalledPackages', 'PACKAGE_INFO', -1),
    ('Landroid/content/Intent;', 'getData', 'CONTENT_URI', -1),
    ('Landroid/content/Intent;', 'getDataString', 'CONTENT_URI', -1),
    ('Landroid/net/Uri;', 'getPathSegments', 'CONTENT_URI', -1),
    ('Landroid/net/Uri;', 'getQueryParameter', 'CONTENT_URI', -1),
    ('Landroid/net/Uri;', 'getLastPathSegment', 'CONTENT_URI', -1),
    ('Landroid/net/Uri;', 'getPath', 'CONTENT_URI', -1),
    ('Landroid/content/ContentProvider;', 'query', 'CONTENT_URI', -1),
    ('Landroid/content/ContentProvider;', 'insert', 'CONTENT_URI', -1),
    ('Landroid/content/ContentProvider;', 'update', 'CONTENT_URI', -1),
    ('Landroid/content/ContentProvider;', 'delete', 'CONTENT_URI', -1),
    ('Landroid/content/ContentProvider;', 'call', 'CONTENT_URI', -1),
    ('Landroid/app/Activity;', 'getIntent', 'DEEP_LINK_DATA', -1),
    ('Landroid/net/Uri;', 'parse', 'DEEP_LINK_DATA', -1),
    ('Landroid/net/Uri;', 'getFragment', 'DEEP_LINK_DATA', -1),
    ('Landroid/net/Uri;', 'getEncodedFragment', 'DEEP_LINK_DATA', -1),
    ('Landroid/net/Uri;', 'getEncodedQuery', 'DEEP_LINK_DATA', -1),
    ('Landroid/net/Uri;', 'getQueryParameterNames', 'DEEP_LINK_DATA', -1),
    ('Landroid/net/Uri;', 'getSchemeSpecificPart', 'DEEP_LINK_DATA', -1),
    ('Landroid/net/Uri;', 'getAuthority', 'DEEP_LINK_DATA', -1),
    ('Landroid/net/Uri;', 'getUserInfo', 'DEEP_LINK_DATA', -1),
    ('Landroid/content/Intent;', 'toUri', 'DEEP_LINK_DATA', -1),
    ('Landroidx/navigation/NavBackStackEntry;', 'getArguments', 'DEEP_LINK_DATA', -1),
    ('Lkotlinx/coroutines/flow/StateFlow;', 'getValue', 'NETWORK_IN', -1),
    ('Lkotlinx/coroutines/flow/MutableStateFlow;', 'getValue', 'NETWORK_IN', -1),
    ('Lkotlinx/coroutines/flow/SharedFlow;', 'getReplayCache', 'NETWORK_IN', -1),
    ('Lkotlinx/coroutines/flow/FlowKt;', 'first', 'NETWORK_IN', -1),
    ('Lkotlinx/coroutines/flow/FlowKt;', 'single', 'NETWORK_IN', -1),
    ('Lkotlinx/coroutines/channels/Channel;', 'receive', 'NETWORK_IN', -1),
    ('Lio/reactivex/Observable;', 'blockingFirst', 'NETWORK_IN', -1),
    ('Lio/reactivex/Observable;', 'blockingSingle', 'NETWORK_IN', -1),
    ('Lio/reactivex/Single;', 'blockingGet', 'NETWORK_IN', -1),
    ('Lio/reactivex/Maybe;', 'blockingGet', 'NETWORK_IN', -1),
    ('Lio/reactivex/Flowable;', 'blockingFirst', 'NETWORK_IN', -1),
    ('Lio/reactivex/rxjava3/core/Single;', 'blockingGet', 'NETWORK_IN', -1),
    ('Lio/reactivex/rxjava3/core/Observable;', 'blockingFirst', 'NETWORK_IN', -1),
    ('Landroidx/lifecycle/LiveData;', 'getValue', 'NETWORK_IN', -1),
    ('Landroidx/lifecycle/MutableLiveData;', 'getValue', 'NETWORK_IN', -1),
    ('Landroidx/datastore/preferences/core/Preferences;', 'get', 'SHARED_PREFS', -1),
    ('Landroidx/datastore/core/DataStore;', 'getData', 'SHARED_PREFS', -1),
    ('Lio/ktor/client/statement/HttpResponse;', 'bodyAsText', 'NETWORK_IN', -1),
    ('Lio/ktor/client/statement/HttpResponse;', 'readBytes', 'NETWORK_IN', -1),
    ('Lio/ktor/client/statement/HttpResponse;', 'body', 'NETWORK_IN', -1),
    ('Lcom/android/volley/NetworkResponse;', 'data', 'NETWORK_IN', -1),
    ('Lcom/android/volley/Response;', 'result', 'NETWORK_IN', -1),
    ('Lcom/apollographql/apollo3/api/ApolloResponse;', 'data', 'NETWORK_IN', -1),
    ('Lcom/apollographql/apollo/api/Response;', 'data', 'NETWORK_IN', -1),
    ('Lorg/jsoup/Jsoup;', 'parse', 'NETWORK_IN', -1),
    ('Lorg/jsoup/nodes/Element;', 'text', 'NETWORK_IN', -1),
    ('Lorg/jsoup/nodes/Element;', 'html', 'NETWORK_IN', -1),
)

#: Fixed values: (class, method, label, tainted parameter without the receiver).
SINKS = (
    ('Landroid/util/Log;', 'd', 'LOG', 1),
    ('Landroid/util/Log;', 'e', 'LOG', 1),
    ('Landroid/util/Log;', 'i', 'LOG', 1),
    ('Landroid/util/Log;', 'v', 'LOG', 1),
    ('Landroid/util/Log;', 'w', 'LOG', 1),
    ('Landroid/util/Log;', 'wtf', 'LOG', 1),
    ('Ljava/io/PrintStream;', 'println', 'LOG', 0),
    ('Ljava/io/PrintStream;', 'print', 'LOG', 0),
    ('Ltimber/log/Timber;', 'd', 'LOG', 0),
    ('Ltimber/log/Timber;', 'e', 'LOG', 0),
    ('Ltimber/log/Timber;', 'i', 'LOG', 0),
    ('Ljava/io/OutputStream;', 'write', 'NETWORK_OUT', 0),
    ('Lokhttp3/Request$Builder;', 'url', 'NETWORK_OUT', 0),
    ('Lokhttp3/FormBody$Builder;', 'add', 'NETWORK_OUT', 1),
    ('Lokhttp3/FormBody$Builder;', 'addEncoded', 'NETWORK_OUT', 1),
    ('Lokhttp3/MultipartBody$Builder;', 'addFormDataPart', 'NETWORK_OUT', 1),
    ('Lretrofit2/http/Body;', '*', 'NETWORK_OUT', 0),
    ('Ljava/net/HttpURLConnection;', 'getOutputStream', 'NETWORK_OUT', -1),
    ('Ljava/net/URLConnection;', 'setRequestProperty', 'NETWORK_OUT', 1),
    ('Lorg/apache/http/client/methods/HttpPost;', 'setEntity', 'NETWORK_OUT', 0),
    ('Lcom/android/volley/toolbox/StringRequest;', '<init>', 'NETWORK_OUT', 2),
    ('Landroid/content/SharedPreferences$Editor;', 'putString', 'STORAGE', 1),
    ('Landroid/content/SharedPreferences$Editor;', 'putInt', 'STORAGE', 1),
    ('Landroid/content/SharedPreferences$Editor;', 'putLong', 'STORAGE', 1),
    ('Landroid/content/SharedPreferences$Editor;', 'putBoolean', 'STORAGE', 1),
    ('Landroid/database/sqlite/SQLiteDatabase;', 'execSQL', 'STORAGE', 0),
    ('Landroid/database/sqlite/SQLiteDatabase;', 'rawQuery', 'STORAGE', 0),
    ('Ljava/io/FileOutputStream;', 'write', 'STORAGE', 0),
    ('Ljava/io/FileWriter;', 'write', 'STORAGE', 0),
    ('Ljava/nio/file/Files;', 'write', 'STORAGE', 1),
    ('Ljava/io/File;', '<init>', 'FILE_WRITE', 0),
    ('Ljava/io/FileOutputStream;', '<init>', 'FILE_WRITE', 0),
    ('Landroid/content/Context;', 'openFileOutput', 'FILE_WRITE', 0),
    ('Landroid/content/Context;', 'deleteFile', 'FILE_WRITE', 0),
    ('Landroid/content/Intent;', 'putExtra', 'IPC_OUT', 1),
    ('Landroid/os/Bundle;', 'putString', 'IPC_OUT', 1),
    ('Landroid/os/Bundle;', 'putInt', 'IPC_OUT', 1),
    ('Landroid/os/Bundle;', 'putParcelable', 'IPC_OUT', 1),
    ('Landroid/os/Parcel;', 'writeString', 'IPC_OUT', 0),
    ('Landroid/content/Context;', 'startActivity', 'IPC_REDIRECT', 0),
    ('Landroid/content/Context;', 'startActivityForResult', 'IPC_REDIRECT', 0),
    ('Landroid/content/Context;', 'startService', 'IPC_REDIRECT', 0),
    ('Landroid/content/Context;', 'bindService', 'IPC_REDIRECT', 0),
    ('Landroid/content/Context;', 'sendBroadcast', 'IPC_REDIRECT', 0),
    ('Landroid/content/Context;', 'sendOrderedBroadcast', 'IPC_REDIRECT', 0),
    ('Landroid/content/Context;', 'sendStickyBroadcast', 'IPC_REDIRECT', 0),
    ('Landroid/app/Activity;', 'startActivity', 'IPC_REDIRECT', 0),
    ('Landroid/app/Activity;', 'startActivityForResult', 'IPC_REDIRECT', 0),
    ('Landroid/app/PendingIntent;', 'getActivity', 'PENDING_INTENT', 2),
    ('Landroid/app/PendingIntent;', 'getService', 'PENDING_INTENT', 2),
    ('Landroid/app/PendingIntent;', 'getBroadcast', 'PENDING_INTENT', 2),
    ('Ljavax/crypto/spec/SecretKeySpec;', '<init>', 'CRYPTO_SINK', 0),
    ('Ljavax/crypto/spec/IvParameterSpec;', '<init>', 'CRYPTO_SINK', 0),
    ('Ljava/security/MessageDigest;', 'update', 'CRYPTO_SINK', 0),
    ('Ljavax/crypto/Mac;', 'update', 'CRYPTO_SINK', 0),
    ('Landroid/database/sqlite/SQLiteDatabase;', 'rawQuery', 'SQL_INJECT', 0),
    ('Landroid/database/sqlite/SQLiteDatabase;', 'execSQL', 'SQL_INJECT', 0),
    ('Landroid/database/sqlite/SQLiteDatabase;', 'compileStatement', 'SQL_INJECT', 0),
    ('Landroid/content/ContentResolver;', 'delete', 'SQL_INJECT', 2),
    ('Landroid/content/ContentResolver;', 'update', 'SQL_INJECT', 2),
    ('Landroid/content/ContentResolver;', 'insert', 'SQL_INJECT', 1),
    ('Landroid/content/ContentResolver;', 'query', 'SQL_INJECT', 2),
    ('Ljava/lang/Runtime;', 'exec', 'EXEC', 0),
    ('Ljava/lang/ProcessBuilder;', '<init>', 'EXEC', 0),
    ('Ljava/lang/ProcessBuilder;', 'command', 'EXEC', 0),
    ('Landroid/webkit/WebView;', 'loadUrl', 'WEBVIEW', 0),
    ('Landroid/webkit/WebView;', 'evaluateJavascript', 'WEBVIEW', 0),
    ('Landroid/webkit/WebView;', 'loadData', 'WEBVIEW', 0),
    ('Landroid/webkit/WebView;', 'loadDataWithBaseURL', 'WEBVIEW', 1),
    ('Landroid/webkit/WebView;', 'postUrl', 'WEBVIEW', 0),
    ('Landroid/webkit/WebView;', 'addJavascriptInterface', 'WEBVIEW_JS_INJECT', 0),
    ('Landroid/content/Intent;', 'setData', 'DEEPLINK_REDIRECT', 0),
    ('Landroid/content/Intent;', 'setDataAndType', 'DEEPLINK_REDIRECT', 0),
    ('Landroid/content/Intent;', 'setAction', 'DEEPLINK_REDIRECT', 0),
    ('Ljava/net/URL;', '<init>', 'OPEN_REDIRECT', 0),
    ('Ljava/net/URI;', '<init>', 'OPEN_REDIRECT', 0),
    ('Ljava/net/URI;', 'create', 'OPEN_REDIRECT', 0),
    ('Lokhttp3/Request$Builder;', 'url', 'OPEN_REDIRECT', 0),
    ('Landroidx/browser/customtabs/CustomTabsIntent;', 'launchUrl', 'OPEN_REDIRECT', 1),
    ('Lio/ktor/client/request/HttpRequestBuilder;', 'url', 'NETWORK_OUT', 0),
    ('Lio/ktor/client/request/HttpRequestBuilder;', 'setBody', 'NETWORK_OUT', 0),
    ('Lio/ktor/client/HttpClient;', 'request', 'NETWORK_OUT', 0),
    ('Landroidx/datastore/preferences/core/MutablePreferences;', 'set', 'STORAGE', 1),
    ('Landroidx/datastore/core/DataStore;', 'updateData', 'STORAGE', 0),
    ('Landroidx/navigation/NavController;', 'navigate', 'IPC_REDIRECT', 0),
    ('Lorg/bouncycastle/crypto/params/KeyParameter;', '<init>', 'CRYPTO_SINK', 0),
    ('Lorg/bouncycastle/jce/spec/IESParameterSpec;', '<init>', 'CRYPTO_SINK', 0),
    ('Lcom/android/volley/toolbox/JsonObjectRequest;', '<init>', 'NETWORK_OUT', 1),
    ('Lcom/android/volley/Request;', '<init>', 'NETWORK_OUT', 1),
    ('Lcom/apollographql/apollo3/ApolloClient;', 'query', 'NETWORK_OUT', 0),
    ('Lcom/apollographql/apollo3/ApolloClient;', 'mutation', 'NETWORK_OUT', 0),
    ('Ltimber/log/Timber$Tree;', 'd', 'LOG', 0),
    ('Ltimber/log/Timber$Tree;', 'e', 'LOG', 0),
    ('Ltimber/log/Timber$Tree;', 'i', 'LOG', 0),
    ('Ltimber/log/Timber$Tree;', 'w', 'LOG', 0),
    ('Ltimber/log/Timber;', 'w', 'LOG', 0),
    ('Ltimber/log/Timber;', 'v', 'LOG', 0),
    ('Lkotlin/io/ConsoleKt;', 'println', 'LOG', 0),
    ('Lkotlin/io/ConsoleKt;', 'print', 'LOG', 0),
)

#: Fixed values: (class, method, label, sink labels it neutralises).
SANITIZERS = (
    ('Landroid/text/Html;', 'escapeHtml', 'HTML_ESCAPE', ('LOG', 'WEBVIEW')),
    ('Lorg/apache/commons/lang/StringEscapeUtils;', 'escapeHtml', 'HTML_ESCAPE', ('LOG', 'WEBVIEW')),
    ('Lorg/apache/commons/text/StringEscapeUtils;', 'escapeHtml4', 'HTML_ESCAPE', ('LOG', 'WEBVIEW')),
    ('Ljava/net/URLEncoder;', 'encode', 'URL_ENCODE', ('NETWORK_OUT', 'WEBVIEW')),
    ('Landroid/net/Uri;', 'encode', 'URL_ENCODE', ('NETWORK_OUT', 'WEBVIEW')),
    ('Landroid/database/sqlite/SQLiteDatabase;', 'query', 'SQL_ESCAPE', ('SQL_INJECT', 'STORAGE')),
    ('Ljava/security/MessageDigest;', 'digest', 'CRYPTO_HASH', ('LOG', 'NETWORK_OUT', 'STORAGE')),
    ('Lcom/google/common/hash/Hashing;', '*', 'CRYPTO_HASH', ('LOG', 'NETWORK_OUT', 'STORAGE')),
    ('Landroid/util/Base64;', 'encode', 'BASE64_ENCODE', ()),
    ('Ljava/util/Base64;', 'encode', 'BASE64_ENCODE', ()),
    ('Ljavax/crypto/Cipher;', 'doFinal', 'ENCRYPT', ('LOG', 'NETWORK_OUT', 'STORAGE')),
    ('Lorg/bouncycastle/crypto/BufferedBlockCipher;', 'doFinal', 'ENCRYPT', ('LOG', 'NETWORK_OUT', 'STORAGE')),
    ('Landroidx/core/text/HtmlCompat;', 'fromHtml', 'HTML_ESCAPE', ('WEBVIEW',)),
    ('Lorg/jsoup/parser/Parser;', 'unescapeEntities', 'HTML_ESCAPE', ()),
    ('Lorg/owasp/html/PolicyFactory;', 'sanitize', 'HTML_ESCAPE', ('LOG', 'WEBVIEW')),
    ('Lio/ktor/http/CodecsKt;', 'encodeURLPath', 'URL_ENCODE', ('NETWORK_OUT',)),
    ('Lio/ktor/http/CodecsKt;', 'encodeURLQueryComponent', 'URL_ENCODE', ('NETWORK_OUT',)),
    ('Lorg/bouncycastle/crypto/digests/SHA256Digest;', 'doFinal', 'CRYPTO_HASH', ('LOG', 'NETWORK_OUT', 'STORAGE')),
    ('Landroidx/sqlite/db/SupportSQLiteDatabase;', 'query', 'SQL_ESCAPE', ('SQL_INJECT', 'STORAGE')),
    ('Ljava/io/File;', 'getCanonicalPath', 'PATH_NORMALIZE', ('FILE_WRITE',)),
    ('Ljava/io/File;', 'getCanonicalFile', 'PATH_NORMALIZE', ('FILE_WRITE',)),
)

#: Fixed values: (class, method, arguments that flow to the result, labels of the result, (argument, label) cleaned, (argument, label) sunk); * matches any.
NATIVES = (
    ('*', 'decrypt', (0,), (), (), ()),
    ('*', 'decryptString', (0,), (), (), ()),
    ('*', 'decryptBytes', (0,), (), (), ()),
    ('*', 'decode', (0,), (), (), ()),
    ('*', 'deobfuscate', (0,), (), (), ()),
    ('*', 'unwrap', (0,), (), (), ()),
    ('*', 'decodeString', (0,), (), (), ()),
    ('*', 'encrypt', (0,), (), (), ()),
    ('*', 'encryptString', (0,), (), (), ()),
    ('*', 'encryptBytes', (0,), (), (), ()),
    ('*', 'encode', (0,), (), (), ()),
    ('*', 'hash', (), (), ((0, 'HMAC_DIGEST'),), ()),
    ('*', 'hashBytes', (), (), ((0, 'HMAC_DIGEST'),), ()),
    ('*', 'sha256', (), (), ((0, 'HMAC_DIGEST'),), ()),
    ('*', 'sha512', (), (), ((0, 'HMAC_DIGEST'),), ()),
    ('*', 'hmac', (), (), ((0, 'HMAC_DIGEST'),), ()),
    ('*', 'loadKey', (), ('CRYPTO_KEY',), (), ()),
    ('*', 'getApiKey', (), ('CRYPTO_KEY',), (), ()),
    ('*', 'getSecret', (), ('CRYPTO_KEY',), (), ()),
    ('*', 'getDeviceFingerprint', (), ('DEVICE_ID',), (), ()),
    ('*', 'getInstallationId', (), ('DEVICE_ID',), (), ()),
    ('*', 'nativePost', (), (), (), ((1, 'NETWORK_OUT'),)),
    ('*', 'nativeSend', (), (), (), ((1, 'NETWORK_OUT'),)),
    ('*', 'nativeWrite', (), (), (), ((1, 'FILE_WRITE'),)),
    ('*', 'nativeExec', (), (), (), ((0, 'EXEC'),)),
)
