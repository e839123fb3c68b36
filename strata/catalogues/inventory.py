"""Catalogues of bundled code: trackers, kits, libraries and their known vulnerabilities."""

#: Fixed values: (name, class prefix, category).
TRACKERS = (
    ('Google AdMob', 'Lcom/google/android/gms/ads/', 'ADVERTISING'),
    ('Google Firebase Analytics', 'Lcom/google/firebase/analytics/', 'ANALYTICS'),
    ('Google CrashLytics', 'Lcom/google/firebase/crashlytics/', 'CRASH'),
    ('Google DoubleClick', 'Lcom/google/android/gms/ads/doubleclick/', 'ADVERTISING'),
    ('Google Tag Manager', 'Lcom/google/android/gms/tagmanager/', 'ANALYTICS'),
    ('Google Conversion Tracking', 'Lcom/google/ads/conversiontracking/', 'ADVERTISING'),
    ('Facebook Login', 'Lcom/facebook/login/', 'IDENTIFIER'),
    ('Facebook Analytics', 'Lcom/facebook/appevents/', 'ANALYTICS'),
    ('Facebook Audience', 'Lcom/facebook/ads/', 'ADVERTISING'),
    ('Facebook Share', 'Lcom/facebook/share/', 'PROFILING'),
    ('Facebook Places', 'Lcom/facebook/places/', 'LOCATION'),
    ('AppsFlyer', 'Lcom/appsflyer/', 'IDENTIFIER'),
    ('Adjust', 'Lcom/adjust/sdk/', 'IDENTIFIER'),
    ('Branch', 'Lio/branch/', 'IDENTIFIER'),
    ('Branch (legacy)', 'Lcom/branch/', 'IDENTIFIER'),
    ('Singular', 'Lcom/singular/sdk/', 'IDENTIFIER'),
    ('Kochava', 'Lcom/kochava/', 'IDENTIFIER'),
    ('Tenjin', 'Lcom/tenjin/', 'IDENTIFIER'),
    ('Tune', 'Lcom/tune/', 'IDENTIFIER'),
    ('AppLovin', 'Lcom/applovin/', 'ADVERTISING'),
    ('Unity Ads', 'Lcom/unity3d/ads/', 'ADVERTISING'),
    ('ironSource', 'Lcom/ironsource/', 'ADVERTISING'),
    ('MoPub', 'Lcom/mopub/', 'ADVERTISING'),
    ('Vungle', 'Lcom/vungle/', 'ADVERTISING'),
    ('Chartboost', 'Lcom/chartboost/', 'ADVERTISING'),
    ('InMobi', 'Lcom/inmobi/', 'ADVERTISING'),
    ('Tapjoy', 'Lcom/tapjoy/', 'ADVERTISING'),
    ('AdColony', 'Lcom/adcolony/', 'ADVERTISING'),
    ('Smaato', 'Lcom/smaato/', 'ADVERTISING'),
    ('MyTarget', 'Lcom/my/target/', 'ADVERTISING'),
    ('Pangle (ByteDance)', 'Lcom/bytedance/sdk/', 'ADVERTISING'),
    ('Mintegral', 'Lcom/mintegral/', 'ADVERTISING'),
    ('Mintegral (legacy)', 'Lcom/mbridge/', 'ADVERTISING'),
    ('Fyber', 'Lcom/fyber/', 'ADVERTISING'),
    ('Yandex Ads', 'Lcom/yandex/mobile/ads/', 'ADVERTISING'),
    ('Verizon Media', 'Lcom/verizon/ads/', 'ADVERTISING'),
    ('Nend', 'Lnet/nend/android/', 'ADVERTISING'),
    ('LoopMe', 'Lcom/loopme/', 'ADVERTISING'),
    ('Startapp', 'Lcom/startapp/', 'ADVERTISING'),
    ('Outbrain', 'Lcom/outbrain/', 'ADVERTISING'),
    ('Taboola', 'Lcom/taboola/', 'ADVERTISING'),
    ('Maio', 'Ljp/maio/sdk/', 'ADVERTISING'),
    ('Yieldmo', 'Lcom/yieldmo/', 'ADVERTISING'),
    ('Criteo', 'Lcom/criteo/publisher/', 'ADVERTISING'),
    ('Mixpanel', 'Lcom/mixpanel/android/', 'ANALYTICS'),
    ('Amplitude', 'Lcom/amplitude/', 'ANALYTICS'),
    ('Segment', 'Lcom/segment/analytics/', 'ANALYTICS'),
    ('Heap', 'Lcom/heapanalytics/android/', 'ANALYTICS'),
    ('FullStory', 'Lcom/fullstory/', 'PROFILING'),
    ('Hotjar', 'Lcom/hotjar/', 'PROFILING'),
    ('ContentSquare', 'Lcom/contentsquare/', 'PROFILING'),
    ('AppDynamics', 'Lcom/appdynamics/', 'ANALYTICS'),
    ('New Relic', 'Lcom/newrelic/agent/android/', 'ANALYTICS'),
    ('Datadog RUM', 'Lcom/datadog/android/', 'ANALYTICS'),
    ('Adobe Analytics', 'Lcom/adobe/marketing/', 'ANALYTICS'),
    ('Adobe Mobile', 'Lcom/adobe/mobile/', 'ANALYTICS'),
    ('Localytics', 'Lcom/localytics/android/', 'ANALYTICS'),
    ('Flurry', 'Lcom/flurry/android/', 'ANALYTICS'),
    ('Yandex Metrica', 'Lcom/yandex/metrica/', 'ANALYTICS'),
    ('Countly', 'Lly/count/android/sdk/', 'ANALYTICS'),
    ('Matomo', 'Lorg/matomo/sdk/', 'ANALYTICS'),
    ('Plausible', 'Lcom/plausible/sdk/', 'ANALYTICS'),
    ('Smartlook', 'Lcom/smartlook/sdk/', 'PROFILING'),
    ('UXCam', 'Lcom/uxcam/', 'PROFILING'),
    ('Umeng', 'Lcom/umeng/', 'ANALYTICS'),
    ('Tencent MTA', 'Lcom/tencent/stat/', 'ANALYTICS'),
    ('Tencent Bugly', 'Lcom/tencent/bugly/', 'CRASH'),
    ('Mixin', 'Lcom/mixin/android/', 'ANALYTICS'),
    ('Sentry', 'Lio/sentry/', 'CRASH'),
    ('Bugsnag', 'Lcom/bugsnag/android/', 'CRASH'),
    ('Rollbar', 'Lcom/rollbar/android/', 'CRASH'),
    ('Embrace.io', 'Lio/embrace/android/', 'CRASH'),
    ('Instabug', 'Lcom/instabug/', 'CRASH'),
    ('Raygun', 'Lcom/raygun/', 'CRASH'),
    ('AppCenter', 'Lcom/microsoft/appcenter/', 'CRASH'),
    ('OneSignal', 'Lcom/onesignal/', 'PUSH'),
    ('Airship (Urban Airship)', 'Lcom/urbanairship/', 'PUSH'),
    ('Iterable', 'Lcom/iterable/iterableapi/', 'PUSH'),
    ('Braze (formerly Appboy)', 'Lcom/braze/', 'PUSH'),
    ('Appboy (legacy)', 'Lcom/appboy/', 'PUSH'),
    ('Pushwoosh', 'Lcom/pushwoosh/', 'PUSH'),
    ('Mparticle', 'Lcom/mparticle/', 'PUSH'),
    ('CleverTap', 'Lcom/clevertap/android/sdk/', 'PUSH'),
    ('Leanplum', 'Lcom/leanplum/', 'PUSH'),
    ('MoEngage', 'Lcom/moengage/', 'PUSH'),
    ('WebEngage', 'Lcom/webengage/sdk/android/', 'PUSH'),
    ('Smooch', 'Lio/smooch/', 'PUSH'),
    ('Fingerprint Pro', 'Lcom/fingerprintjs/', 'IDENTIFIER'),
    ('OpenX', 'Lcom/openx/', 'IDENTIFIER'),
    ('LiveRamp', 'Lcom/liveramp/mobilesdk/', 'IDENTIFIER'),
    ('ID5', 'Lio/id5/sdk/', 'IDENTIFIER'),
    ('Permutive', 'Lcom/permutive/android/', 'IDENTIFIER'),
    ('Zeotap', 'Lcom/zeotap/', 'IDENTIFIER'),
    ('Throtle', 'Lcom/throtle/', 'IDENTIFIER'),
    ('Foursquare Pilgrim', 'Lcom/foursquare/pilgrim/', 'LOCATION'),
    ('Radar', 'Lio/radar/sdk/', 'LOCATION'),
    ('Reveal Mobile (Pulse)', 'Lcom/revealmobile/', 'LOCATION'),
    ('X-Mode (Outlogic)', 'Lio/xmode/', 'LOCATION'),
    ('X-Mode (legacy)', 'Lcom/xmode/', 'LOCATION'),
    ('Predicio', 'Lcom/predicio/', 'LOCATION'),
    ('Cuebiq', 'Lcom/cuebiq/', 'LOCATION'),
    ('Tutela', 'Lcom/tutela/', 'LOCATION'),
    ('Sense360', 'Lcom/sense360/', 'LOCATION'),
    ('Sentiance', 'Lcom/sentiance/sdk/', 'LOCATION'),
    ('Gimbal', 'Lcom/gimbal/', 'LOCATION'),
    ('Bluedot', 'Lau/com/bluedot/point/', 'LOCATION'),
    ('Optimizely', 'Lcom/optimizely/ab/android/', 'PROFILING'),
    ('LaunchDarkly', 'Lcom/launchdarkly/', 'PROFILING'),
    ('Apptimize', 'Lcom/apptimize/', 'PROFILING'),
    ('Apptentive', 'Lcom/apptentive/android/sdk/', 'PROFILING'),
    ('Taplytics', 'Lcom/taplytics/sdk/', 'PROFILING'),
    ('Customer.io', 'Lio/customer/sdk/', 'PROFILING'),
    ('Yandex AppMetrica', 'Lcom/yandex/metrica/impl/', 'ANALYTICS'),
    ('Mail.ru', 'Lru/mail/', 'ANALYTICS'),
    ('VK', 'Lcom/vk/api/sdk/', 'SOCIAL'),
    ('Baidu Push', 'Lcom/baidu/android/pushservice/', 'PUSH'),
    ('Baidu Mobstat', 'Lcom/baidu/mobstat/', 'ANALYTICS'),
    ('Xiaomi MiPush', 'Lcom/xiaomi/mipush/', 'PUSH'),
    ('Huawei HMS', 'Lcom/huawei/hms/', 'PUSH'),
    ('Huawei Push', 'Lcom/huawei/agconnect/', 'PUSH'),
    ('Tencent IM', 'Lcom/tencent/imsdk/', 'PUSH'),
    ('WeChat', 'Lcom/tencent/mm/opensdk/', 'SOCIAL'),
    ('Alibaba/Taobao OneTrack', 'Lcom/alibaba/sdk/android/', 'ANALYTICS'),
    ('JPush (Aurora)', 'Lcn/jpush/android/', 'PUSH'),
    ('Getui (Individual)', 'Lcom/igexin/', 'PUSH'),
    ('UMeng Push', 'Lcom/umeng/message/', 'PUSH'),
    ('Kuaishou', 'Lcom/kwad/sdk/', 'ADVERTISING'),
    ('Optimove', 'Lcom/optimove/sdk/', 'PROFILING'),
    ('Algolia Insights', 'Lcom/algolia/instantsearch/insights/', 'ANALYTICS'),
    ('Snowplow', 'Lcom/snowplowanalytics/snowplow/tracker/', 'ANALYTICS'),
    ('PostHog', 'Lcom/posthog/android/', 'ANALYTICS'),
    ('Smartech', 'Lcom/netcore/android/', 'PROFILING'),
    ('Pendo', 'Lsdk/pendo/io/', 'PROFILING'),
    ('WalkMe', 'Lcom/walkme/', 'PROFILING'),
    ('Gleap', 'Lio/gleap/', 'PROFILING'),
    ('Amplitude Experiment', 'Lcom/amplitude/experiment/', 'PROFILING'),
    ('Firebase Performance', 'Lcom/google/firebase/perf/', 'ANALYTICS'),
    ('Firebase RemoteConfig', 'Lcom/google/firebase/remoteconfig/', 'PROFILING'),
    ('Firebase MLKit', 'Lcom/google/firebase/ml/', 'PROFILING'),
    ('Firebase A/B Testing', 'Lcom/google/firebase/abt/', 'PROFILING'),
    ('Firebase Inappmessaging', 'Lcom/google/firebase/inappmessaging/', 'PROFILING'),
    ('Lottie Telemetry', 'Lcom/airbnb/lottie/network/', 'ANALYTICS'),
    ('Sift Science', 'Lcom/sift/api/representations/', 'IDENTIFIER'),
    ('Forter', 'Lio/forter/mobile/', 'IDENTIFIER'),
    ('Iovation', 'Lcom/iovation/mobile/android/', 'IDENTIFIER'),
    ('Threatmetrix', 'Lcom/threatmetrix/', 'IDENTIFIER'),
    ('BlueKai', 'Lcom/bluekai/sdk/', 'PROFILING'),
)

#: Fixed values: (name, class prefix, category, risk, weakness), in order of precedence.
SDKS = (
    ('Google Mobile Ads (AdMob)', 'Lcom/google/android/gms/ads/', 'ADVERTISING', 'HIGH', 'CWE-359'),
    ('Facebook Audience Network', 'Lcom/facebook/ads/', 'ADVERTISING', 'HIGH', 'CWE-359'),
    ('AppLovin SDK', 'Lcom/applovin/', 'ADVERTISING', 'HIGH', 'CWE-359'),
    ('MoPub SDK', 'Lcom/mopub/', 'ADVERTISING', 'HIGH', 'CWE-359'),
    ('Unity Ads', 'Lcom/unity3d/ads/', 'ADVERTISING', 'MEDIUM', 'CWE-359'),
    ('Chartboost SDK', 'Lcom/chartboost/', 'ADVERTISING', 'MEDIUM', 'CWE-359'),
    ('IronSource (Unity LevelPlay)', 'Lcom/ironsource/', 'ADVERTISING', 'MEDIUM', 'CWE-359'),
    ('Vungle (Liftoff) SDK', 'Lcom/vungle/', 'ADVERTISING', 'MEDIUM', 'CWE-359'),
    ('Firebase Analytics', 'Lcom/google/firebase/analytics/', 'ANALYTICS', 'MEDIUM', 'CWE-359'),
    ('Amplitude Analytics', 'Lcom/amplitude/', 'ANALYTICS', 'MEDIUM', 'CWE-359'),
    ('Mixpanel Analytics', 'Lcom/mixpanel/', 'ANALYTICS', 'MEDIUM', 'CWE-359'),
    ('Segment (Twilio)', 'Lcom/segment/', 'ANALYTICS', 'MEDIUM', 'CWE-359'),
    ('Sentry Crash Reporting', 'Lio/sentry/', 'CRASH', 'LOW', 'CWE-200'),
    ('Bugsnag Crash Reporting', 'Lcom/bugsnag/', 'CRASH', 'LOW', 'CWE-200'),
    ('Firebase Crashlytics', 'Lcom/crashlytics/', 'CRASH', 'LOW', 'CWE-200'),
    ('Facebook SDK (Login/Share)', 'Lcom/facebook/', 'SOCIAL', 'HIGH', 'CWE-359'),
    ('Twitter SDK', 'Lcom/twitter/sdk/', 'SOCIAL', 'MEDIUM', 'CWE-359'),
    ('Singular Attribution', 'Lcom/singular/', 'TRACKING', 'HIGH', 'CWE-359'),
    ('AppsFlyer Attribution', 'Lcom/appsflyer/', 'TRACKING', 'HIGH', 'CWE-359'),
    ('Adjust Attribution', 'Lcom/adjust/sdk/', 'TRACKING', 'HIGH', 'CWE-359'),
    ('Branch.io Attribution', 'Lcom/branch/', 'TRACKING', 'HIGH', 'CWE-359'),
    ('Kochava Attribution', 'Lcom/kochava/', 'TRACKING', 'HIGH', 'CWE-359'),
    ('Foursquare Pilgrim SDK', 'Lcom/foursquare/pilgrim/', 'TRACKING', 'HIGH', 'CWE-359'),
    ('Radar Location SDK', 'Lio/radar/', 'TRACKING', 'HIGH', 'CWE-359'),
)

#: Fixed values: (name, package URL, class prefix).
LIBRARIES = (
    ('okhttp', 'pkg:maven/com.squareup.okhttp3/okhttp@{version}', 'Lokhttp3/'),
    ('okhttp3', 'pkg:maven/com.squareup.okhttp3/okhttp@{version}', 'Lokhttp3/internal/Version;'),
    ('retrofit', 'pkg:maven/com.squareup.retrofit2/retrofit@{version}', 'Lretrofit2/'),
    ('okio', 'pkg:maven/com.squareup.okio/okio@{version}', 'Lokio/'),
    ('glide', 'pkg:maven/com.github.bumptech.glide/glide@{version}', 'Lcom/bumptech/glide/'),
    ('lottie', 'pkg:maven/com.airbnb.android/lottie@{version}', 'Lcom/airbnb/lottie/'),
    ('bouncycastle', 'pkg:maven/org.bouncycastle/bcprov-jdk15on@{version}', 'Lorg/bouncycastle/'),
    ('gson', 'pkg:maven/com.google.code.gson/gson@{version}', 'Lcom/google/gson/'),
    ('jackson-databind', 'pkg:maven/com.fasterxml.jackson.core/jackson-databind@{version}', 'Lcom/fasterxml/jackson/databind/'),
    ('apache-httpclient', 'pkg:maven/org.apache.httpcomponents/httpclient@{version}', 'Lorg/apache/http/client/'),
    ('volley', 'pkg:maven/com.android.volley/volley@{version}', 'Lcom/android/volley/'),
    ('picasso', 'pkg:maven/com.squareup.picasso/picasso@{version}', 'Lcom/squareup/picasso/'),
    ('fresco', 'pkg:maven/com.facebook.fresco/fresco@{version}', 'Lcom/facebook/fresco/'),
    ('exoplayer', 'pkg:maven/com.google.android.exoplayer/exoplayer@{version}', 'Lcom/google/android/exoplayer2/'),
    ('media3', 'pkg:maven/androidx.media3/media3-common@{version}', 'Landroidx/media3/'),
    ('kotlin-stdlib', 'pkg:maven/org.jetbrains.kotlin/kotlin-stdlib@{version}', 'Lkotlin/'),
    ('kotlinx-coroutines', 'pkg:maven/org.jetbrains.kotlinx/kotlinx-coroutines-core@{version}', 'Lkotlinx/coroutines/'),
    ('rxjava', 'pkg:maven/io.reactivex.rxjava2/rxjava@{version}', 'Lio/reactivex/'),
    ('rxjava3', 'pkg:maven/io.reactivex.rxjava3/rxjava@{version}', 'Lio/reactivex/rxjava3/'),
    ('dagger', 'pkg:maven/com.google.dagger/dagger@{version}', 'Ldagger/internal/'),
    ('hilt', 'pkg:maven/com.google.dagger/hilt-android@{version}', 'Ldagger/hilt/'),
    ('compose-runtime', 'pkg:maven/androidx.compose.runtime/runtime@{version}', 'Landroidx/compose/runtime/'),
    ('androidx-core', 'pkg:maven/androidx.core/core@{version}', 'Landroidx/core/'),
    ('androidx-fragment', 'pkg:maven/androidx.fragment/fragment@{version}', 'Landroidx/fragment/'),
    ('androidx-room', 'pkg:maven/androidx.room/room-runtime@{version}', 'Landroidx/room/'),
    ('androidx-work', 'pkg:maven/androidx.work/work-runtime@{version}', 'Landroidx/work/'),
    ('play-services-base', 'pkg:maven/com.google.android.gms/play-services-base@{version}', 'Lcom/google/android/gms/common/'),
    ('firebase-core', 'pkg:maven/com.google.firebase/firebase-core@{version}', 'Lcom/google/firebase/'),
    ('moshi', 'pkg:maven/com.squareup.moshi/moshi@{version}', 'Lcom/squareup/moshi/'),
    ('ktor-client', 'pkg:maven/io.ktor/ktor-client-core@{version}', 'Lio/ktor/client/'),
    ('apollo3', 'pkg:maven/com.apollographql.apollo3/apollo-runtime@{version}', 'Lcom/apollographql/apollo3/'),
    ('jsoup', 'pkg:maven/org.jsoup/jsoup@{version}', 'Lorg/jsoup/'),
    ('log4j-core', 'pkg:maven/org.apache.logging.log4j/log4j-core@{version}', 'Lorg/apache/logging/log4j/core/'),
    ('logback-android', 'pkg:maven/com.github.tony19/logback-android@{version}', 'Lch/qos/logback/classic/'),
    ('zxing-core', 'pkg:maven/com.google.zxing/core@{version}', 'Lcom/google/zxing/'),
)

#: Fixed values: (package URL before the version, first fixed version, vulnerability, CVSS).
CVES = (
    ('pkg:maven/com.squareup.okhttp3/okhttp@', '4.9.2', 'CVE-2021-0341', 7.5),
    ('pkg:maven/com.squareup.okhttp3/okhttp@', '4.10.0', 'CVE-2023-3635', 7.5),
    ('pkg:maven/com.fasterxml.jackson.core/jackson-databind@', '2.13.4.2', 'CVE-2022-42003', 7.5),
    ('pkg:maven/com.fasterxml.jackson.core/jackson-databind@', '2.13.4.2', 'CVE-2022-42004', 7.5),
    ('pkg:maven/org.bouncycastle/bcprov-jdk15on@', '1.78', 'CVE-2024-29857', 7.5),
    ('pkg:maven/org.apache.httpcomponents/httpclient@', '4.5.13', 'CVE-2020-13956', 5.3),
    ('pkg:maven/com.github.bumptech.glide/glide@', '4.16.0', 'CVE-2024-22020', 5.0),
    ('pkg:maven/com.airbnb.android/lottie@', '6.0.0', 'CVE-2022-22302', 5.5),
    ('pkg:maven/com.squareup.retrofit2/retrofit@', '2.9.0', 'CVE-2018-1000850', 5.3),
    ('pkg:maven/org.jetbrains.kotlin/kotlin-stdlib@', '1.6.0', 'CVE-2022-24329', 7.5),
    ('pkg:maven/org.apache.logging.log4j/log4j-core@', '2.17.1', 'CVE-2021-44228', 10.0),
    ('pkg:maven/org.jsoup/jsoup@', '1.15.3', 'CVE-2022-36033', 6.1),
    ('pkg:maven/com.google.code.gson/gson@', '2.8.9', 'CVE-2022-25647', 7.5),
    ('pkg:maven/com.android.volley/volley@', '1.2.1', 'CVE-2021-39614', 6.5),
)
