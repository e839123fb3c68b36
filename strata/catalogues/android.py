"""Catalogues of the platform: permissions, entry points and class prefixes."""

#: Permissions that a user has to grant.
DANGEROUS_PERMISSIONS = (
    'android.permission.ACCESS_FINE_LOCATION',
    'android.permission.ACCESS_COARSE_LOCATION',
    'android.permission.ACCESS_BACKGROUND_LOCATION',
    'android.permission.READ_CONTACTS',
    'android.permission.WRITE_CONTACTS',
    'android.permission.READ_CALL_LOG',
    'android.permission.WRITE_CALL_LOG',
    'android.permission.READ_CALENDAR',
    'android.permission.WRITE_CALENDAR',
    'android.permission.READ_SMS',
    'android.permission.RECEIVE_SMS',
    'android.permission.SEND_SMS',
    'android.permission.RECEIVE_WAP_PUSH',
    'android.permission.RECEIVE_MMS',
    'android.permission.READ_PHONE_STATE',
    'android.permission.READ_PHONE_NUMBERS',
    'android.permission.CALL_PHONE',
    'android.permission.ANSWER_PHONE_CALLS',
    'android.permission.ADD_VOICEMAIL',
    'android.permission.USE_SIP',
    'android.permission.PROCESS_OUTGOING_CALLS',
    'android.permission.READ_EXTERNAL_STORAGE',
    'android.permission.WRITE_EXTERNAL_STORAGE',
    'android.permission.READ_MEDIA_IMAGES',
    'android.permission.READ_MEDIA_VIDEO',
    'android.permission.READ_MEDIA_AUDIO',
    'android.permission.READ_MEDIA_VISUAL_USER_SELECTED',
    'android.permission.CAMERA',
    'android.permission.RECORD_AUDIO',
    'android.permission.BODY_SENSORS',
    'android.permission.BODY_SENSORS_BACKGROUND',
    'android.permission.USE_BIOMETRIC',
    'android.permission.USE_FINGERPRINT',
    'android.permission.ACTIVITY_RECOGNITION',
    'android.permission.GET_ACCOUNTS',
    'android.permission.BLUETOOTH_SCAN',
    'android.permission.BLUETOOTH_CONNECT',
    'android.permission.BLUETOOTH_ADVERTISE',
    'android.permission.NEARBY_WIFI_DEVICES',
    'android.permission.UWB_RANGING',
    'android.permission.POST_NOTIFICATIONS',
    'android.permission.SCHEDULE_EXACT_ALARM',
    'android.permission.USE_EXACT_ALARM',
    'android.permission.MANAGE_MEDIA',
    'android.permission.HIDE_OVERLAY_WINDOWS',
    'android.permission.MANAGE_WIFI_INTERFACES',
    'android.permission.READ_BASIC_PHONE_STATE',
)

#: Fixed values: (permission, kind of data).
DATA_SAFETY = (
    ('android.permission.ACCESS_FINE_LOCATION', 'Precise Location'),
    ('android.permission.ACCESS_COARSE_LOCATION', 'Approximate Location'),
    ('android.permission.ACCESS_BACKGROUND_LOCATION', 'Background Location'),
    ('android.permission.READ_CONTACTS', 'Contacts'),
    ('android.permission.WRITE_CONTACTS', 'Contacts'),
    ('android.permission.READ_CALL_LOG', 'Call Logs'),
    ('android.permission.RECORD_AUDIO', 'Audio Files'),
    ('android.permission.CAMERA', 'Photos and Videos'),
    ('android.permission.READ_SMS', 'SMS/MMS Messages'),
    ('android.permission.READ_PHONE_STATE', 'Phone Number/Device ID'),
    ('android.permission.GET_ACCOUNTS', 'Personal Info (Accounts)'),
    ('android.permission.USE_BIOMETRIC', 'Biometric Data'),
    ('android.permission.USE_FINGERPRINT', 'Biometric Data'),
    ('android.permission.READ_EXTERNAL_STORAGE', 'Files and Docs'),
    ('android.permission.BODY_SENSORS', 'Health and Fitness'),
    ('android.permission.ACTIVITY_RECOGNITION', 'App Activity'),
)

#: Names that the platform calls.
LIFECYCLE_METHODS = (
    'onCreate',
    'onStart',
    'onResume',
    'onPause',
    'onStop',
    'onDestroy',
    'onRestart',
    'onSaveInstanceState',
    'onRestoreInstanceState',
    'onActivityResult',
    'onRequestPermissionsResult',
    'onNewIntent',
    'onBackPressed',
    'onOptionsItemSelected',
    'onContextItemSelected',
    'onCreateOptionsMenu',
    'onPrepareOptionsMenu',
    'onWindowFocusChanged',
    'onConfigurationChanged',
    'onCreateView',
    'onViewCreated',
    'onActivityCreated',
    'onAttach',
    'onDetach',
    'onDestroyView',
    'onHiddenChanged',
    'onViewStateRestored',
    'onReceive',
    'onStartCommand',
    'onBind',
    'onUnbind',
    'onRebind',
    'onTaskRemoved',
    'onHandleIntent',
    'onHandleWork',
    'onStartJob',
    'onStopJob',
    'doWork',
    'startWork',
    'getForegroundInfoAsync',
    'query',
    'insert',
    'update',
    'delete',
    'getType',
    'call',
    'openFile',
    'openAssetFile',
    'applyBatch',
    'attachBaseContext',
    'onClick',
    'onLongClick',
    'onTouch',
    'onKey',
    'onFocusChange',
    'onCheckedChanged',
    'onItemClick',
    'onItemLongClick',
    'onItemSelected',
    'onTextChanged',
    'afterTextChanged',
    'beforeTextChanged',
    'onBindViewHolder',
    'onCreateViewHolder',
    'handleMessage',
    'run',
    'subscribe',
    'onNext',
    'onError',
    'onComplete',
    'onMessageReceived',
    'onNewToken',
    'onNotificationReceived',
    '<init>',
    '<clinit>',
)

#: Names that the platform calls.
COMPONENT_BASES = (
    'Landroid/app/Activity;',
    'Landroidx/appcompat/app/AppCompatActivity;',
    'Landroidx/fragment/app/FragmentActivity;',
    'Landroid/app/ListActivity;',
    'Landroid/preference/PreferenceActivity;',
    'Landroid/app/Fragment;',
    'Landroidx/fragment/app/Fragment;',
    'Landroid/preference/PreferenceFragment;',
    'Landroidx/preference/PreferenceFragmentCompat;',
    'Landroid/app/Service;',
    'Landroid/app/IntentService;',
    'Landroidx/core/app/JobIntentService;',
    'Landroid/content/BroadcastReceiver;',
    'Landroid/content/ContentProvider;',
    'Landroid/app/Application;',
    'Landroidx/multidex/MultiDexApplication;',
    'Landroid/view/View;',
    'Landroid/view/ViewGroup;',
    'Landroidx/work/Worker;',
    'Landroidx/work/ListenableWorker;',
    'Landroidx/work/CoroutineWorker;',
    'Landroidx/work/RxWorker;',
    'Landroid/app/job/JobService;',
    'Lcom/google/firebase/messaging/FirebaseMessagingService;',
    'Lcom/google/firebase/iid/FirebaseInstanceIdService;',
    'Landroidx/recyclerview/widget/RecyclerView$Adapter;',
    'Landroidx/recyclerview/widget/RecyclerView$ViewHolder;',
)

#: Names that the platform calls.
CALLBACK_INTERFACES = (
    'Landroid/view/View$OnClickListener;',
    'Landroid/view/View$OnLongClickListener;',
    'Landroid/view/View$OnTouchListener;',
    'Landroid/widget/CompoundButton$OnCheckedChangeListener;',
    'Landroid/widget/AdapterView$OnItemClickListener;',
    'Landroid/widget/AdapterView$OnItemSelectedListener;',
    'Landroid/text/TextWatcher;',
    'Landroid/os/Handler$Callback;',
    'Ljava/lang/Runnable;',
    'Ljava/util/concurrent/Callable;',
    'Lio/reactivex/functions/Consumer;',
    'Lio/reactivex/functions/Action;',
)

#: Class prefixes.
INFRA_PREFIXES = (
    'Ljava/',
    'Ljavax/',
    'Lsun/',
    'Ldalvik/',
)

#: Class prefixes.
KOTLIN_INFRA_PREFIXES = (
    'Lkotlin/',
    'Lkotlinx/coroutines/',
)

#: Class prefixes.
FRAMEWORK_BULK_PREFIXES = (
    'Lcom/google/android/gms/internal/',
    'Lcom/google/android/material/internal/',
    'Landroidx/core/internal/',
    'Landroidx/collection/',
)

#: Class prefixes.
SECURITY_SINK_PREFIXES = (
    'Landroid/webkit/WebView',
    'Landroid/database/sqlite/',
    'Landroid/content/ContentResolver',
    'Landroid/app/PendingIntent',
    'Ljava/lang/Runtime',
    'Ljava/lang/ProcessBuilder',
)

#: Words in a link's scheme or host that tell of a log-in.
LOGIN_WORDS = ("oauth", "auth", "callback", "redirect", "login", "sso", "token", "authorize")
