"""Fixed values of flow findings and of test classes: labels, certain pairs, weaknesses and name patterns."""

PERSONAL = ("DEVICE_ID", "LOCATION", "ACCOUNT", "CONTACT", "CLIPBOARD", "USER_INPUT", "CAMERA_MIC")
CERTAIN_PAIRS = (
    ("USER_INPUT", "EXEC"), ("USER_INPUT", "SQL_INJECT"), ("USER_INPUT", "WEBVIEW"), ("USER_INPUT", "FILE_WRITE"), ("INTENT", "EXEC"),
    ("INTENT", "SQL_INJECT"), ("CONTENT_URI", "SQL_INJECT"), ("DEEP_LINK_DATA", "WEBVIEW"), ("DEEP_LINK_DATA", "SQL_INJECT"),
    ("DEEP_LINK_DATA", "EXEC"), ("DEVICE_ID", "NETWORK_OUT"), ("LOCATION", "NETWORK_OUT"), ("ACCOUNT", "NETWORK_OUT"),
)
NOISY_SOURCES = ("SHARED_PREFS", "PACKAGE_INFO", "FILE_READ", "NETWORK_IN")
#: (sink label, source labels or () for any, severity), the first that fits; MEDIUM if none does.
SEVERITIES = (
    ("NETWORK_OUT", (), "CRITICAL"), ("EXEC", (), "CRITICAL"),
    ("SQL_INJECT", ("CONTENT_URI", "INTENT", "USER_INPUT", "DEEP_LINK_DATA"), "CRITICAL"), ("SQL_INJECT", (), "HIGH"),
    ("LOG", ("DEVICE_ID", "LOCATION", "ACCOUNT", "CONTACT"), "HIGH"), ("STORAGE", ("DEVICE_ID", "LOCATION", "ACCOUNT", "CONTACT"), "HIGH"),
    ("IPC_OUT", ("DEVICE_ID", "LOCATION", "ACCOUNT", "CONTACT"), "HIGH"), ("PII_LOG", (), "HIGH"), ("PII_NETWORK", (), "HIGH"),
    ("WEBVIEW", ("DEEP_LINK_DATA", "USER_INPUT"), "CRITICAL"), ("WEBVIEW", (), "HIGH"), ("WEBVIEW_JS_INJECT", (), "CRITICAL"),
    ("IPC_REDIRECT", (), "HIGH"), ("DEEPLINK_REDIRECT", (), "HIGH"),
    ("OPEN_REDIRECT", ("DEEP_LINK_DATA", "CONTENT_URI", "INTENT", "USER_INPUT"), "HIGH"),
    ("FILE_WRITE", ("INTENT", "USER_INPUT", "DEEP_LINK_DATA"), "HIGH"),
)
WEAKNESSES = (
    ("DEVICE_ID", "NETWORK_OUT", "CWE-359"), ("LOCATION", "NETWORK_OUT", "CWE-359"), ("USER_INPUT", "EXEC", "CWE-78"), ("USER_INPUT", "STORAGE", "CWE-312"),
    ("INTENT", "EXEC", "CWE-78"), ("INTENT", "WEBVIEW", "CWE-79"), ("USER_INPUT", "WEBVIEW", "CWE-79"), ("DEEP_LINK_DATA", "WEBVIEW", "CWE-601"),
    ("DEEP_LINK_DATA", "WEBVIEW_JS_INJECT", "CWE-79"), ("DEEP_LINK_DATA", "OPEN_REDIRECT", "CWE-601"), ("DEEP_LINK_DATA", "DEEPLINK_REDIRECT", "CWE-940"),
    ("DEEP_LINK_DATA", "SQL_INJECT", "CWE-89"), ("CONTENT_URI", "SQL_INJECT", "CWE-89"), ("INTENT", "SQL_INJECT", "CWE-89"), ("USER_INPUT", "SQL_INJECT", "CWE-89"),
    ("INTENT", "IPC_REDIRECT", "CWE-939"), ("CONTENT_URI", "IPC_REDIRECT", "CWE-939"), ("DEEP_LINK_DATA", "IPC_REDIRECT", "CWE-939"),
    ("INTENT", "OPEN_REDIRECT", "CWE-601"), ("CONTENT_URI", "OPEN_REDIRECT", "CWE-601"), ("USER_INPUT", "FILE_WRITE", "CWE-22"), ("INTENT", "FILE_WRITE", "CWE-22"),
    ("DEEP_LINK_DATA", "FILE_WRITE", "CWE-22"), ("INTENT", "PENDING_INTENT", "CWE-926"), ("USER_INPUT", "PENDING_INTENT", "CWE-926"),
    ("USER_INPUT", "NETWORK_OUT", "CWE-359"), ("CONTACT", "NETWORK_OUT", "CWE-359"), ("CLIPBOARD", "NETWORK_OUT", "CWE-359"),
)
#: Patterns of class names that are generated or made for tests.
TEST_CLASSES = (
    r"/(?:test|androidTest|robolectric|espresso)/",
    r"/BuildConfig(?:\$|;|$)",
    r"/R\$",
    r"/(?:JUnit|Junit|junit|Espresso|espresso|Robolectric|robolectric|Mockito|mockito|PowerMock|powermock|Truth|truth)\w*[/$;]",
    r"(?:/|\$)(?:Test|Mock|Fake|Stub|Debug)(?:[A-Z0-9]\w*)?(?:\$|;|$)",
    r"(?:/|\$)\w*?[a-z0-9](?:Test|Mock|Fake|Stub|Debug)(?:s)?(?:\$|;|$)",
)

#: Parts of a call's text that write to a container, and that read from one.
CONTAINER_WRITES = (
    "Map;->put", "Map;->putAll", "HashMap;->put", "ConcurrentHashMap;->put", "LinkedHashMap;->put", "ArrayMap;->put", "TreeMap;->put",
    "Collection;->add", "Collection;->addAll", "List;->add", "ArrayList;->add", "LinkedList;->add", "Set;->add", "HashSet;->add",
    "LinkedHashSet;->add", "TreeSet;->add", "Bundle;->put",
)
CONTAINER_READS = (
    "Map;->get", "Map;->getOrDefault", "Map;->values", "Map;->keySet", "Map;->entrySet", "HashMap;->get", "ConcurrentHashMap;->get",
    "LinkedHashMap;->get", "ArrayMap;->get", "TreeMap;->get", "List;->get", "ArrayList;->get", "LinkedList;->get", "Collection;->iterator",
    "List;->iterator", "Set;->iterator", "Iterable;->iterator", "Iterator;->next", "Bundle;->get",
)
