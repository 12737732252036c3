"""Word lists, weights and codes that results depend on."""

# HTTP status codes and weights (success, client error, server error).
SUCCESS_CODES = [(200, 70), (201, 5), (204, 5), (206, 2), (301, 3), (302, 3), (304, 10), (307, 2)]
CLIENT_ERROR_CODES = [(400, 20), (401, 25), (403, 15), (404, 30), (405, 3), (408, 2), (409, 2), (422, 2), (429, 1)]
SERVER_ERROR_CODES = [(500, 50), (502, 20), (503, 20), (504, 10)]

# HTTP methods and log levels with weights in percent of 256 slots.
METHODS = [("GET", 60), ("POST", 20), ("PUT", 8), ("DELETE", 5), ("PATCH", 4), ("HEAD", 2), ("OPTIONS", 1)]
LOG_LEVELS = [("DEBUG", 5), ("INFO", 70), ("WARN", 15), ("ERROR", 8), ("FATAL", 2)]
REST_LEVEL = "INFO"

# Protocol table (four equal slots).
PROTOCOL_SLOTS = ["HTTP/1.0", "HTTP/1.1", "HTTP/1.1", "HTTP/2.0"]

# Referring sites; 154 of 256 slots carry "-".
NO_REFERRER_SLOTS = 154
REFERRERS = [
    "https://www.google.com/",
    "https://www.bing.com/",
    "https://www.facebook.com/",
    "https://twitter.com/",
    "https://www.reddit.com/",
    "https://www.linkedin.com/",
    "https://github.com/",
]

# Services and hosts (eight each, uniform).
SERVICES = [
    "api-gateway",
    "user-service",
    "auth-service",
    "payment-service",
    "order-service",
    "inventory-service",
    "notification-service",
    "search-service",
]
HOSTS = ["web-01", "web-02", "web-03", "api-01", "api-02", "worker-01", "worker-02", "db-01"]

# Named users, the upper half of 64 slots; the lower half is "-".
ANONYMOUS_SLOTS = 32
USERNAMES = [
    "john", "jane", "bob", "alice", "admin", "user", "guest", "test",
    "mike", "sarah", "david", "emma", "chris", "lisa", "tom", "anna",
    "api_user", "service", "system", "root", "www-data", "nginx", "app", "worker",
    "user1", "user2", "user3", "user4", "user5", "demo", "dev", "prod",
]

# URL path parts.
PATH_POOL_SIZE = 4096
PATH_PREFIXES = [
    "/api/v1", "/api/v2", "/api", "/v1", "/v2", "/users", "/products", "/orders",
    "/auth", "/admin", "/static", "/assets", "/images", "/css", "/js", "/",
]
PATH_SEGMENTS = [
    "list", "create", "update", "delete", "get", "search", "login", "logout", "register", "profile", "settings",
    "dashboard", "reports", "analytics", "health", "status", "metrics", "webhook", "callback", "download", "upload",
    "export", "import",
]
PATH_EXTENSIONS = [".html", ".css", ".js", ".json", ".png", ".jpg", ".svg", ".ico", ".woff2", ".map"]
PATH_RESOURCES = ["users", "products", "orders", "sessions"]
PAGE_LIMITS = [10, 20, 25, 50, 100]
SIMPLE_PATHS = ["/", "/index.html", "/favicon.ico", "/robots.txt", "/sitemap.xml", "/health", "/ready", "/live"]

# IP address pool.
IP_POOL_SIZE = 65536

# User agents by family with the family's share in percent.
UA_POOL_SIZE = 256
USER_AGENT_FAMILIES = [
    (50, [
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Safari/537.36",
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
        "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    ]),
    (15, [
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0",
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 10.15; rv:121.0) Gecko/20100101 Firefox/121.0",
        "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    ]),
    (10, [
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Safari/605.1.15",
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.0.0",
    ]),
    (15, [
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1",
        "Mozilla/5.0 (iPad; CPU OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1",
        "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36",
        "Mozilla/5.0 (Linux; Android 14; SM-S918B) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36",
    ]),
    (5, [
        "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
        "Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)",
        "Mozilla/5.0 (compatible; YandexBot/3.0; +http://yandex.com/bots)",
    ]),
    (5, [
        "curl/8.4.0", "python-requests/2.31.0", "Go-http-client/2.0", "axios/1.6.2", "PostmanRuntime/7.35.0",
        "okhttp/4.12.0", "Wget/1.21.4", "HTTPie/3.2.2",
    ]),
]

# Messages by status and by level.
STATUS_MESSAGES = [
    ((200, 201), "Request processed successfully"),
    ((204,), "No content returned"),
    ((301, 302, 307), "Redirect issued"),
    ((304,), "Not modified"),
    ((400,), "Bad request"),
    ((401,), "Unauthorized access attempt"),
    ((403,), "Forbidden resource access"),
    ((404,), "Resource not found"),
    ((429,), "Rate limit exceeded"),
    ((500,), "Internal server error"),
    ((502,), "Bad gateway"),
    ((503,), "Service unavailable"),
    ((504,), "Gateway timeout"),
]
DEFAULT_STATUS_MESSAGE = "Request handled"
LEVEL_MESSAGES = [
    ("DEBUG", "Debug checkpoint reached"),
    ("INFO", "Operation completed successfully"),
    ("WARN", "Potential issue detected"),
    ("ERROR", "Error occurred during processing"),
    ("FATAL", "Critical failure, service impacted"),
]
DEFAULT_LEVEL_MESSAGE = "Log event recorded"

# Syslog severities; facility local0 is 16.
SYSLOG_FACILITY = 16
SEVERITIES = [("DEBUG", 7), ("INFO", 6), ("WARN", 4), ("ERROR", 3), ("FATAL", 2)]
DEFAULT_SEVERITY = 6

# Rate presets as (name, MB per second, logs per second).
RATE_PRESETS = [
    ("trickle", 10, 50_000),
    ("low", 100, 500_000),
    ("medium", 500, 2_500_000),
    ("high", 750, 3_750_000),
    ("full", 1000, 5_000_000),
    ("max", 2000, 10_000_000),
]
MIB = 1024 * 1024

# Formats with the estimated line size in bytes.
FORMAT_SIZES = [("apache", 250), ("nginx", 260), ("json", 350), ("syslog", 220), ("event", 250)]
FORMATS = [name for name, _ in FORMAT_SIZES]

# Spike types with their display names.
SPIKE_TYPES = [
    ("error_burst", "ErrorBurst"),
    ("latency_spike", "LatencySpike"),
    ("unusual_patterns", "UnusualPatterns"),
    ("mixed", "Mixed"),
]
