"""Word lists, patterns and thresholds that results depend on.

They are contract data (a different word list gives different results), so they
are kept together here as plain text and every operator reads them from here.
"""

# Log levels.
LEVELS = ["INFO", "DEBUG", "WARNING", "ERROR", "CRITICAL"]
LEVEL_SYNONYMS = {"WARN": "WARNING", "FATAL": "CRITICAL"}
ERROR_LEVELS = ["WARNING", "ERROR", "CRITICAL"]

# Field aliases of JSON objects, in priority order.
JSON_ALIASES = {
    "message": ["message", "msg", "log"],
    "level": ["level", "severity"],
    "service": ["service", "service_name", "logger"],
    "time": ["timestamp", "time", "date"],
    "status": ["status_code", "status"],
    "request": ["request_id", "req_id", "trace_id"],
}

# Column aliases of CSV files (the first matching header wins).
CSV_ALIASES = {
    "time": ["timestamp", "time", "date", "created_at"],
    "service": ["service", "service_name", "app", "component"],
    "level": ["level", "severity", "type"],
    "message": ["message", "msg", "log", "text"],
    "status": ["status", "status_code", "code"],
    "request": ["request_id", "req_id", "trace_id"],
}

# Line shapes. Where a pattern would test a word boundary at every position,
# a look-ahead on the first character comes first, which is far cheaper.
BRACKET_LINE = r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+\[([^\]]+)\]\s*(?:\[([^\]]+)\])?\s*(.*)$"
SYSLOG_LINE = (
    r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?)"
    r"\s+([^\s:]+)\s+([A-Z]+)\s*:\s*(.*)$"
)
ANY_STAMP = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
ANY_LEVEL = r"(?=[DIWECF])\b(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\b"
ANY_SERVICE = r"\b([a-z0-9_\-]+-service|[a-z0-9_\-]+-api|gateway|database|auth|payment)\b"  # on lower case
FALLBACK_TRIM = ": \t[]-"

# Names in dates.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

# Status codes and request ids.
STATUS_CODE = r"(?=[45])\b([45]\d{2})\b"
REQUEST_KEY_VALUE = r"\b(?:request_id|req_id|trace_id)=([^\s,]+)"
REQUEST_TRIM = "[]{}()\"'"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
REQUEST_UUID = r"(?=[0-9a-fA-F]{8}-)\b(" + UUID + r")\b"

# Operational phrases, matched in any case.
OPERATIONAL_PHRASES = {
    "connection_refused": ["connection refused", "failed to connect", "cannot connect"],
    "timeout": ["timeout", "timed out", "latency exceeded"],
    "database_error": ["database error", "postgresql", "mysql", "sqlstate", "db connection"],
    "auth_failure": ["auth", "authentication", "unauthorized", "forbidden", "invalid credentials", "401", "403"],
    "service_unavailable": ["unavailable", "service unavailable", "503", "down"],
    "out_of_memory": ["out of memory", "oom", "heap space", "memory exhaustion"],
}

# Message masks, applied in this order.
MESSAGE_MASKS = [
    ("<TIMESTAMP>", r"(?=\d)\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"),
    ("<IP>", r"(?=\d)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("<UUID>", r"(?=[0-9a-fA-F]{8}-)\b" + UUID + r"\b"),
    ("<HEX>", r"(?=0x)\b0x[0-9a-fA-F]+\b"),
    ("<EMAIL>", r"\b[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    ("<NUM>", r"(?=\d)\b\d+\b"),
]
BLANK_TEMPLATE = "generic_log_event"

# Service name keywords.
INFRA_KEYWORDS = [
    "db", "database", "postgres", "sql", "redis", "cache", "auth", "identity",
    "broker", "queue", "rabbitmq", "kafka", "network", "dns", "storage", "s3",
]
SERVICE_TYPE_KEYWORDS = [
    ("database", ["db", "database", "postgres", "sql"]),
    ("gateway", ["gateway", "nginx"]),
    ("external", ["external", "stripe", "twilio", "aws"]),
]
DEPENDENCY_WORDS = ["database", "connection"]

# Incident vocabulary.
STATUSES = ["OPEN", "INVESTIGATING", "RESOLVED", "CLOSED"]
OPEN_STATUSES = ["OPEN", "INVESTIGATING"]
ENDED_STATUSES = ["RESOLVED", "CLOSED"]
SEVERITY_WEIGHT = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}

# Accepted file suffixes.
LOG_SUFFIXES = [".log", ".txt", ".csv", ".json"]
