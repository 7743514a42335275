"""Classification of failure messages by ordered rules, as one `when` chain over the lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds, their group and whether a retry may help.
KINDS = {
    "tunnel_down": ("net", True), "send_blocked": ("net", True), "recv_dropped": ("net", True), "rate_limit": ("bill", True), "quota": ("bill", False),
    "bad_key": ("auth", False), "model_unavailable": ("model", False), "geo_block": ("auth", False), "edge_block": ("net", True), "overload": ("srv", True),
    "model_empty": ("model", True), "model_garbage": ("model", True), "db_down": ("store", True), "storage_fail": ("store", True), "local_io": ("local", False),
    "empty_text": ("model", True), "empty_page": ("model", True), "no_render": ("local", True), "pdf_broken": ("local", False), "bad_file": ("local", False),
    "no_source": ("local", False), "not_ready": ("local", False), "bad_bbox": ("local", False), "vocab_invalid": ("local", False), "unknown": ("misc", True),
}
# Words that name a local refusal, in the order they are tried.
LOCAL = {
    "no_source": ["no source file", "has no source", "source file is missing", "missing source"],
    "not_ready": ["not ready", "is not ready", "batch not ready"],
    "bad_bbox": ["bad bbox", "invalid bbox", "bbox is empty", "degenerate box"],
    "vocab_invalid": ["not in the vocabulary", "unknown tag", "vocabulary"],
    "pdf_broken": ["pdfium", "password", "encrypted", "invalid pdf", "corrupt", "failed to open the pdf", "cannot open the pdf"],
    "bad_file": ["unsupported file type"],
    "no_render": ["no page render", "no page image"],
    "empty_page": ["no text content", "produced no text", "empty text", "no text on page"],
}
# The other words, by rule.
GARBAGE = ["non-json text", "jsondecodererror", "expecting value", "substring not found"]
NO_MODEL = ["not found for api version", "not supported for generatecontent", "listpublishedmodels"]
DATABASE = ["psycopg", "postgres", "could not connect to server", "connection to server"]
GEO = ["perusercountryregistration", "not available in your country", "not available in your region", "region not supported", "service is only available in"]
EDGE = ["forbidden)!!1", "errors/robot.png", "does not have permission to get url", "gstatic.com/external_content"]
KEY = ["api_key_invalid", "api key not valid", "unauthenticated"]
BUSY = ["deadline_exceeded", "unavailable", "internal error", "overloaded"]
PROXY = ["proxyerror", "invalidurl", "missingschema", "invalidschema", "proxy scheme not supported", "tunnel connection failed", "cannot connect to proxy"]
TLS = ["sslerror", "ssleoferror", "certificateerror", "sslcertverificationerror", "certificate", "tlsv1", "wrapsocket", "wrong version number", "unknown protocol"]
DROPPED = [
    "connectionerror", "connectionreseterror", "connectionabortederror", "chunkedencodingerror", "protocolerror", "remoteprotocolerror",
    "connection reset", "reset by peer", "connection aborted", "remote end closed", "broken pipe",
]
DOWN = ["failed to establish", "unreachable", "name or service not known", "nodename", "getaddrinfo", "network is unreachable", "max retries exceeded"]
FILES = ["filenotfounderror", "permissionerror", "isadirectoryerror", "shutilerror", "fileexistserror", "no such file"]
WRITES = [
    "psycopg2", "invalid input syntax", "violates", "duplicate key value", "does not exist", "undefinedtable", "undefinedcolumn", "null value in column",
    "out of memory", "terminating connection", "server closed the connection",
]


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def classify(message: Column) -> Column:
    """The kind of a failure by the first rule that its message meets; null and unmatched texts are 'unknown'."""
    t = F.lower(F.coalesce(message, F.lit("")))
    status = F.regexp_extract(t, r"http ([0-9]{3})", 1).try_cast("int")
    vendor = _any(t, ["generativelanguage", "gemini"])
    storage = _any(t, ["supabase", "storage/v1/object"])
    rules: list[tuple[Column, str]] = []
    local = ~vendor & ~storage & status.isNull()
    rules += [(local & _any(t, words), kind) for kind, words in LOCAL.items()]
    is_status = lambda *n: F.coalesce(status.isin(*n), F.lit(False))
    limited = is_status(429) | _any(t, ["resource_exhausted", "rate limit"])
    refused = is_status(401, 403) | _any(t, KEY)
    busy = is_status(500, 502, 503, 504) | _any(t, BUSY)
    rules += [
        (t.contains("no text content"), "model_empty"),
        (_any(t, GARBAGE), "model_garbage"),
        ((is_status(404) & (vendor | t.contains("model"))) | _any(t, NO_MODEL), "model_unavailable"),
        (~vendor & ~storage & _any(t, DATABASE), "db_down"),
        (limited & _any(t, ["resource_exhausted", "quota"]), "quota"),
        (limited, "rate_limit"),
        (_any(t, GEO), "geo_block"),
        (_any(t, EDGE), "edge_block"),
        (refused & storage, "storage_fail"),
        (refused & is_status(403) & vendor & _any(t, ["permission_denied", "permission denied"]), "geo_block"),
        (refused, "bad_key"),
        (busy & storage, "storage_fail"),
        (busy, "overload"),
        (_any(t, PROXY) | (t.contains("proxy") & t.contains("cannot connect")) | _any(t, TLS), "tunnel_down"),
        (t.contains("connecttimeout"), "send_blocked"),
        (_any(t, ["readtimeout", "read timeout", "timed out", "timeout"]), "recv_dropped"),
        (_any(t, DROPPED) & _any(t, DOWN), "tunnel_down"),
        (_any(t, DROPPED), "recv_dropped"),
        (t.contains("max retries exceeded"), "tunnel_down"),
        (_any(t, FILES), "local_io"),
        (_any(t, WRITES), "db_down"),
        (storage, "storage_fail"),
    ]
    out = F.lit("unknown")
    for condition, kind in reversed(rules):
        out = F.when(condition, kind).otherwise(out)
    return out


def group_of(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (g, _) in KINDS.items() for x in (k, g)])[kind]


def is_retryable(kind: Column) -> Column:
    return kind.isin([k for k, (_, again) in KINDS.items() if again])
