"""Headers, times, primitives, hashes and redaction as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.urls import SECRET_NAME

#: Response headers that evidence keeps, and request headers that may be sent.
SAFE_RESPONSE_HEADERS = ["cache-control", "content-encoding", "content-length", "content-type", "date", "etag", "last-modified"]
SAFE_REQUEST_HEADERS = ["accept", "accept-language", "if-modified-since", "if-none-match", "user-agent"]
#: Object keys whose values are never stored.
SECRET_KEY = r"(?i)(?:^|[-_])(api[-_]?key|authorization|cookie|credential|password|proxy[-_]?authorization|secret|session|token)(?:$|[-_])"
NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
REDACTED = "[redacted]"


def lower_names(headers: Column, joined: Callable[[Column], Column]) -> Column:
    """A map by lower-case names; ``joined`` makes one value of those whose names differ by case only, in their order."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(k)))
    values = lambda name: F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == name), lambda e: e["value"])
    return F.map_from_arrays(names, F.transform(names, lambda name: joined(values(name))))


def safe_headers(headers: Column) -> Column:
    """Lower-case response headers that may be kept: named ones, of at most 4096 characters in one line; the last of equal names."""
    named = lower_names(headers, lambda values: F.element_at(values, -1))
    return F.map_filter(named, lambda k, v: k.isin(SAFE_RESPONSE_HEADERS) & (F.length(v) <= 4096) & ~v.rlike(r"[\r\n\x00]"))


def request_headers(headers: Column, each: int = 8192, total: int = 16384) -> Column:
    """Request headers by allowlist; null where one is too long or all together are."""
    kept = F.map_filter(headers, lambda k, v: F.lower(k).isin(SAFE_REQUEST_HEADERS) & ~v.rlike(r"[\r\n\x00]"))
    sizes = F.transform(F.map_entries(kept), lambda e: F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return F.when(F.forall(sizes, lambda n: n <= each) & (F.aggregate(sizes, F.lit(0), lambda a, b: a + b) <= total), kept)


def retry_after_ms(value: Column, now: Column) -> Column:
    """Retry-After: seconds, or an HTTP date after ``now``; else 0."""
    seconds = F.when(F.trim(value).rlike(r"^(?:\d+(?:\.\d*)?|\.\d+)$"), F.trim(value).cast("double"))
    date = F.try_to_timestamp(F.regexp_extract(value, r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.round(seconds * 1000).cast("long"), F.greatest(F.lit(0).cast("long"), F.unix_millis(date) - F.unix_millis(now)), F.lit(0).cast("long"))


def crawl_delay_ms(value: Column) -> Column:
    """Crawl-delay in milliseconds, rounded up, from 0 to a day; null if it is no such number."""
    number = F.when(F.trim(value).rlike(r"^\d+(?:\.\d+)?$"), F.trim(value).cast("double"))
    return F.when(number <= 86400, F.ceil(number * 1000).cast("long"))


def coerce_number(value: Column) -> Column:
    """The number a string spells, or null."""
    text = F.trim(value)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def coerce_boolean(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)


def coerced(value: Column, expected: str | None) -> Column:
    """The value as JSON text after coercion: integral numbers without a point, booleans, else the string."""
    quoted = F.to_json(F.struct(value.alias("v")))
    plain = F.regexp_extract(quoted, r'^\{"v":(.*)\}$', 1)
    if expected == "number":
        n = coerce_number(value)
        return F.when(n.isNull(), plain).when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("long").cast("string")).otherwise(n.cast("string"))
    if expected == "boolean":
        b = coerce_boolean(value)
        return F.coalesce(b.cast("string"), plain)
    return plain


def clean_text(value: Column) -> Column:
    """Lines with single spaces, empty lines dropped."""
    lines = F.transform(F.split(F.replace(value, F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\f\x0b]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def object_path(hash_ref: Column) -> Column:
    """Where an object lies, a function of its hash alone; null for a malformed hash."""
    h = F.substring(hash_ref, 8, 64)
    return F.when(hash_ref.rlike("^sha256:[0-9a-f]{64}$"), F.concat(F.lit("objects/sha256/"), F.substring(h, 1, 2), F.lit("/"), h))


def redact_map(values: Column) -> Column:
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEY), REDACTED).otherwise(v))


def redact_query(url: Column) -> Column:
    """A plain URL with the values of secret query names replaced, natively."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.transform(F.split(query, "&"), lambda p: F.when(F.regexp_extract(p, "^([^=]*)", 1).rlike(f"(?i){SECRET_NAME}"), F.concat(F.regexp_extract(p, "^([^=]*)", 1), F.lit("=%5Bredacted%5D"))).otherwise(p))
    return F.when(query == "", url).otherwise(F.concat(F.substring_index(url, "?", 1), F.lit("?"), F.array_join(parts, "&"), F.regexp_extract(url, "(#.*)$", 1)))


def fingerprint(url: Column, fmt: str = "markdown", policy: str = "public", adapter: str = "native", decode_limit: int = 52_428_800) -> Column:
    """Request fingerprint: SHA-256 of canonical JSON with keys in order and the URL without fragment."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.regexp_replace(url, "#.*$", "").alias("v"))), r'^\{"v":(.*)\}$', 1)
    text = F.concat(F.lit(f'{{"adapter":"{adapter}","canonicalUrl":'), quoted, F.lit(f',"decodeLimit":{decode_limit},"format":"{fmt}","headers":{{}},"method":"GET","policy":"{policy}"}}'))
    return F.sha2(text.cast("binary"), 256)


def is_fresh(observed: Column, now: Column, most_ms: int) -> Column:
    """Seen not in the future and not longer ago than the age."""
    return F.coalesce((F.unix_millis(now) - F.unix_millis(observed)).between(0, most_ms), F.lit(False))


def iso_ms(ms: Column) -> Column:
    """Epoch milliseconds as ISO-8601 in UTC (the session's zone is UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def compact_run_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMMdd'T'HHmmssSSS'Z'")
