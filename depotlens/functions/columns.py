"""Scalar functions as native column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_TIME = "0001-01-01 00:00:00"
LOCAL_ZONE = "America/Los_Angeles"

#: Request kind and the scan type stored for it.
SCAN_TYPES = {"Local": "local", "GDrive": "google_drive", "GMail": "gmail", "GPhotos": "photos"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_chars(x, n: int) -> Column:
    """The first n code points; null stays null."""
    return F.left(_c(x), F.lit(n))


def concat_skip_null(*xs) -> Column:
    """Concatenation in which a null counts as empty."""
    return F.concat_ws("", *map(_c, xs))


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def duration_seconds(start, end) -> Column:
    """Seconds with fraction between two timestamps, -1 while either is null."""
    return F.coalesce(micros_between(start, end) / F.lit(1e6), F.lit(-1.0))


def duration_millis(start, end) -> Column:
    """Whole milliseconds between two timestamps, cut toward zero."""
    return F.call_function("div", micros_between(start, end), F.lit(1000))


def utc_to_local(ts, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall time to the wall time of ``zone``, with daylight saving."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts))


def md5_hex(x) -> Column:
    return F.md5(_c(x).cast("binary"))


def join_labels(labels) -> Column:
    """Labels joined by commas; no labels give an empty string."""
    return F.coalesce(F.array_join(_c(labels), ","), F.lit(""))


def millis_to_timestamp(ms) -> Column:
    """Epoch milliseconds to UTC seconds, the fraction dropped."""
    seconds = F.call_function("div", _c(ms), F.lit(1000))
    return F.call_function("timestamp_seconds", seconds).cast("timestamp_ntz")


def header_value(headers, name: str) -> Column:
    """The last header of exactly this name, or an empty string."""
    found = F.filter(_c(headers), lambda h: h["name"] == F.lit(name))
    return F.coalesce(F.try_element_at(found, F.lit(-1))["value"], F.lit(""))


def parse_rfc3339(x) -> Column:
    """A timestamp, or year one where the text is no timestamp."""
    parsed = F.try_to_timestamp(_c(x)).cast("timestamp_ntz")
    return F.coalesce(parsed, F.lit(ZERO_TIME).cast("timestamp_ntz"))


def parse_utc_seconds(x) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` to a timestamp, or null."""
    return F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz")


def human_size(x) -> Column:
    """Bytes as ``512 B`` or ``1.5 KB``; ties in the decimal round to even."""
    n = _c(x).cast("double")
    out = F.when(n.isNull(), F.lit(None).cast("string")).when(n < 1024, F.format_string("%d B", _c(x).cast("bigint")))
    units = ("KB", "MB", "GB", "TB", "PB", "EB")
    for k, unit in enumerate(units, 1):
        scaled = F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**k)), 1))
        out = out.otherwise(scaled) if unit == units[-1] else out.when(n < 1024 ** (k + 1), scaled)
    return out


def mask_account(display_name, client_key) -> Column:
    """``abcdefg@x.com`` to ``abc****fg@x.com``; anything else gives the key."""
    name = _c(display_name)
    at = F.instr(name, "@")
    user = at - 1
    masked = F.concat(F.left(name, F.lit(3)), F.lit("****"), F.substring(name, user - 1, F.lit(2)), F.substring(name, at, F.length(name)))
    return F.when((at > 0) & (user >= 6), masked).otherwise(_c(client_key))


def is_retryable(code, reason) -> Column:
    """Too many requests, or a refusal for the rate limit."""
    hit = (_c(code) == 429) | ((_c(code) == 403) & (_c(reason) == "rateLimitExceeded"))
    return F.coalesce(hit, F.lit(False))


def to_int(x, default: int) -> Column:
    """The number that a text holds, or the default."""
    return F.coalesce(_c(x).try_cast("int"), F.lit(default))


def content_url(base_url, mime) -> Column:
    """Download address of an image or a video; others have none."""
    kind = F.substring(_c(mime), 1, 5)
    return F.when(kind == "image", F.concat(_c(base_url), F.lit("=d"))).when(kind == "video", F.concat(_c(base_url), F.lit("=dv")))


def slash_date(d) -> Column:
    return F.date_format(_c(d), "yyyy/MM/dd")


def prefix_fields(fields, prefix: str) -> Column:
    return F.transform(_c(fields), lambda x: F.concat(F.lit(prefix), x))


def is_blank(x) -> Column:
    return F.coalesce(F.length(F.trim(_c(x))) == 0, F.lit(True))


def stored_scan_type(kind) -> Column:
    """The stored name of a request kind; unknown kinds give null."""
    table = F.create_map(*[F.lit(x) for kv in SCAN_TYPES.items() for x in kv])
    return table[_c(kind)]


def as_json(*cols) -> Column:
    return F.to_json(F.struct(*cols))


def nullable_json(x, field: str = "String") -> Column:
    """The ``{value, Valid}`` object by which clients receive a nullable text."""
    c = _c(x)
    return F.struct(F.coalesce(c, F.lit("")).alias(field), c.isNotNull().alias("Valid"))
