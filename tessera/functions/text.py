"""Column functions for keys, addresses, headers and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = 65_536


def hash_point(key: Column) -> Column:
    """A key's place among POINTS hash points: the first two bytes of its SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 4), 16, 10).cast("bigint")


def common_prefix(key: Column, prefix: str, delimiter: str | None) -> Column:
    """The key up to and with the first delimiter after the prefix; null if there is none."""
    if not delimiter:
        return F.lit(None).cast("string")
    at = F.locate(delimiter, key, len(prefix) + 1)
    return F.when(key.startswith(prefix) & (at > 0), F.substring(key, F.lit(1), at + len(delimiter) - 1))


def uri_encode(text: Column, keep_slash: bool = False) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ~ (and / if asked)."""
    out = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def percent_decode(text: Column) -> Column:
    """Percent-decoding that leaves + as it is; null for a broken escape."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def iso_timestamp(seconds: Column) -> Column:
    return F.date_format(_utc(seconds), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def http_timestamp(seconds: Column) -> Column:
    return F.date_format(_utc(seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def _utc(seconds: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def xml_escape(text: Column) -> Column:
    out = text
    for found, wanted in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def encode_token(**fields: Column) -> Column:
    """A continuation token: hex of the fields as JSON."""
    return F.lower(F.hex(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))))


def decode_token(token: Column, schema: str) -> Column:
    return F.from_json(F.unhex(token).cast("string"), schema)


def user_metadata(headers: Column, prefix: str = "x-amz-meta-") -> Column:
    """The user metadata of a header map, without the prefix; names compare in lower case."""
    lower = F.transform_keys(headers, lambda k, v: F.lower(k))
    return F.transform_keys(F.map_filter(lower, lambda k, v: k.startswith(prefix)), lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def canonical_map(entries: Column) -> Column:
    """A map as JSON of its sorted entries, which compares and groups."""
    return F.to_json(F.array_sort(F.map_entries(entries)))


def valid_bucket_name(name: Column) -> Column:
    """3 to 63 of a-z 0-9 . -, letters or digits at the ends, no "..", no address of numbers."""
    return name.rlike(r"^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$") & ~name.contains("..") & ~name.rlike(r"^\d+\.\d+\.\d+\.\d+$")


def byte_range(header: Column, size: Column) -> Column:
    """struct<first, last> of ``bytes=a-b``, ``a-`` or ``-n``, the end clamped; null if it can't be satisfied."""
    spec = r"^bytes=(\d*)-(\d*)$"
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(header, spec, i), F.lit("")), F.lit("9" * 18)).cast("bigint") for i in (1, 2))
    first = F.when(a.isNotNull(), a).otherwise(F.greatest(size - b, F.lit(0)))
    last = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    good = header.rlike(spec) & (a.isNotNull() | (b > 0)) & (size > 0) & (first <= last) & (first < size)
    return F.when(good, F.struct(first.cast("bigint").alias("first"), last.cast("bigint").alias("last")))


def etag_passes(etag: Column, if_match: Column, if_none_match: Column) -> Column:
    """200, 304 (the etag is one that the reader has) or 412 (it is none that the reader wants)."""
    has = lambda header: F.trim(header).eqNullSafe("*") | F.coalesce(F.array_contains(F.transform(F.split(header, ","), lambda x: F.trim(x, F.lit('" '))), etag), F.lit(False))
    return F.when(if_match.isNotNull() & ~has(if_match), 412).when(if_none_match.isNotNull() & has(if_none_match), 304).otherwise(200)
