"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_ref(content: Column) -> Column:
    """``sha256:<hex>`` of bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def has_key(json: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(json), key)


def labels_digest(json: Column, parse: Callable[[Column], Column] = F.parse_json) -> Column:
    """First 16 hex digits of the sha256 of canonical JSON (sorted keys, no spaces).

    Exact for strings, whole numbers, booleans and nesting; other numbers keep the text
    that Spark's variant gives them.
    """
    return F.substring(F.sha2(F.to_json(parse(json)).cast("binary"), 256), 1, 16)


def trace_id(run: Column, track: Column, service: Column) -> Column:
    """``run/<run>/track/<track>``, or ``run/<run>/service/<service>`` without a track."""
    return F.coalesce(
        F.concat(F.lit("run/"), run, F.lit("/track/"), track.cast("string")), F.concat(F.lit("run/"), run, F.lit("/service/"), service)
    )


def segment_uri(run: Column, track: Column, segment: Column, bucket: str | None = None, root: str = "/artifacts") -> Column:
    head = f"s3://{bucket}" if bucket else root
    return F.concat(F.lit(f"{head}/runs/"), run, F.lit("/segments/"), track.cast("string"), F.lit("/"), segment.cast("string"), F.lit(".wav"))


def manifest_uri(run: Column, bucket: str | None = None, root: str = "/artifacts") -> Column:
    head = f"s3://{bucket}" if bucket else root
    return F.concat(F.lit(f"{head}/runs/"), run, F.lit("/manifests/segments.parquet"))


def parse_uri(uri: Column, bucket: str | None = None) -> Column:
    """Struct (scheme, bucket, key, valid): no query, fragment, ``..`` or foreign bucket."""
    s3 = uri.startswith("s3://")
    name = F.when(s3, F.regexp_extract(uri, "^s3://([^/?#]*)", 1))
    key = F.when(s3, F.regexp_extract(uri, "^s3://[^/?#]*/(.*)$", 1)).otherwise(F.regexp_replace(uri, "^/+", ""))
    good = (key != "") & ~key.rlike("[?#\\\\]|(^|/)\\.{1,2}(/|$)|//")
    good = good & (~s3 | (name == bucket if bucket else name != ""))
    return F.struct(F.when(s3, "s3").otherwise("file").alias("scheme"), name.alias("bucket"), key.alias("key"), good.alias("valid"))


def has_uri_prefix(uri: Column, run: Column, bucket: str) -> Column:
    return uri.startswith(F.concat(F.lit(f"s3://{bucket}/runs/"), run, F.lit("/")))


def segment_uri_ok(uri: Column, run: Column, track: Column, segment: Column, bucket: str | None = None) -> Column:
    return F.coalesce(uri == segment_uri(run, track, segment, bucket), F.lit(False))


def iso8601(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def rms_db(rms: Column) -> Column:
    """Decibels of a linear level; minus infinity below 1e-10 or for nothing at all."""
    low = F.lit(float("-inf"))
    return F.when(rms.isNull() | (rms < 1e-10), low).otherwise(20 * F.log10(rms))


def finite_or_floor(db: Column, floor: float = -60.0) -> Column:
    return F.when(F.isnan(db) | (F.abs(db) == float("inf")), floor).otherwise(db)


def memory_mb(text: Column) -> Column:
    """``12.5MiB / 2GiB`` to MiB; binary and decimal units."""
    number = F.regexp_extract(text, "^\\s*([0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, "^\\s*[0-9.]+\\s*([A-Za-z]+)", 1))
    power = {"b": 0, "k": 1, "m": 2, "g": 3, "t": 4}
    factor = F.lit(None).cast("double")
    for u, p in power.items():
        for name, base in ((f"{u}ib", 1024), (f"{u}b", 1000)):
            if u == "b":
                name = "b"
            factor = F.when(unit == name, float(base**p) / (1 << 20)).otherwise(factor)
    return number * factor


def percent(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "%$", "").try_cast("double")


def service_name(container: Column, services: tuple[str, ...]) -> Column:
    """The service whose name is a part of the container's, else the container's name."""
    out = container
    for s in reversed(services):
        out = F.when(F.lower(container).contains(f"-{s}-"), s).otherwise(out)
    return out


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def audio_path(track: Column, root: str) -> Column:
    """``<root>/000/000002.mp3``."""
    text = track.cast("string")
    padded = F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))
    return F.concat(F.lit(f"{root}/"), F.substring(padded, 1, 3), F.lit("/"), padded, F.lit(".mp3"))


def validation_status(exists: Column, probed: Column, duration: Column, decoded: Column, db: Column) -> Column:
    """The first that fits."""
    return (
        F.when(~exists, "missing_file")
        .when(~probed, "probe_failed")
        .when(duration < 1.0, "too_short")
        .when(~decoded, "decode_failed")
        .when(db < -60, "silent")
        .otherwise("validated")
    )


def effective_duration(measured: Column, declared: Column) -> Column:
    return F.coalesce(F.when(measured > 0, measured), F.when(declared > 0, declared))
