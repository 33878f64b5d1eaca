"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_lower(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("_"), F.lit(" ")))


def label_title(name: Column) -> Column:
    text = label_lower(name)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def number_text(value: Column) -> Column:
    """Decimal text of a reading, always with a fraction part and without an exponent below 1e7."""
    return value.cast("string")


def safe_divide(numerator: Column, denominator: Column, floor: float) -> Column:
    """struct(value, valid, reason): near-zero denominators and non-finite results are reported."""
    near = F.abs(denominator) < floor
    quotient = F.try_divide(numerator, denominator)
    finite = quotient.isNotNull() & ~F.isnan(quotient) & (F.abs(quotient) != float("inf"))
    reason = F.when(near, "near_zero_denominator").when(~finite, "non_finite_value")
    return F.struct(F.when(~near & finite, quotient).alias("value"), reason.isNull().alias("valid"), reason.alias("reason"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def relative_change(base: Column, other: Column) -> Column:
    return F.when(F.abs(base) >= 1e-12, (other - base) / F.abs(base))


def latency_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; null when the order is reversed."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.when(micros >= 0, micros / 1000.0)


def bucket_start(ts: Column, bucket: str) -> Column:
    """Start of the ``1h`` or ``1d`` bucket in UTC."""
    return F.date_trunc({"1h": "hour", "1d": "day"}[bucket], ts)


def parse_iso(text: Column) -> Column:
    """ISO-8601 date or date and time; ``Z`` and offsets are honoured, naive text is UTC whatever the session's zone.

    Null for other text: parts of a date, a time alone and one-digit months, days or hours are no timestamps.
    """
    parts = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?)(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?$"
    part = lambda k: F.regexp_extract(text, parts, k)
    clock = F.regexp_replace(part(2), ",", ".")
    whole = F.concat(clock, F.substring(F.lit("00:00:00"), F.length(clock) + 1, F.lit(8)))
    zone = F.when(part(3) == "", "Z").otherwise(part(3))
    return F.when(text.rlike(parts), F.try_to_timestamp(F.concat(part(1), F.lit("T"), whole, zone)))


def severity_band(value: Column) -> Column:
    """Model evaluation bands."""
    return (
        F.when((value >= 0.15) & (value < 0.40), "mild")
        .when((value >= 0.40) & (value < 0.70), "moderate")
        .when((value >= 0.70) & (value < 1.0000001), "severe")
    )


def audit_severity_band(value: Column) -> Column:
    """Audit bands."""
    return (
        F.when((value >= 0.0) & (value < 0.4), "low")
        .when((value >= 0.4) & (value < 0.7), "mid")
        .when((value >= 0.7) & (value < 1.0001), "high")
    )


def ramp_stage(active: Column, since_start: Column, duration: Column) -> Column:
    return F.when(active & since_start.isNotNull(), F.when(since_start < duration, "ramp").otherwise("post_ramp"))


def derive_label(active: Column, fault_type: Column, corruption: Column) -> Column:
    return (
        F.when(~active, "healthy")
        .when(fault_type != "none", fault_type)
        .when(corruption == "bias", "sensor_anomaly")
        .otherwise("healthy")
    )


def name_uuid(namespace_hex: str, text: Column) -> Column:
    """Version-5 UUID of ``text`` in a namespace given as 32 hex digits."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(text, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)) + F.lit(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
