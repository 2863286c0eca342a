"""Scalar functions of the engine, as Columns."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number: decimal digits with optional point, exponent and surrounding space; no NaN, hex or suffixes.
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def is_numeric(value: Column) -> Column:
    return F.coalesce(value.cast("string").rlike(NUMERIC), F.lit(False))


def number(value: Column) -> Column:
    return F.when(is_numeric(value), F.expr("double(null)") if value is None else F.trim(value.cast("string")).try_cast("double"))


def range_inclusive(value: Column, a, b) -> Column:
    """Whether a numeric value lies between two bounds given in any order; false for anything that isn't a number."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return F.coalesce(number(value).between(F.least(a, b), F.greatest(a, b)), F.lit(False))


def range_exclusive(value: Column, a, b) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    v = number(value)
    return F.coalesce((v > F.least(a, b)) & (v < F.greatest(a, b)), F.lit(False))


def event_time(value: Column, kind: str, missing: Column | None = None) -> Column:
    """A UTC timestamp of unix seconds (``int``), text with or without a zone (``string``) or a timestamp (``timestamp``)."""
    missing = F.current_timestamp() if missing is None else missing
    made = {
        "int": lambda: F.timestamp_seconds(value),
        "string": lambda: F.try_to_timestamp(value),
        "timestamp": lambda: value.cast("timestamp"),
    }[kind]()
    return F.coalesce(made, missing)


def effective_time(event: Column, now: Column, tolerance_s: int = 600) -> Column:
    """The time rules see: ``now`` where the event's own time is further than the tolerance from it."""
    return F.when(F.abs(F.unix_timestamp(now) - F.unix_timestamp(event)) > tolerance_s, now).otherwise(event)


def rfc3339(value: Column) -> Column:
    """With milliseconds, further digits cut off."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / 1e6


PERIOD = re.compile(r"^P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$")


def period(text: str) -> timedelta | None:
    """A day-time ISO-8601 period; None, that is no timeout, where it is zero. Calendar periods are refused."""
    found = PERIOD.match(text)
    if not found or text in ("P", "PT"):
        raise ValueError(f"not a day-time period: {text!r}")
    w, d, h, m, s = (float(x or 0) for x in found.groups())
    return timedelta(weeks=w, days=d, hours=h, minutes=m, seconds=s) or None


def human_bytes(value: Column) -> Column:
    """Bytes in the largest unit that leaves at least 1, with two digits."""
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB")])
    power = F.when(value < 1, 0).otherwise(F.least(F.floor(F.log(2.0, value.cast("double")) / 10), F.lit(5))).cast("int")
    return F.concat_ws(" ", F.round(value / F.pow(F.lit(1024.0), power), 2).cast("string"), F.element_at(units, power + 1))


def human_duration(seconds: Column) -> Column:
    """Whole days, hours, minutes and seconds; parts that are zero are left out."""
    s = seconds.cast("long")
    parts = [(F.expr("1") * F.floor(s / 86400), "d"), (F.floor(s / 3600) % 24, "h"), (F.floor(s / 60) % 60, "m"), (s % 60, "s")]
    made = F.concat_ws(" ", *[F.when(v > 0, F.concat(v.cast("long").cast("string"), F.lit(u))) for v, u in parts])
    return F.when(made == "", F.lit("0s")).otherwise(made)


def memory_size(text: Column) -> Column:
    """Bytes of sizes such as 512M; null where it isn't one."""
    unit = F.upper(F.regexp_extract(text, r"^\s*(\d+)\s*([KMGkmg]?)\s*$", 2))
    factor = F.when(unit == "G", 1 << 30).when(unit == "M", 1 << 20).when(unit == "K", 1 << 10).otherwise(1)
    return F.regexp_extract(text, r"^\s*(\d+)\s*([KMGkmg]?)\s*$", 1).try_cast("long") * factor


def interpolate(message: Column, values: dict[str, Column]) -> Column:
    """{name} placeholders replaced by values."""
    for name, value in values.items():
        message = F.replace(message, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return message


def instance_id(rule: Column, key: Column, first_event: Column) -> Column:
    """A matcher's id: the same in every replay."""
    return F.substring(F.sha2(F.concat_ws("|", rule, key.cast("string"), first_event.cast("string")), 256), 1, 10)
