"""Spans and buckets of numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def span(c: Column, n: float, unit: str | None = None) -> Column:
    """The start of the span that holds a number or, with a unit (us ms s m h d w M q y), a time (UTC, without zone).

    Integers are divided toward zero (span(-7, 5) is -5), other numbers downward (span(-7.0, 5) is -10).
    """
    if unit is None:
        whole = F.typeof(c).isin("tinyint", "smallint", "int", "bigint") & F.lit(float(n).is_integer())
        return F.when(whole, (c - c % F.lit(n)) * F.lit(1)).otherwise(F.floor(c / F.lit(n)) * F.lit(n))
    t = c.cast("timestamp")
    if unit in ("us", "ms"):
        size = int(n) * (1 if unit == "us" else 1000)
        start = F.timestamp_micros(F.unix_micros(t) - F.pmod(F.unix_micros(t), F.lit(size)))
    elif unit in SECONDS or unit == "w":  # weeks start on Monday
        size, shift = int(n) * SECONDS.get(unit, 604800), 345600 if unit == "w" else 0
        start = F.timestamp_seconds(F.unix_seconds(t) - F.pmod(F.unix_seconds(t) - F.lit(shift), F.lit(size)))
    else:
        months = int(n) * {"M": 1, "q": 3, "y": 12}[unit]
        count = (F.year(t) - 1970) * 12 + F.month(t) - 1
        start = F.add_months(F.lit("1970-01-01").cast("date"), (count - F.pmod(count, F.lit(months))).cast("int"))
    return start.cast("timestamp_ntz")


def text(c: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def range_text(low: Column, width: Column) -> Column:
    return F.concat(text(low), F.lit("-"), text(low + width))


def span_bucket(c: Column, width: float) -> Column:
    """"low-high" of the span; null for a span of 0 or less."""
    if width <= 0:
        return F.lit(None).cast("string")
    v = c.cast("double")
    return range_text(F.floor(v / width) * F.lit(float(width)), F.lit(float(width)))


def power(exponent: Column) -> Column:
    return F.pow(F.lit(10.0), exponent)


def width_bucket(c: Column, bins: int, low: Column, high: Column) -> Column:
    """"low-high" in at most ``bins`` spans of a power of ten that cover low to high."""
    if not 2 <= bins <= 50_000:
        raise ValueError("2 to 50000 bins")
    reach = (high - low).cast("double")
    width = power(F.ceil(F.log10(reach / bins)))
    width = F.when(F.ceil(reach / width) + F.when(high % width == 0, 1).otherwise(0) > bins, width * 10).otherwise(width)
    return F.when(reach > 0, range_text(F.floor(c / width) * width, width))


def minspan_bucket(c: Column, minspan: float, low: Column, high: Column) -> Column:
    """"low-high" in spans of a power of ten, the range's own unless that is under ``minspan``."""
    reach = (high - low).cast("double")
    own, least = power(F.floor(F.log10(reach))), power(F.ceil(F.log10(F.lit(float(minspan)))))
    width = F.when(own >= F.lit(float(minspan)), own).otherwise(least)
    return F.when(reach > 0, range_text(F.floor(c / width) * width, width))


def range_bucket(c: Column, low: Column, high: Column, start: float | None = None, end: float | None = None) -> Column:
    """"low-high" in spans fit to a range that ``start`` and ``end`` can only widen."""
    a = F.least(low, F.lit(start)) if start is not None else low
    b = F.greatest(high, F.lit(end)) if end is not None else high
    reach = (b - a).cast("double")
    log = F.log10(reach)
    width = power(F.when(log == F.floor(log), log - 1).otherwise(F.floor(log)))
    return F.when(reach > 0, range_text(F.floor(c / width) * width, width))
