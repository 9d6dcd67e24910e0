"""Date and time functions in the manner of MySQL. Times of day are text HH:mm:ss; all timestamps are UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format letters and what Spark calls them; letters without a Spark form are computed.
PATTERNS = {"a": "EEE", "b": "LLL", "c": "MM", "d": "dd", "e": "d", "f": "SSSSSS", "H": "HH", "h": "hh", "I": "hh", "i": "mm", "j": "DDD", "k": "H", "l": "h", "M": "LLLL", "m": "MM", "p": "a", "r": "hh:mm:ss a", "S": "ss", "s": "ss", "T": "HH:mm:ss", "W": "EEEE", "Y": "yyyy", "y": "yy"}
#: Days from year 0 to 1970-01-01.
DAY_ZERO = 719528


def week(c: Column, mode: int = 0) -> Column:
    """Week of the year: even modes start weeks on Sunday, odd on Monday; modes 1 and 3 to 6 by rules of least days."""
    return week_parts(c, mode)[1]


def week_parts(c: Column, mode: int) -> tuple[Column, Column]:
    """(year, week) of the mode; in modes 0, 1, 4 and 5 days before week 1 are in week 0 of their own year."""
    monday = mode in (1, 3, 5, 7)
    four_days = mode in (1, 3, 4, 6)

    def first(year: Column) -> Column:
        """Day on which week 1 begins."""
        jan1 = F.make_date(year, F.lit(1), F.lit(1))
        at = F.weekday(jan1) if monday else F.dayofweek(jan1) - 1  # days since the week began
        if four_days:
            return F.when(at <= 3, F.date_sub(jan1, at)).otherwise(F.date_add(jan1, 7 - at))
        return F.date_add(jan1, F.pmod(7 - at, F.lit(7)))

    year = F.year(c)
    own = F.floor(F.datediff(c, first(year)) / 7) + 1
    if mode in (0, 1, 4, 5):
        return year, F.greatest(own, F.lit(0)).cast("int")
    before, after = F.datediff(c, first(year)) < 0, F.datediff(c, first(year + 1)) >= 0
    last = F.floor(F.datediff(c, first(year - 1)) / 7) + 1
    return F.when(before, year - 1).when(after, year + 1).otherwise(year), F.when(before, last).when(after, 1).otherwise(own).cast("int")


def yearweek(c: Column, mode: int = 0) -> Column:
    y, w = week_parts(c, {0: 2, 1: 3, 4: 6, 5: 7}.get(mode, mode))
    return y * 100 + w


def date_format(c: Column, fmt: str) -> Column:
    """Text by % letters, all of MySQL's."""
    out: list[Column] = []
    for part in re.findall(r"%.|[^%]+|%", fmt, re.S):
        if part[0] != "%" or len(part) == 1:
            out.append(F.lit(part))
            continue
        k = part[1]
        if k in PATTERNS:
            out.append(F.date_format(c, PATTERNS[k]))
        elif k == "D":
            d = F.dayofmonth(c)
            out.append(F.concat(d.cast("string"), F.when(d.between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")))
        elif k == "w":
            out.append((F.dayofweek(c) - 1).cast("string"))
        elif k in "UuVv":
            out.append(F.lpad(week(c, {"U": 0, "u": 1, "V": 2, "v": 3}[k]).cast("string"), 2, "0"))
        elif k in "Xx":
            out.append(F.lpad(week_parts(c, 2 if k == "X" else 3)[0].cast("string"), 4, "0"))
        else:
            out.append(F.lit(k))
    return F.concat(*out)


def str_to_date(c: Column, fmt: str) -> Column:
    """Timestamp of text by % letters; null if it doesn't fit."""
    pattern = "".join(PATTERNS.get(p[1], "") if p[0] == "%" and len(p) > 1 else f"'{p}'" if p.isalpha() else p for p in re.findall(r"%.|[A-Za-z]+|.", fmt, re.S))
    return F.try_to_timestamp(c, F.lit(pattern))


def seconds_of(c: Column) -> Column:
    """Seconds of a time of day, [-]HH:mm:ss."""
    p = F.split(F.ltrim(c), ":")
    s = F.abs(p[0].cast("int")) * 3600 + p[1].cast("int") * 60 + p[2].cast("int")
    return F.when(c.startswith("-"), -s).otherwise(s)


def time_of(s: Column) -> Column:
    """Seconds as [-]HH:mm:ss."""
    a = F.abs(s)
    return F.concat(F.when(s < 0, "-").otherwise(""), F.format_string("%02d:%02d:%02d", F.floor(a / 3600), F.floor(F.pmod(a, F.lit(3600)) / 60), F.pmod(a, F.lit(60))))


def addtime(c: Column, time: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(c.cast("timestamp")) + seconds_of(time).cast("long") * 1_000_000).cast("timestamp_ntz")


def timediff(a: Column, b: Column) -> Column:
    return time_of(seconds_of(a) - seconds_of(b))


def to_days(c: Column) -> Column:
    return F.unix_date(c.cast("date")) + DAY_ZERO


def from_days(c: Column) -> Column:
    return F.date_from_unix_date((c - DAY_ZERO).cast("int"))


def to_seconds(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp")) + F.lit(DAY_ZERO * 86400)


def months_of(c: Column) -> Column:
    """Months of a period YYMM or YYYYMM; two digits below 70 are years from 2000."""
    y, m = F.floor(c / 100), c % 100
    return (F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y) * 12 + m - 1).cast("long")


def period_add(c: Column, n: int) -> Column:
    t = months_of(c) + n
    return F.floor(t / 12) * 100 + t % 12 + 1


def period_diff(a: Column, b: Column) -> Column:
    return months_of(a) - months_of(b)


def makedate(year: Column, day: Column) -> Column:
    return F.when(day > 0, F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (day - 1).cast("int")))


def timestampadd(unit: str, n: int | Column, c: Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.timestamp_add(unit.upper(), n, c)


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    return F.timestamp_diff(unit.upper(), a, b)


def convert_tz(c: Column, a: str, b: str) -> Column:
    return F.from_utc_timestamp(F.to_utc_timestamp(c, a), b)


def minute_of_day(c: Column) -> Column:
    return F.hour(c) * 60 + F.minute(c)


def dayname(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def monthname(c: Column) -> Column:
    return F.date_format(c, "LLLL")


#: Units of relative times and their names.
UNITS = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "M": "month", "mon": "month", "q": "quarter", "y": "year"}


def relative_time(now: Column, spec: str) -> Column:
    """A time from ``now`` by offsets and snaps in turn, such as -1d@d or +1mon@w1-10h."""
    if spec == "now":
        return now
    at = now
    for sign, n, unit, snap in re.findall(r"([+-])(\d*)(mon|[a-zA-Z])|@(mon|w[0-7]|[a-zA-Z])", spec):
        if snap:
            if snap[0] == "w":
                day = int(snap[1:] or 0) % 7
                start = F.date_trunc("day", at)
                at = start - F.make_dt_interval(F.pmod(F.dayofweek(start) - 1 - day, F.lit(7)))
            else:
                at = F.date_trunc(UNITS[snap], at)
        else:
            at = F.timestamp_add(UNITS[unit].upper(), F.lit(int(n or 1) * (-1 if sign == "-" else 1)), at)
    return at


def moment(c: Column) -> Column:
    """A time of text, date or timestamp; null for text that is none."""
    return c.cast("string").try_cast("timestamp")


def micros(c: Column) -> Column:
    return F.unix_micros(moment(c))


def microsecond(c: Column) -> Column:
    """The microseconds of the second, from a time or from text such as 17:30:00.25."""
    part = F.rpad(F.regexp_extract(c.cast("string"), r"\.(\d{1,6})", 1), 6, "0")
    return F.coalesce(part.try_cast("int"), F.lit(0))


#: Composite units and the parts that they put together, largest first.
COMPOSITE = {
    "SECOND_MICROSECOND": ["SECOND", "MICROSECOND"], "MINUTE_MICROSECOND": ["MINUTE", "SECOND", "MICROSECOND"], "MINUTE_SECOND": ["MINUTE", "SECOND"],
    "HOUR_MICROSECOND": ["HOUR", "MINUTE", "SECOND", "MICROSECOND"], "HOUR_SECOND": ["HOUR", "MINUTE", "SECOND"], "HOUR_MINUTE": ["HOUR", "MINUTE"],
    "DAY_MICROSECOND": ["DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"], "DAY_SECOND": ["DAY", "HOUR", "MINUTE", "SECOND"], "DAY_MINUTE": ["DAY", "HOUR", "MINUTE"],
    "DAY_HOUR": ["DAY", "HOUR"], "YEAR_MONTH": ["YEAR", "MONTH"],
}


def extract(unit: str, c: Column) -> Column:
    """A part of a time as a number; composite units (DAY_HOUR, YEAR_MONTH, ...) are their parts' digits, two each, microseconds six."""
    unit = unit.upper()
    simple = {"MICROSECOND": microsecond, "SECOND": F.second, "MINUTE": F.minute, "HOUR": F.hour, "DAY": F.dayofmonth, "WEEK": week, "MONTH": F.month, "QUARTER": F.quarter, "YEAR": F.year}
    if unit in simple:
        return simple[unit](c).cast("long")
    first, *rest = COMPOSITE[unit]
    out = simple[first](c).cast("long")
    for part in rest:
        out = out * (1_000_000 if part == "MICROSECOND" else 100) + simple[part](c)
    return out


#: The formats that get_format names.
FORMATS = {
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d",
    ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
    ("TIMESTAMP", "USA"): "%Y-%m-%d %H.%i.%s", ("TIMESTAMP", "JIS"): "%Y-%m-%d %H:%i:%s", ("TIMESTAMP", "ISO"): "%Y-%m-%d %H:%i:%s", ("TIMESTAMP", "EUR"): "%Y-%m-%d %H.%i.%s", ("TIMESTAMP", "INTERNAL"): "%Y%m%d%H%i%s",
}


def get_format(kind: str, place: str) -> str | None:
    """The % letters of a place's date, time or timestamp; None for others."""
    return FORMATS.get((kind.upper(), place.upper()))


def from_unixtime(c: Column, fmt: str | None = None) -> Column:
    """The time of seconds since 1970, fractions too, or its text; null for negative seconds."""
    t = F.timestamp_micros((F.when(c >= 0, c).cast("decimal(28,6)") * 1_000_000).cast("long"))
    return date_format(t, fmt) if fmt else t.cast("timestamp_ntz")


def unix_timestamp(c: Column, numeric: bool = False) -> Column:
    """Seconds since 1970 as a double; ``numeric``: of a number YYMMDD, YYYYMMDD, YYMMDDhhmmss or YYYYMMDDhhmmss."""
    if not numeric:
        return micros(c) / 1_000_000
    digits = c.cast("long").cast("string")
    short = F.length(digits).isin(5, 6, 11, 12)
    n = F.when(short, F.lpad(digits, F.when(F.length(digits) <= 6, 6).otherwise(12), "0")).otherwise(digits)
    century = F.when(F.substring(n, 1, 2).cast("int") < 70, "20").otherwise("19")
    full = F.rpad(F.when(short, F.concat(century, n)).otherwise(n), 14, "0")
    return F.unix_micros(F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss"))) / 1_000_000


def maketime(h: Column, m: Column, s: Column) -> Column:
    """HH:mm:ss of rounded parts; null where a part is negative or minute or second is over 59."""
    h, m = F.round(h).cast("int"), F.round(m).cast("int")
    return F.when((h >= 0) & m.between(0, 59) & (s >= 0) & (s < 60), time_of(h * 3600 + m * 60 + F.floor(s).cast("int")))


def time_format(c: Column, fmt: str) -> Column:
    """Text of a time of day by the % letters of hours, minutes and seconds; days and months are zeros."""
    zeros = {"c": "0", "d": "00", "e": "0", "m": "00", "Y": "0000", "y": "00"}
    return date_format(c, re.sub(r"%(.)", lambda m: zeros.get(m.group(1), m.group(0)), fmt))


def date_add(c: Column, n: int | Column, unit: str = "day") -> Column:
    """A time plus so many units."""
    return timestampadd(unit, n, moment(c)).cast("timestamp_ntz")


def date_sub(c: Column, n: int, unit: str = "day") -> Column:
    return date_add(c, -n, unit)


def adddate(c: Column, days: int) -> Column:
    return F.date_add(moment(c).cast("date"), days)


def subtime(c: Column, time: Column) -> Column:
    return addtime(c, time_of(-seconds_of(time)))


def datetime(c: Column, zone: str | None = None) -> Column:
    """A time of text, whose own offset (+03:00 at its end) is undone, told in ``zone``; null where it can't be read."""
    t = moment(c)
    return (F.from_utc_timestamp(t, zone) if zone else t).cast("timestamp_ntz")


def timestamp(c: Column, time: Column | None = None) -> Column:
    """A time of text or a date, plus a time of day."""
    t = moment(c).cast("timestamp_ntz")
    return t if time is None else addtime(t, time)


def time(c: Column) -> Column:
    """The time of day as text, HH:mm:ss and the fraction where there is one."""
    return F.regexp_replace(F.date_format(moment(c), "HH:mm:ss.SSSSSS"), r"\.0+$|(?<=\.\d{0,5}[1-9])0+$", "")


def sec_to_time(c: Column) -> Column:
    return time_of(c.cast("long"))


def time_to_sec(c: Column) -> Column:
    return seconds_of(F.date_format(moment(c), "HH:mm:ss"))


def earliest(spec: str, c: Column, now: Column | None = None) -> Column:
    """Whether a time is not before a relative time such as -1d@d."""
    return c.cast("timestamp") >= relative_time(F.current_timestamp() if now is None else now, spec)


def latest(spec: str, c: Column, now: Column | None = None) -> Column:
    return c.cast("timestamp") <= relative_time(F.current_timestamp() if now is None else now, spec)
