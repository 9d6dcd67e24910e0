"""Text to numbers and times: units, commas, durations. All give null for text they can't read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms that the conversions accept.
MEMK = r"^([+-]?\d+\.?\d*)([kmgKMG])?$"
LEADING = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(.*)$"
MSTIME = r"^(?:(\d{1,2}):)?(\d{1,2})(?:\.(\d{1,3}))?$"
DURATION = r"^(?:(\d+)\+)?(\d{1,2}):(\d{1,2}):(\d{1,2})$"


def plain(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text != "", text)


def number(c: Column) -> Column:
    return c.try_cast("double")


def group(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def memk(c: Column) -> Column:
    """A size in kilobytes, with k, m or g."""
    t = plain(c)
    unit = F.lower(F.regexp_extract(t, MEMK, 2))
    return number(group(t, MEMK, 1)) * F.when(unit == "m", 1024.0).when(unit == "g", 1024.0 * 1024).otherwise(1.0)


def rmunit(c: Column) -> Column:
    return number(group(plain(c), LEADING, 1))


def rmcomma(c: Column) -> Column:
    t = plain(c)
    return F.when(~t.rlike("[A-Za-z]"), number(F.replace(t, F.lit(","), F.lit(""))))


def num(c: Column) -> Column:
    """A number, with commas or a unit after it."""
    t = plain(c)
    bare = F.replace(t, F.lit(","), F.lit(""))
    rest = F.regexp_extract(t, LEADING, 2)
    return F.when(t.rlike(r"^[+\-.\d]"), F.coalesce(F.when(~t.rlike("[dDfF]$"), number(t)), F.when(~bare.rlike("[dDfF]$"), number(bare)), F.when(~rest.rlike(r"^[\d.]"), number(group(t, LEADING, 1)))))


def auto(c: Column) -> Column:
    return F.coalesce(memk(c), num(c))


def mstime(c: Column) -> Column:
    """[MM:]SS[.mmm] as seconds."""
    t = plain(c)
    sec = group(t, MSTIME, 2).cast("double")
    return F.coalesce(
        F.when(sec < 60, F.coalesce(group(t, MSTIME, 1).cast("double"), F.lit(0.0)) * 60 + sec + F.coalesce(F.rpad(group(t, MSTIME, 3), 3, "0").cast("double"), F.lit(0.0)) / 1000),
        number(t),
    )


def dur2sec(c: Column) -> Column:
    """[D+]HH:MM:SS as seconds."""
    t = plain(c)
    d, h, m, s = (F.coalesce(group(t, DURATION, k).cast("double"), F.lit(0.0)) for k in (1, 2, 3, 4))
    return F.coalesce(number(t), F.when(t.rlike(DURATION) & (h < 24) & (m < 60) & (s < 60), d * 86400 + h * 3600 + m * 60 + s))


#: Strftime letters and what Spark calls them.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "Z": "z", "z": "xx"}


def strftime_pattern(fmt: str, far: bool = False) -> str:
    """``far``: for years beyond 0 to 9999, which have as many digits as they need, and no plus sign."""
    letters = STRFTIME | ({"Y": "y"} if far else {})
    out, k = "", 0
    while k < len(fmt):
        if fmt[k] == "%" and k + 1 < len(fmt):
            out, k = out + {"F": f"{letters['Y']}-MM-dd", "T": "HH:mm:ss", "%": "%"}.get(fmt[k + 1], letters.get(fmt[k + 1], "")), k + 2
        else:
            out, k = out + (f"'{fmt[k]}'" if fmt[k].isalpha() else fmt[k]), k + 1
    return out


#: Below the first, a microsecond still shows in a double's product by a million; from the second on, no timestamp.
EXACT, LAST = 2.0**33, 9.2e12


def far_year(t: Column) -> Column:
    return ~F.year(t).between(0, 9999)


def ctime(c: Column, fmt: str = "%m/%d/%Y %H:%M:%S") -> Column:
    """Seconds since 1970 as text."""
    x = number(plain(c))
    whole = F.floor(x)
    micros = F.when(F.abs(x) < EXACT, (x * 1_000_000).cast("long")).when(F.abs(x) < LAST, whole.cast("long") * 1_000_000 + ((x - whole) * 1_000_000).cast("long"))
    t = F.timestamp_micros(micros)
    return F.when(far_year(t), F.date_format(t, strftime_pattern(fmt, far=True))).otherwise(F.date_format(t, strftime_pattern(fmt)))


def mktime(c: Column, fmt: str = "%m/%d/%Y %H:%M:%S") -> Column:
    t = plain(c)
    far = F.try_to_timestamp(t, F.lit(strftime_pattern(fmt, far=True)))
    read = F.coalesce(F.try_to_timestamp(t, F.lit(strftime_pattern(fmt))), F.when(far_year(far), far))
    whole = F.unix_seconds(read)
    return F.coalesce(whole.cast("double") + (F.unix_micros(read) - whole * 1_000_000) / 1_000_000, number(t))
