"""Scalar functions with the null, zero and rounding rules of the log-query dialect, as columns."""

from __future__ import annotations

import ipaddress
import re
from json import loads

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column, whole: bool = False) -> Column:
    """Quotient; null for a zero divisor. ``whole``: both are integers, the fraction is dropped."""
    if whole:
        return (a.cast("decimal(38,0)") / F.nullif(b, F.lit(0))).cast("long")
    return F.try_divide(a, b)


def modulus(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; null for a zero divisor."""
    return F.try_mod(a, b)


def truncate(c: Column, d: int = 0) -> Column:
    """Toward zero after ``d`` places, on the number as it is written (1.15 stays 1.15)."""
    scale = F.lit(10.0**d)
    exact = F.floor(F.when(F.abs(c) < 1e14, F.abs(c)).cast("decimal(30,15)"), F.lit(d)).cast("double")
    return F.signum(c) * F.coalesce(exact, F.floor(F.abs(c) * scale) / scale)


def root(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def power(a: Column, b: Column) -> Column:
    p = F.pow(a, b)
    return F.when(~F.isnan(p), p)


def arc(f, c: Column) -> Column:
    """``F.acos`` or ``F.asin``; null outside -1 to 1."""
    return F.when((c >= -1) & (c <= 1), f(c))


def log(c: Column, base: Column | None = None) -> Column:
    """Natural, or to a base; null where undefined."""
    return F.when(c > 0, F.log(c) if base is None else F.log(c) / F.log(base))


def conv(c: Column, a: int, b: int) -> Column:
    return F.lower(F.conv(c.cast("string"), a, b))


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def left(c: Column, n: int) -> Column:
    return F.substring(c, 1, max(n, 0))


def right(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def locate(needle: str, c: Column, start: int = 1) -> Column:
    return F.locate(needle, c, start)


def is_empty(c: Column) -> Column:
    return c.isNull() | (F.length(c) == 0)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(F.trim(c)) == 0)


def tostring(c: Column, form: str | None = None) -> Column:
    """As text: binary, hex, commas (two places), duration (HH:MM:SS) or plain."""
    if form == "binary":
        return F.bin(c.cast("long"))
    if form == "hex":
        return F.lower(F.hex(c.cast("long")))
    if form == "commas":
        return F.call_function("format_number", c.cast("double"), F.lit("#,##0.##"))
    if form == "duration":
        s = c.cast("long")
        return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
    return c.cast("string")


def tonumber(c: Column, base: int = 10) -> Column:
    """Text of a base from 2 to 36 as a double; null if it isn't."""
    if not 2 <= base <= 36:
        raise ValueError("base 2 to 36")
    if base == 10:
        return c.try_cast("double")
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    return F.when(F.lower(c).rlike(f"^-?[{digits}]+$"), F.conv(c, base, -10).cast("double"))


def ip_number(c: Column) -> Column:
    """An IPv4 address as a number; null for other text."""
    parts = F.transform(F.split(c, "\\."), lambda x: x.try_cast("long"))
    good = c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x <= 255)
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x))


def cidrmatch(c: Column, block: str) -> Column:
    """Whether an IPv4 or IPv6 address lies in a block; IPv4 stays a column expression."""
    net = ipaddress.ip_network(block, strict=False)
    if net.version == 4:
        n = ip_number(c)
        return (n >= int(net.network_address)) & (n <= int(net.broadcast_address))

    @F.pandas_udf("boolean")
    def inside(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                a = ipaddress.ip_address(x)
            except ValueError:
                return None
            return a.version == 6 and a in net

        return s.map(one)

    return inside(c)


def scalar_extreme(names: list[Column], text: list[bool], largest: bool = True) -> Column:
    """The largest or smallest of several values; text ranks above numbers."""
    f = F.greatest if largest else F.least
    pick = [c for c, t in zip(names, text, strict=True) if t == (largest and any(text) or all(text))]
    return f(*pick).cast("string") if len(pick) > 1 else pick[0].cast("string")


# Arrays


def mvindex(c: Column, i: int, j: int | None = None) -> Column:
    """An element by place from 0, or those from i to j inclusive; negatives count from the end."""
    if j is None:
        return F.try_element_at(c, F.lit(i + 1 if i >= 0 else i))
    n = F.size(c)
    a = F.greatest(F.lit(i) if i >= 0 else n + i, F.lit(0))
    b = F.lit(j) if j >= 0 else n + j
    return F.slice(c, a + 1, F.greatest(b - a + 1, F.lit(0)))


def mvfind(c: Column, pattern: str) -> Column:
    """Place from 0 of the first element that holds the pattern, or null."""
    hit = F.array_position(F.transform(c, lambda x: F.coalesce(x.rlike(pattern), F.lit(False))), True)
    return F.when(hit > 0, hit - 1)


def mvzip(a: Column, b: Column, delim: str = ",") -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.concat_ws(delim, x.cast("string"), y.cast("string")))


def mvappend(*parts: Column) -> Column:
    """Arrays end to end without nulls; null if that is empty."""
    joined = F.array_compact(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])))
    return F.when(F.size(joined) > 0, joined)


def mvdedup(c: Column) -> Column:
    return F.array_distinct(c)


def mvjoin(c: Column, delim: str) -> Column:
    return F.array_join(F.array_compact(c), delim)


def split(c: Column, delim: str) -> Column:
    return F.split(c, f"\\Q{delim}\\E") if delim else F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1))


# JSON


def no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def json_valid(c: Column) -> Column:
    """Whether a text is one JSON value and nothing more; null for null. (Spark's own parsers pass over what follows a value.)"""

    @F.pandas_udf("boolean")
    def valid(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                loads(text, parse_constant=no_constant)
            except ValueError:
                return False
            return True

        return texts.map(one)

    return valid(c)


def json(c: Column) -> Column:
    return F.when(json_valid(c), c)


def json_keys(c: Column) -> Column:
    return F.json_object_keys(c)


def json_array_length(c: Column) -> Column:
    return F.json_array_length(c)


def json_extract(c: Column, *paths: str) -> Column:
    """Value at a path (a.b{}.c{2}); several paths make a JSON array."""
    from millrace.operators.shape import json_path

    found = [F.get_json_object(c, json_path(p)) for p in paths]
    return found[0] if len(found) == 1 else F.to_json(F.array(*found), {"ignoreNullFields": "false"})


def json_object(**parts: Column) -> Column:
    """A JSON object of named values, nulls kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]), {"ignoreNullFields": "false"})


def json_array(*parts: Column) -> Column:
    """A JSON array of values of any types, nulls kept."""
    one = [F.regexp_replace(F.to_json(F.struct(p.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "") for p in parts]
    return F.concat(F.lit("["), F.concat_ws(",", *one), F.lit("]"))


# Maps


def map_append(m: Column, other: Column) -> Column:
    """Two maps as one, with both values, as an array without nulls, of every key."""
    merged = F.map_zip_with(m, other, lambda k, a, b: F.array_compact(F.array(a.cast("string"), b.cast("string"))))
    return merged


def map_concat(m: Column, other: Column) -> Column:
    """Two maps as one; the other's values win."""
    kept = F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(other), k))
    return F.map_concat(kept, other)


def map_remove(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(keys))


def array(*parts: Column, mixed: bool = False) -> Column:
    """An array; ``mixed``: of different types, all told as text."""
    return F.array(*[p.cast("string") for p in parts]) if mixed else F.array(*parts)


#: Spark's types and the dialect's names for them.
TYPE_NAMES = {"tinyint": "BYTE", "smallint": "SHORT", "int": "INT", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "STRING", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "binary": "BINARY", "void": "UNDEFINED"}


def typeof(c: Column) -> Column:
    """The dialect's name of a column's type; ARRAY, STRUCT and so on for the others."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    name = F.typeof(c)
    return F.coalesce(F.try_element_at(known, name), F.upper(F.regexp_extract(name, r"^(\w+)", 1)))


# Full text: lower-case tokens of letters and digits stand for a search engine's analyser.


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def words_in(query: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", query.lower()) if w]


#: No letter or digit before, and none after.
BEFORE, AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def holds(c: Column, body: str, prefix: bool = False) -> Column:
    """Whether the lower-cased text has the pattern as whole tokens; one pass over the text, without arrays."""
    return F.lower(c).rlike(BEFORE + body + ("" if prefix else AFTER))


def match(c: Column, query: str, every: bool = False) -> Column:
    """Any (or every) word of the query is among the tokens; a query without words matches nothing."""
    words = words_in(query)
    if not words:
        return F.lit(False)
    if not every:
        return holds(c, "(?:" + "|".join(map(re.escape, words)) + ")")
    out = holds(c, re.escape(words[0]))
    for w in words[1:]:
        out = out & holds(c, re.escape(w))
    return out


def match_phrase(c: Column, query: str, prefix: bool = False, slop: int = 0) -> Column:
    """The query's words one after the other, with up to ``slop`` other words between all of them; with ``prefix`` the last may be cut short."""
    words = [re.escape(w) for w in words_in(query)]
    if not words:
        return F.lit(False)
    gap = r"[^\p{L}\p{N}]+"
    if not slop:
        return holds(c, gap.join(words), prefix)
    # Every way to share out the words between: few words and a small slop, so few ways.
    ways = [[]]
    for _ in words[1:]:
        ways = [[*w, n] for w in ways for n in range(slop - sum(w) + 1)]
    other = r"[\p{L}\p{N}]+" + gap
    spelt = ["".join(x for n, w in zip([None, *way], words, strict=True) for x in (([gap + other * n] if n is not None else []) + [w])) for way in ways]
    return holds(c, "(?:" + "|".join(spelt) + ")", prefix)


def match_bool_prefix(c: Column, query: str) -> Column:
    """Any word of the query is a token, or its last word begins one."""
    words = [re.escape(w) for w in words_in(query)]
    if not words:
        return F.lit(False)
    last = holds(c, words[-1], prefix=True)
    return last | holds(c, "(?:" + "|".join(words[:-1]) + ")") if words[:-1] else last


def multi_match(columns: list[Column], query: str, every: bool = False) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(match(c, query, every), F.lit(False))
    return out


def query_string(columns: dict[str, Column], query: str, every: bool = False) -> Column:
    """A small query language over columns: words and "phrases", ``*`` and ``?`` inside words, ``name:word`` for one
    column, AND, OR, NOT, + and - before a term, and brackets. Terms side by side are alternatives, or all needed if ``every``."""
    parts = re.findall(r'\(|\)|[+-]?(?:\w+:)?"[^"]*"|[^\s()]+', query)
    at = 0

    def term(text: str) -> Column:
        m = re.match(r"(\w+):(.*)$", text, re.S)
        own = [columns[m.group(1)]] if m and m.group(1) in columns else list(columns.values())
        word = m.group(2) if m and m.group(1) in columns else text
        out = F.lit(False)
        for c in own:
            if word.startswith('"'):
                one = match_phrase(c, word.strip('"'))
            elif "*" in word or "?" in word:
                spelt = re.escape(word.lower()).replace(r"\*", r"[\p{L}\p{N}]*").replace(r"\?", r"[\p{L}\p{N}]")
                one = holds(c, spelt)
            else:
                one = match(c, word, every=True)
            out = out | F.coalesce(one, F.lit(False))
        return out

    def single() -> Column:
        nonlocal at
        text = parts[at]
        at += 1
        if text == "NOT":
            return ~single()
        if text == "(":
            inner = anything()
            at += 1  # the closing bracket
            return inner
        return term(text.lstrip("+-")) if not text.startswith("-") else ~term(text[1:])

    def anything() -> Column:
        nonlocal at
        must, may = [], []
        while at < len(parts) and parts[at] != ")":
            if parts[at] in ("OR", "||"):
                at += 1
                continue
            needed = every or parts[at][0] in "+-" or parts[at] == "NOT"
            one = single()
            while at < len(parts) and parts[at] in ("AND", "&&"):
                at += 1
                one = one & single()
            (must if needed else may).append(one)
        out = F.lit(True)
        for m in must:
            out = out & m
        if may and not must:
            some = F.lit(False)
            for m in may:
                some = some | m
            out = some
        return out

    return anything() if parts else F.lit(False)


def wildcard_query(c: Column, pattern: str) -> Column:
    """Whether the whole text fits: ``*`` stands for any text, ``?`` for a character; a backslash makes the next one plain."""
    out, k = "", 0
    while k < len(pattern):
        one = pattern[k]
        if one == "\\" and k + 1 < len(pattern):
            k += 1
            out += like_escape(pattern[k])
        else:
            out += {"*": "%", "?": "_"}.get(one) or like_escape(one)
        k += 1
    return c.like(out)


def like_escape(one: str) -> str:
    return "\\" + one if one in "%_\\" else one
