"""Field shaping: choose, rename, compute, fill, replace, convert and extract columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from millrace.functions import convert as conversions
from millrace.functions.json_edit import json_extract_all


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col(f"`{name}`")


def fields(df: DataFrame, *names: str, exclude: bool = False) -> DataFrame:
    """Keep (or drop) columns by name or ``*`` wildcard, in the order asked for, each once."""
    chosen = [c for n in names for c in ([c for c in df.columns if fnmatchcase(c, n)] if "*" in n else [n])]
    if exclude:
        return df.select(*[col(c) for c in df.columns if c not in chosen])
    return df.select(*[col(c) for c in dict.fromkeys(chosen)])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; ``x*`` to ``y*`` renames all that match.

    A name that exists already gives way. A missing source with an existing target drops the target.
    """
    for old, new in names.items():
        if old.count("*") != new.count("*"):
            raise ValueError(f"wildcards differ: {old} and {new}")
        if "*" in old:
            pattern = re.compile("(.*)".join(map(re.escape, old.split("*"))))
            found = {c: m.groups() for c in df.columns if (m := pattern.fullmatch(c))}
            pieces = new.split("*")
            pairs = {c: "".join(x for p in zip(pieces, (*g, ""), strict=True) for x in p) for c, g in found.items()}
        else:
            pairs = {old: new}
        for a, b in pairs.items():
            if a == b:
                continue
            kept = [c for c in df.columns if c != b]
            df = df.select(*[col(c).alias(b) if c == a else col(c) for c in kept]) if a in df.columns or b in df.columns else df
    return df


def evaluate(df: DataFrame, **exprs: Column | str) -> DataFrame:
    """Add or replace columns from left to right; later ones see earlier ones."""
    for name, e in exprs.items():
        df = df.withColumn(name, F.expr(e) if isinstance(e, str) else e)
    return df


def fieldformat(df: DataFrame, name: str, value: Column, prefix: str = "", suffix: str = "") -> DataFrame:
    return df.withColumn(name, F.concat(F.lit(prefix), value.cast("string"), F.lit(suffix)))


def foreach(df: DataFrame, pattern: str, template: str, target: str = "<<FIELD>>") -> DataFrame:
    """Evaluate an expression for every column that matches; <<FIELD>> stands for its name, <<MATCHSTR>> for the part under
    the (first) ``*``, <<MATCHSEG1>>, <<MATCHSEG2>>, ... for the parts under each."""
    rule = re.compile("(.*)".join(map(re.escape, pattern.split("*"))))
    for c in list(df.columns):
        m = rule.fullmatch(c)
        if m:
            part = m.group(1) if m.groups() else c
            names = {"<<FIELD>>": c, "<<MATCHSTR>>": part} | {f"<<MATCHSEG{k}>>": g for k, g in enumerate(m.groups(), 1)}
            fill = lambda s, names=names: re.sub("|".join(names), lambda x: names[x.group(0)], s)
            df = df.withColumn(fill(target), F.expr(fill(template)))
    return df


def fillnull(df: DataFrame, value=None, names: Sequence[str] = (), using: Mapping | None = None) -> DataFrame:
    """Nulls of the named columns (all, if none is named) become the value, or each column its own."""
    own = dict(using or {}) or {c: value for c in (names or df.columns)}
    family = lambda x: "text" if isinstance(x, str) else "flag" if isinstance(x, bool) else "number"
    kinds = {f.name: "text" if isinstance(f.dataType, T.StringType) else "flag" if isinstance(f.dataType, T.BooleanType) else "number" if isinstance(f.dataType, T.NumericType) else "other" for f in df.schema}
    wrong = [c for c, v in own.items() if kinds[c] != family(v)]
    if wrong and (names or using):
        raise TypeError(f"value and column differ in type: {wrong}")
    return df.select(*[F.coalesce(col(c), F.lit(own[c])).alias(c) if c in own and c not in wrong else col(c) for c in df.columns])


def replace(df: DataFrame, pairs: Mapping[str, str], names: Sequence[str]) -> DataFrame:
    """Replace whole values that match; ``*`` stands for any text, and as many of it may return in the replacement."""
    for c in names:
        value = col(c)
        for old, new in pairs.items():
            if "*" not in old:
                value = F.when(value == old, F.lit(new)).otherwise(value)
                continue
            if new.count("*") not in (0, old.count("*")):
                raise ValueError(f"wildcards differ: {old} and {new}")
            rule = "^" + "(.*?)".join(f"\\Q{p}\\E" if p else "" for p in old.split("*")) + "$"
            parts = new.replace("\\", "\\\\").replace("$", "\\$").split("*")
            value = F.regexp_replace(value, rule, "".join(p + (f"${k + 1}" if k < len(parts) - 1 else "") for k, p in enumerate(parts)))
        df = df.withColumn(c, value)
    return df


def convert(df: DataFrame, **functions: tuple[str, ...]) -> DataFrame:
    """``target=(function, source)``: auto, num, rmcomma, rmunit, memk, mstime, dur2sec, ctime, mktime or none; ctime and
    mktime take a time format as a third part."""
    for target, (name, source, *fmt) in functions.items():
        df = df.withColumn(target, getattr(conversions, name)(col(source), *fmt) if name != "none" else col(source))
    return df


def flatten(df: DataFrame, name: str, names: Sequence[str] = ()) -> DataFrame:
    """A struct column's parts as columns of their own, under their names or the given ones."""
    parts = df.schema[name].dataType.names
    if names and len(names) != len(parts):
        raise ValueError(f"{len(parts)} parts, {len(names)} names")
    return df.select("*", *[col(name)[p].alias(n) for p, n in zip(parts, names or parts, strict=True)])


def regex(df: DataFrame, name: str, pattern: str, negate: bool = False) -> DataFrame:
    found = col(name).rlike(pattern)
    return df.where(~found if negate else found)


GROUP = re.compile(r"\(\?<([A-Za-z][A-Za-z0-9]*)>")


def group_numbers(pattern: str) -> dict[str, int]:
    """Numbers of the named groups of a pattern."""
    out, number = {}, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|\((\?(?!<[A-Za-z]))?", pattern):
        if m.group(0) == "(":
            number += 1
            named = GROUP.match(pattern, m.start())
            if named:
                out[named.group(1)] = number
    return out


def parse(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Named groups of a pattern that matches the whole value, as text columns; empty where it doesn't match."""
    whole = f"^(?:{pattern})$"
    return df.select("*", *[F.coalesce(F.regexp_extract(col(name), whole, k), F.lit("")).alias(g) for g, k in group_numbers(pattern).items()])


#: Pieces of the grok language in common use.
GROK = {
    "WORD": r"\b\w+\b", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*", "INT": r"[+-]?[0-9]+", "NUMBER": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "IP": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", "HOSTNAME": r"\b[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?", "IPORHOST": r"(?:%{IP}|%{HOSTNAME})",
    "USER": r"[a-zA-Z0-9._-]+", "EMAILADDRESS": r"[a-zA-Z0-9_.+=:-]+@%{HOSTNAME}", "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}", "LOGLEVEL": r"(?:[Tt]race|TRACE|[Dd]ebug|DEBUG|[Ii]nfo|INFO|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Ff]atal|FATAL)",
    "QUOTEDSTRING": r'"(?:\\.|[^\\"])*"', "URIPATH": r"(?:/[\w$.+!*'(){},~:;=@#%&-]*)+", "HTTPDATE": r"\d{1,2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}",
    "USERNAME": r"[a-zA-Z0-9._-]+", "BASE10NUM": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)", "BASE16NUM": r"(?<![0-9A-Fa-f])[+-]?(?:0x)?[0-9A-Fa-f]+", "POSINT": r"\b[1-9][0-9]*\b", "NONNEGINT": r"\b[0-9]+\b",
    "MAC": r"(?:[A-Fa-f0-9]{2}[:-]){5}[A-Fa-f0-9]{2}", "HOSTPORT": r"%{IPORHOST}:%{POSINT}", "PATH": r"(?:/[\w_%!$@:.,~+-]*)+", "URIPROTO": r"[A-Za-z]+(?:\+[A-Za-z+]+)?", "URIHOST": r"%{IPORHOST}(?::%{POSINT})?",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\[\]<>-]*", "URI": r"%{URIPROTO}://(?:%{USER}@)?(?:%{URIHOST})?(?:%{URIPATH}(?:%{URIPARAM})?)?",
    "MONTHNUM": r"0?[1-9]|1[0-2]", "MONTHDAY": r"(?:0[1-9]|[12][0-9]|3[01]|[1-9])", "YEAR": r"(?:\d\d){1,2}", "HOUR": r"(?:2[0123]|[01]?[0-9])", "MINUTE": r"[0-5][0-9]", "SECOND": r"(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?",
    "TIME": r"%{HOUR}:%{MINUTE}(?::%{SECOND})?", "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))", "TIMESTAMP_ISO8601": r"%{YEAR}-(?:%{MONTHNUM})-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?",
    "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)", "MONTH": r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b",
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}", "PROG": r"[\w._/%-]+", "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?",
    "COMBINEDAPACHELOG": r"%{COMMONAPACHELOG} %{QUOTEDSTRING:referrer} %{QUOTEDSTRING:agent}",
    "COMMONAPACHELOG": r'%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] "(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})" %{NUMBER:response} (?:%{NUMBER:bytes}|-)',
}


def grok_pattern(pattern: str, known: Mapping[str, str] = GROK) -> tuple[str, dict[str, str]]:
    """A pattern with its %{NAME:field} parts spelt out, and the field of each group."""
    names: dict[str, str] = {}

    def spell(m: re.Match) -> str:
        inner = re.sub(r"%\{(\w+)(?::([\w.@]+))?\}", spell, known[m.group(1)])
        if not m.group(2):
            return f"(?:{inner})"
        group = f"g{len(names)}"
        names[group] = m.group(2)
        return f"(?<{group}>{inner})"

    return re.sub(r"%\{(\w+)(?::([\w.@]+))?\}", spell, pattern), names


def grok(df: DataFrame, name: str, pattern: str, known: Mapping[str, str] | None = None) -> DataFrame:
    """Fields of a grok pattern found anywhere in the value; empty where it isn't found."""
    spelt, names = grok_pattern(pattern, GROK | dict(known or {}))
    numbers = group_numbers(spelt)
    return df.select("*", *[F.coalesce(F.regexp_extract(col(name), spelt, numbers[g]), F.lit("")).alias(f) for g, f in names.items()])


def rex(df: DataFrame, name: str, pattern: str, max_match: int = 1, offset_field: str | None = None) -> DataFrame:
    """Named groups of the first match (null without one), or arrays of the first ``max_match`` matches (0: ten)."""
    if max_match > 10:
        raise ValueError("at most 10 matches")
    out = []
    for g, k in group_numbers(pattern).items():
        if max_match == 1:
            out.append(F.when(col(name).rlike(pattern), F.regexp_extract(col(name), pattern, k)).alias(g))
        else:
            every = F.regexp_extract_all(col(name), F.lit(pattern), F.lit(k))
            out.append(F.when(F.size(every) > 0, F.slice(every, 1, max_match or 10)).alias(g))
    if offset_field:
        out.append(F.when(col(name).rlike(pattern), F.regexp_instr(col(name), F.lit(pattern)) - 1).alias(offset_field))
    return df.select("*", *out)


def sed(df: DataFrame, name: str, expression: str) -> DataFrame:
    """``s/old/new/`` or ``s/old/new/g`` replaces all matches; ``y/abc/xyz/`` maps characters."""
    mark = expression[1]
    kind, old, new = expression[0], *re.split(rf"(?<!\\){re.escape(mark)}", expression[2:])[:2]
    if kind == "y":
        return df.withColumn(name, F.translate(col(name), old, new))
    return df.withColumn(name, F.regexp_replace(col(name), old, re.sub(r"\\(\d)", r"$\1", new)))


def json_path(path: str) -> str:
    """``a.b{}.c{2}`` as a JSON path."""
    return "$." + re.sub(r"\{(\d*)\}", lambda m: f"[{m.group(1) or '*'}]", path)


def spath(df: DataFrame, name: str, path: str | None = None, output: str | None = None) -> DataFrame:
    """The value at a path of JSON text; without a path a map of all paths to their values as text."""
    if path is None:
        return df.withColumn(output or name, json_extract_all(col(name)))
    return df.withColumn(output or path, F.get_json_object(col(name), json_path(path)))


def simple_pattern(value: Column, mask: str = "[a-zA-Z0-9]+") -> Column:
    """A message with every run of letters and digits as one token."""
    return F.regexp_replace(value, mask, "<*>")


def patterns(df: DataFrame, name: str, by: Sequence[str] = (), samples: int = 10, aggregate: bool = False, numbered_tokens: bool = False) -> DataFrame:
    """Label rows with the simple pattern of a message, or count patterns with up to ``samples`` different messages of each.

    ``numbered_tokens``: a pattern's variable parts are <token1>, <token2>, ..., and ``tokens`` maps them to what stands
    there (in the least of a pattern's messages, if counted). The samples are the least messages in order, of which
    each task keeps no more than it needs.
    """
    labelled = df.withColumn("patterns_field", F.coalesce(simple_pattern(col(name)), F.lit("")))
    if aggregate:
        first = labelled.select(*[col(k) for k in by], "patterns_field", col(name).alias("__m")).groupBy(*[col(k) for k in by], "patterns_field", "__m").agg(F.count("*").alias("__n"))
        place = F.row_number().over(Window.partitionBy(*[col(k) for k in by], "patterns_field").orderBy(F.col("__m").asc_nulls_last()))
        ranked = first.withColumn("__r", place)
        shown = F.sort_array(F.collect_list(F.when(F.col("__r") <= samples, F.col("__m"))))
        labelled = ranked.groupBy(*[col(k) for k in by], "patterns_field").agg(F.sum("__n").alias("pattern_count"), F.min("__m").alias("sample_log"), shown.alias("sample_logs"))
    if not numbered_tokens:
        return labelled
    message = F.coalesce(F.col("sample_log") if aggregate else col(name), F.lit(""))
    found = F.regexp_extract_all(message, F.lit("([a-zA-Z0-9]+)"), F.lit(1))
    pieces = F.split(F.col("patterns_field"), F.lit(r"<\*>"), F.lit(-1))
    marks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))), lambda k: F.concat(F.lit("<token"), k.cast("string"), F.lit(">")))
    spelt = F.aggregate(F.sequence(F.lit(1), F.size(pieces)), F.lit(""), lambda s, k: F.concat(s, F.element_at(pieces, k), F.when(k < F.size(pieces), F.element_at(marks, k)).otherwise("")))
    tokens = F.when(F.size(found) > 0, F.map_from_arrays(marks, found)).otherwise(F.create_map().cast("map<string,string>"))
    return labelled.withColumn("tokens", tokens).withColumn("patterns_field", spelt)


def foreach_items(df: DataFrame, name: str, start: str, template: str, output: str, from_json: bool = False) -> DataFrame:
    """Fold an array (or, with ``from_json``, a JSON array's texts) into one value: ``template`` is evaluated for each
    element, with <<ITEM>> for it, <<ITER>> for its number from 0 and <<VALUE>> for the value so far, which begins as ``start``."""
    items = F.from_json(col(name), "array<string>") if from_json else col(name)
    spelt = template.replace("<<ITEM>>", "__x.item").replace("<<ITER>>", "__x.iter").replace("<<VALUE>>", "__s")
    made = df.withColumn("__items", F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("iter"))))
    return made.withColumn(output, F.expr(f"aggregate(__items, {start}, (__s, __x) -> {spelt})")).drop("__items")
