"""Aggregation: groups, running and sliding windows, top values, charts over time, bins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window, WindowSpec

from millrace.functions import bins as buckets
from millrace.functions.bins import span
from millrace.operators.combine import numbered
from millrace.operators.shape import col


def stats(df: DataFrame, *aggs: Column, by: Sequence[str | Column] = (), nullable: bool = True) -> DataFrame:
    """Aggregates first, then the group keys; without ``nullable`` rows with a null key go."""
    keys = [col(k) if isinstance(k, str) else k for k in by]
    if not nullable:
        for k in keys:
            df = df.where(k.isNotNull())
    out = df.groupBy(*keys).agg(*aggs)
    names = out.columns
    return out.select(*[col(c) for c in names[len(keys) :]], *[col(c) for c in names[: len(keys)]])


def eventstats(df: DataFrame, aggs: dict[str, Column], by: Sequence[str] = (), nullable: bool = True) -> DataFrame:
    """Each row with the aggregates of its group; without ``nullable`` a row with a null key gets null.

    Groups are aggregated and joined back, so that a large group isn't held in one task as a window would.
    """
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggs.items()])))
    return beside(df, df.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(by)]).agg(*[a.alias(n) for n, a in aggs.items()]), by, nullable)


def beside(df: DataFrame, sums: DataFrame, by: Sequence[str], nullable: bool = True) -> DataFrame:
    """Each row with its group's row of ``sums``, whose keys are __k0, __k1, ...; without groups ``sums`` has one row."""
    if not by:
        return df.crossJoin(F.broadcast(sums))
    cond = None
    for i, k in enumerate(by):
        one = col(k).eqNullSafe(F.col(f"__k{i}")) if nullable else col(k) == F.col(f"__k{i}")
        cond = one if cond is None else cond & one
    return df.join(sums, cond, "left").drop(*[f"__k{i}" for i in range(len(by))])


def frame(by: Sequence[str], order: Sequence[Column], window: int, current: bool) -> WindowSpec:
    last = 0 if current else -1
    first = Window.unboundedPreceding if not window else last - window + 1
    return Window.partitionBy(*[col(k) for k in by]).orderBy(*order).rowsBetween(first, last)


#: Rows that one task orders where a running or sliding aggregate has no groups.
CHUNK = 100_000

Aggregate = Column | tuple[str, Column]


def plain(agg: Aggregate) -> Column:
    return agg if isinstance(agg, Column) else getattr(F, agg[0])(agg[1])


def chunked(df: DataFrame, order: Sequence[Column], reach: int) -> DataFrame:
    """Numbered rows (__n) in chunks; a chunk also has the ``reach`` rows before it, as others' rows (not __own)."""
    rows = numbered(df, order, "__n").withColumn("__chunk", F.floor((F.col("__n") - 1) / CHUNK))
    if not reach:
        return rows.withColumn("__own", F.lit(True))
    copies = [F.struct(F.col("__chunk").alias("c"), F.lit(True).alias("o"))]
    copies += [F.when(F.col("__n") > (F.col("__chunk") + k) * CHUNK - reach, F.struct((F.col("__chunk") + k).alias("c"), F.lit(False).alias("o"))) for k in range(1, -(-reach // CHUNK) + 1)]
    return rows.withColumn("__at", F.explode(F.array_compact(F.array(*copies)))).withColumn("__chunk", F.col("__at.c")).withColumn("__own", F.col("__at.o")).drop("__at")


def sliding(df: DataFrame, order: Sequence[Column], reach: int, made: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Window columns over all rows in one order, that look back ``reach`` rows at most, chunk by chunk."""
    rows = chunked(df, order, reach)
    w = Window.partitionBy("__chunk").orderBy("__n")
    return rows.select("*", *[v.alias(n) for n, v in made(w).items()]).where("__own").drop("__n", "__chunk", "__own")


def running(df: DataFrame, aggs: dict[str, tuple[str, Column]], order: Sequence[Column], current: bool) -> DataFrame:
    """Running count, sum, min, max or avg over all rows in one order: inside chunks, then with what the chunks before add."""
    join = {"count": lambda a, b: a + b, "sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    parts: dict[str, tuple[str, Column]] = {}
    for n, (f, c) in aggs.items():
        parts |= {f"__sum_{n}": ("sum", c.cast("double")), f"__count_{n}": ("count", c)} if f == "avg" else {f"__{f}_{n}": (f, c)}
    rows = chunked(df, order, 0)
    w = Window.partitionBy("__chunk").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    rows = rows.select("*", *[getattr(F, f)(c).over(w).alias(n) for n, (f, c) in parts.items()])
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    fold = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    whole = rows.groupBy("__chunk").agg(*[getattr(F, f)(c).alias(n) for n, (f, c) in parts.items()])
    carried = whole.select("__chunk", *[fold[f](n).over(before).alias(f"{n}_before") for n, (f, _) in parts.items()])
    both = rows.join(carried, "__chunk")
    got = {n: join[f](F.coalesce(F.col(f"{n}_before"), F.lit(0)) if f == "count" else F.col(f"{n}_before"), F.col(n)) for n, (f, _) in parts.items()}
    out = [(F.try_divide(got[f"__sum_{n}"], got[f"__count_{n}"]) if f == "avg" else got[f"__{f}_{n}"]).alias(n) for n, (f, _) in aggs.items()]
    return both.select(*[col(c) for c in df.columns], *out)


def streamstats(
    df: DataFrame, aggs: dict[str, Aggregate], order: Sequence[Column], by: Sequence[str] = (), window: int = 0, current: bool = True,
    reset_before: Column | None = None, reset_after: Column | None = None, whole: bool = False,
) -> DataFrame:
    """Running (``window`` 0) or sliding aggregates of the rows so far in each group; a reset starts afresh.

    ``whole``: the window is the last rows of all groups, of which those of the row's own group count. An aggregate
    is a column or (function, column). Without groups the rows are numbered by range and worked on in chunks; a running
    aggregate must then be a pair of count, sum, min, max or avg and its column, as others can't be put together from chunks.
    """
    keys = list(by)
    if (reset_before is not None or reset_after is not None) and not keys:
        parts = [("__before", reset_before, True), ("__after", reset_after, False)]
        for name, when, current_too in parts:
            df = running(df, {name: ("sum", F.when(when, 1).otherwise(0))}, order, current_too) if when is not None else df.withColumn(name, F.lit(0))
        df = df.withColumn("__segment", F.coalesce("__before", F.lit(0)) + F.coalesce("__after", F.lit(0))).drop("__before", "__after")
        keys = ["__segment"]
    elif reset_before is not None or reset_after is not None:
        w = frame(by, order, 0, True)
        fresh = F.lit(0)
        if reset_before is not None:
            fresh = fresh + F.sum(F.when(reset_before, 1).otherwise(0)).over(w)
        if reset_after is not None:
            fresh = fresh + F.coalesce(F.sum(F.when(reset_after, 1).otherwise(0)).over(frame(by, order, 0, False)), F.lit(0))
        df, keys = df.withColumn("__segment", fresh), [*keys, "__segment"]
    elif whole and window and keys:
        last = 0 if current else -1
        own = Window.partitionBy(*[col(k) for k in keys]).orderBy("__n").rangeBetween(last - window + 1, last)
        return numbered(df, order, "__n").select("*", *[plain(a).over(own).alias(n) for n, a in aggs.items()]).drop("__n")
    elif not keys and window:
        first, last = (-window + 1, 0) if current else (-window, -1)
        return sliding(df, order, window, lambda w: {n: plain(a).over(w.rowsBetween(first, last)) for n, a in aggs.items()})
    elif not keys:
        if not all(isinstance(a, tuple) and a[0] in ("count", "sum", "min", "max", "avg") for a in aggs.values()):
            raise ValueError("running aggregates without groups are pairs of count, sum, min, max or avg and a column")
        return running(df, aggs, order, current)
    own = frame(keys, order, window, current)
    return df.select("*", *[plain(a).over(own).alias(n) for n, a in aggs.items()]).drop("__segment")


def top(df: DataFrame, names: Sequence[str], n: int = 10, by: Sequence[str] = (), countfield: str = "count", showcount: bool = True, usenull: bool = True, rare: bool = False) -> DataFrame:
    """The ``n`` commonest (or rarest) values of each group, ties by value."""
    if not usenull:
        df = df.dropna(subset=list(names))
    counted = df.groupBy(*[col(c) for c in [*by, *names]]).agg(F.count("*").alias(countfield))
    ties = [col(c).asc_nulls_first() for c in names]
    order = [col(countfield).asc() if rare else col(countfield).desc(), *ties]
    if by:
        ranked = counted.withColumn("__rank", F.row_number().over(Window.partitionBy(*[col(c) for c in by]).orderBy(*order)))
        out = ranked.where(F.col("__rank") <= n).drop("__rank")
    else:
        out = counted.orderBy(*order).limit(n)
    return out if showcount else out.drop(countfield)


def chart(df: DataFrame, value: Column, by_row: Column | None, by_column: Column | None, name: str = "value", limit: int = 10, bottom: bool = False, useother: bool = True, other: str = "OTHER", usenull: bool = True, null: str = "NULL", fold: str = "sum") -> DataFrame:
    """Aggregate by row and column split in long form; columns beyond the ``limit`` largest totals become one.

    ``fold``: how the values of the columns beyond come together: sum, min, max or avg.
    """
    keys = [k for k in ((by_row.alias("row") if by_row is not None else None), (by_column.cast("string").alias("column") if by_column is not None else None)) if k is not None]
    out = df.groupBy(*keys).agg(value.alias(name))
    if by_row is not None:
        out = out.where(F.col("row").isNotNull() & col(name).isNotNull())
    if by_column is None:
        return out
    out = out.where(F.col("column").isNotNull()) if not usenull else out.withColumn("column", F.coalesce("column", F.lit(null)))
    if not limit:
        return out
    total = F.sum(name)
    kept = out.where(F.col("column") != null).groupBy("column").agg(total.alias("__t")).orderBy(F.col("__t").asc() if bottom else F.col("__t").desc(), "column").limit(limit).select("column", F.lit(True).alias("__keep"))
    marked = out.join(F.broadcast(kept), "column", "left")  # limit rows
    marked = marked.withColumn("column", F.when(F.col("__keep").isNotNull() | (F.col("column") == null), F.col("column")).otherwise(F.lit(other)))
    if not useother:
        marked = marked.where(F.col("column") != other)
    rows = ["row"] if by_row is not None else []
    return marked.groupBy(*rows, "column").agg(getattr(F, fold)(name).alias(name))


def timechart(df: DataFrame, value: Column, time: str, every: int = 1, unit: str = "m", by: Column | None = None, **options) -> DataFrame:
    """A chart whose rows are spans of time."""
    return chart(df, value, span(col(time), every, unit), by, **options)


def per(value: Column, seconds: int, every: int, unit: str) -> Column:
    """Sum of a value as a rate: per second (1), minute (60), hour (3600) or day (86400)."""
    length = every * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[unit]
    return F.sum(value) * F.lit(float(seconds)) / F.lit(float(length))


def timewrap(charted: DataFrame, name: str, every: int = 1, unit: str = "d", time: str = "row") -> DataFrame:
    """Fold the rows of a time chart into periods, one column for each that has rows, newest first ("latest", "1 before", ...). Rows without a time go."""
    length = every * {"h": 3600, "d": 86400, "w": 604800}[unit]
    sec = F.unix_seconds(col(time).cast("timestamp"))
    folded = charted.withColumn("__p", F.floor(sec / length)).withColumn("__o", F.timestamp_seconds(F.pmod(sec, F.lit(length))))
    last = charted.agg(F.floor(F.max(sec) / length).alias("__last"))
    folded = folded.crossJoin(F.broadcast(last)).withColumn("__age", F.col("__last") - F.col("__p")).where(F.col("__age").isNotNull())
    ages = sorted(r[0] for r in folded.select("__age").distinct().collect())  # a row for each column of the result
    out = folded.groupBy("__o").pivot("__age", ages).agg(F.first(name))
    return out.select(F.date_format("__o", "HH:mm:ss" if length <= 86400 else "dd HH:mm:ss").alias("offset"), *[col(str(a)).alias("latest" if a == 0 else f"{a} before") for a in ages])


def trendline(df: DataFrame, order: Sequence[Column], sma: dict[str, tuple[int, str]] | None = None, wma: dict[str, tuple[int, str]] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Simple and weighted moving averages over the last n rows; null until n rows are there. Rows with a null value go."""
    for _, name in [*(sma or {}).values(), *(wma or {}).values()]:
        df = df.where(col(name).isNotNull())

    def made(base: WindowSpec) -> dict[str, Column]:
        out = {}
        for target, (n, name) in (sma or {}).items():
            w = base.rowsBetween(-(n - 1), 0)
            out[target] = F.when(F.count("*").over(w) == n, F.avg(col(name)).over(w))
        for target, (n, name) in (wma or {}).items():
            total = F.lit(0.0)
            for k in range(n):
                total = total + F.lag(col(name), k).over(base) * F.lit(float(n - k))
            out[target] = total / F.lit(n * (n + 1) / 2)
        return out

    if not by:
        reach = max([n for n, _ in [*(sma or {}).values(), *(wma or {}).values()]], default=1)
        return sliding(df, order, reach, made)
    base = Window.partitionBy(*[col(k) for k in by]).orderBy(*order)
    return df.select("*", *[v.alias(n) for n, v in made(base).items()])


def xyseries(df: DataFrame, x: str, y: str, values: Sequence[str], data: Sequence[str], sep: str = ": ") -> DataFrame:
    """Pivot: a column for each value of ``y`` and data column."""
    aggs = [F.max(F.when(col(y).cast("string") == v, col(d))).alias(v if len(data) == 1 else f"{d}{sep}{v}") for d in data for v in values]
    return df.groupBy(col(x)).agg(*aggs)


def bin(df: DataFrame, name: str, width: float | None = None, unit: str | None = None, bins: int | None = None, minspan: float | None = None, start: float | None = None, end: float | None = None, log: tuple[float, float] | None = None, align: str | None = None, output: str | None = None) -> DataFrame:
    """Replace (or add as ``output``) a column by the bin that holds its value.

    By ``width`` (with a ``unit`` for times, counted from ``align``, a time, if given); by a logarithmic span
    (factor, base); or fitted to the column's own range: ``minspan``, at most ``bins``, or a range that ``start`` and
    ``end`` widen. Without any of these a time is cut to hours and a number fitted to its range. The range is one
    aggregate of two numbers.
    """
    value = col(name)
    kind = df.schema[name].dataType
    target = output or name
    if width is None and log is None and bins is None and minspan is None and start is None and end is None and isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        width, unit = 1, "h"
    if log is not None:
        factor, base = log
        k = F.floor(F.log(value / F.lit(float(factor))) / F.log(F.lit(float(base))))
        low = F.lit(float(factor)) * F.pow(F.lit(float(base)), k)
        return df.withColumn(target, F.when(value > 0, buckets.range_text(low, low * (base - 1))).otherwise("Invalid"))
    if width is not None and unit is not None:
        if align is None:
            return df.withColumn(target, span(value, width, unit))
        size = int(width) * buckets.SECONDS[unit]
        at = F.unix_seconds(F.lit(align).cast("timestamp"))
        sec = F.unix_seconds(value.cast("timestamp"))
        return df.withColumn(target, F.timestamp_seconds(sec - F.pmod(sec - at, F.lit(size))).cast("timestamp_ntz"))
    if width is not None:
        return df.withColumn(target, buckets.span_bucket(value, width))
    ends = df.agg(F.min(value).cast("double").alias("__low"), F.max(value).cast("double").alias("__high"))
    ranged = df.crossJoin(F.broadcast(ends))  # one row
    low, high = F.col("__low"), F.col("__high")
    if minspan is not None:
        made = buckets.minspan_bucket(value, minspan, low, high)
    elif bins is not None:
        made = buckets.width_bucket(value, bins, low, high)
    else:
        made = buckets.range_bucket(value, low, high, start, end)
    return ranged.withColumn(target, made).drop("__low", "__high")


def date_histogram(df: DataFrame, time: str, every: int, unit: str, *aggs: Column, empty: bool = True) -> DataFrame:
    """Aggregates for each span of time; with ``empty`` also the spans between without rows (counts of them are null)."""
    counted = df.where(col(time).isNotNull()).groupBy(span(col(time), every, unit).alias("bucket")).agg(*aggs)
    if not empty:
        return counted
    step = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "M": "month", "q": "quarter", "y": "year"}[unit]
    length = F.expr(f"INTERVAL {every * 3} MONTH" if unit == "q" else f"INTERVAL {every} {step}")
    ends = counted.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    every_one = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", length)).alias("bucket"))
    return every_one.join(counted, "bucket", "left")


def range_buckets(df: DataFrame, name: str, edges: Sequence[tuple[float | str | None, float | str | None]], *aggs: Column) -> DataFrame:
    """Aggregates for each given range [from, to) of a number or time, open where an end is None; ranges may overlap.

    Every range gives a row, without rows in it too (its counts are 0).
    """
    kind = df.schema[name].dataType

    def inside(a, b) -> Column:
        fits = col(name).isNotNull()
        if a is not None:
            fits = fits & (col(name) >= F.lit(a).cast(kind))
        return fits & (col(name) < F.lit(b).cast(kind)) if b is not None else fits

    tagged = df.withColumn("__range", F.explode(F.array_compact(F.array(*[F.when(inside(a, b), F.lit(k)) for k, (a, b) in enumerate(edges)]))))
    names = df.sparkSession.createDataFrame([(k, f"{'*' if a is None else a}-{'*' if b is None else b}") for k, (a, b) in enumerate(edges)], "__range int, bucket string")
    counted = tagged.groupBy("__range").agg(*aggs)
    out = F.broadcast(names).join(counted, "__range", "left")  # a row for each range
    return out.drop("__range")


def grouping(df: DataFrame, kind: str, names: Sequence[str], *aggs: Column, sets: Sequence[Sequence[str]] = ()) -> DataFrame:
    """``rollup``, ``cube`` or grouping ``sets`` of columns, with ``level``: which columns are summed over, as bits."""
    keys = [col(n) for n in names]
    if kind == "sets":
        grouped = df.groupingSets([[col(n) for n in s] for s in sets], *keys)
    else:
        grouped = getattr(df, kind)(*keys)
    return grouped.agg(F.grouping_id().alias("level"), *aggs)
