"""Order, first rows, repeats, arrays to rows and back, totals and transposition."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from millrace.operators.shape import col


def sort(df: DataFrame, *keys: str, limit: int = 0) -> DataFrame:
    """``+name`` or ``name`` ascending, nulls first; ``-name`` descending, nulls last. ``limit`` 0: all rows.

    ``num(name)`` sorts text by its number (other text is null), ``str(name)`` as text, ``ip(name)`` by address,
    ``auto(name)`` as it is.
    """
    order = []
    for k in keys:
        name = k.lstrip("+-")
        m = re.fullmatch(r"(auto|str|ip|num)\((.*)\)", name)
        own = SORTED_AS[m.group(1)](col(m.group(2))) if m else col(name)
        order.append(own.desc_nulls_last() if k.startswith("-") else own.asc_nulls_first())
    out = df.orderBy(*order)
    return out.limit(limit) if limit else out


def ip_order(c: Column) -> Column:
    """Key that sorts IPv4 addresses by number."""
    return F.transform(F.split(c, "\\."), lambda x: x.try_cast("int"))


SORTED_AS = {"auto": lambda c: c, "str": lambda c: c.cast("string"), "num": lambda c: c.cast("string").try_cast("double"), "ip": ip_order}


def head(df: DataFrame, n: int = 10, skip: int = 0) -> DataFrame:
    return df.offset(skip).limit(n) if skip else df.limit(n)


def reverse(df: DataFrame, keys: Sequence[str] = (), time: str = "@timestamp") -> DataFrame:
    """The other way round: of the sort keys if given, else newest first where there is a time."""
    if keys:
        return sort(df, *[k[1:] if k.startswith("-") else f"-{k.lstrip('+')}" for k in keys])
    return df.orderBy(col(time).desc_nulls_last()) if time in df.columns else df


def dedup(df: DataFrame, *keys: str, n: int = 1, order: Sequence[Column] = (), keepempty: bool = False, consecutive: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each key, by ``order``; rows with a null key go, or all stay if ``keepempty``.

    Without an order the rows' own values decide, so that the result is the same every time. ``consecutive``: only
    rows equal to the one right before them, in ``order``, are repeats; ``within`` names columns that part the rows
    into sequences of their own (without any, all rows are one sequence, in one task).
    """
    full = None
    for k in keys:
        full = col(k).isNotNull() if full is None else full & col(k).isNotNull()
    ranked = list(order) or [col(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)]
    if consecutive:
        if not order:
            raise ValueError("consecutive repeats need an order")
        w = Window.partitionBy(*[col(k) for k in within]).orderBy(*ranked)
        fresh = F.lit(False)
        for k in keys:
            fresh = fresh | ~F.lag(col(k)).over(w).eqNullSafe(col(k))
        first = F.row_number().over(w) == 1
        own = df.where(full).withColumn("__new", (first | fresh).cast("int")).withColumn("__run", F.sum("__new").over(w))
        kept = own.withColumn("__rank", F.row_number().over(Window.partitionBy(*[col(k) for k in within], "__run").orderBy(*ranked))).where(F.col("__rank") <= n).drop("__new", "__run", "__rank")
    else:
        kept = df.where(full).withColumn("__rank", F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(*ranked))).where(F.col("__rank") <= n).drop("__rank")
    return kept.union(df.where(~full)) if keepempty else kept


def expand(df: DataFrame, name: str, alias: str | None = None, limit: int = 0) -> DataFrame:
    """A row for each element of an array; rows with an empty or null array go. A column that is no array stays."""
    if not isinstance(df.schema[name].dataType, T.ArrayType):
        return df
    own = F.slice(col(name), 1, limit) if limit else col(name)
    target = alias or name
    return df.select(*[F.explode(own).alias(target) if c == name else col(c) for c in df.columns])


def nomv(df: DataFrame, name: str) -> DataFrame:
    """An array as lines of text, without nulls; empty for none."""
    return df.withColumn(name, F.coalesce(F.array_join(F.array_compact(col(name).cast("array<string>")), "\n"), F.lit("")))


def mvcombine(df: DataFrame, name: str) -> DataFrame:
    """Rows alike in all other columns as one, with the values as an array without nulls."""
    others = [c for c in df.columns if c != name]
    return df.groupBy(*[col(c) for c in others]).agg(F.array_sort(F.collect_list(col(name))).alias(name)).select(*[col(c) for c in df.columns])


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def addtotals(df: DataFrame, names: Sequence[str] = (), row: bool = True, fieldname: str = "Total", columns: bool = False, labelfield: str | None = None, label: str = "Total") -> DataFrame:
    """A column with the sum of a row's numbers, and a row with the sums of the columns."""
    wanted = [n for n in (names or numeric(df)) if n in numeric(df)]
    out = df
    if row and wanted:
        total = F.lit(0)
        for n in wanted:
            total = total + F.coalesce(col(n), F.lit(0))
        out = out.withColumn(fieldname, total)
    return addcoltotals(out, [*wanted], labelfield, label) if columns else out


def addcoltotals(df: DataFrame, names: Sequence[str] = (), labelfield: str | None = None, label: str = "Total") -> DataFrame:
    wanted = list(names or numeric(df))
    if labelfield and labelfield not in df.columns:
        df = df.withColumn(labelfield, F.lit(None).cast("string"))
    sums = df.agg(*[F.sum(col(n)).alias(n) for n in wanted])
    kinds = {f.name: f.dataType for f in df.schema}
    last = sums.select(*[col(c).cast(kinds[c]).alias(c) if c in wanted else F.lit(label if c == labelfield else None).cast(kinds[c]).alias(c) for c in df.columns])
    return df.union(last)


def transpose(df: DataFrame, n: int = 5, column_name: str = "column", order: Sequence[Column] = ()) -> DataFrame:
    """Columns of the first ``n`` rows become rows of text: the name, then ``row 1`` to ``row n``."""
    if not 0 < n <= 10_000:
        raise ValueError("1 to 10000 rows")
    first = (df.orderBy(*order) if order else df).limit(n)
    one = first.select(F.struct(*[col(c).cast("string").alias(c) for c in df.columns]).alias("r")).agg(F.collect_list("r").alias("rows"))
    entry = [F.struct(F.lit(c).alias("name"), *[F.try_element_at(F.col("rows"), F.lit(k + 1))[c].alias(f"v{k}") for k in range(n)]) for c in df.columns]
    return one.select(F.explode(F.array(*entry)).alias("e")).select(F.col("e.name").alias(column_name), *[F.col(f"e.v{k}").alias(f"row {k + 1}") for k in range(n)])
