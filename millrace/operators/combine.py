"""Joins, lookups, graph search, and putting results together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from millrace.operators.shape import col
from millrace.session import materialize


def join(left: DataFrame, right: DataFrame, on: Sequence[str] | Column | None = None, how: str = "inner", overwrite: bool = True, most: int | None = None) -> DataFrame:
    """Join on a condition, or on columns by name (all common ones, if none is named).

    By name, other common columns keep the right side's value if ``overwrite``, else the left's.
    ``most``: rows of the right side for each key.
    """
    if isinstance(on, Column):
        return left.join(right, on, how)
    keys = list(on) if on else [c for c in left.columns if c in right.columns]
    if most is not None:
        w = Window.partitionBy(*keys).orderBy(*[col(c) for c in right.columns])
        right = right.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most).drop("__rank")
    if how in ("semi", "anti", "left_semi", "left_anti"):
        return left.join(right.select(*keys), keys, how)
    common = [c for c in left.columns if c in right.columns and c not in keys]
    (left, right) = (left.drop(*common), right) if overwrite else (left, right.drop(*common))
    return left.join(right, keys, how)


def lookup(df: DataFrame, table: DataFrame, keys: dict[str, str] | Sequence[str], outputs: dict[str, str] | None = None, append: bool = False) -> DataFrame:
    """Left join that adds columns of a lookup table: ``keys`` maps its keys to columns of ``df``.

    ``outputs`` maps its columns to names in the result (all but the keys, if none). An existing column
    is overwritten, also by null; with ``append`` only its nulls are filled.
    """
    pairs = keys if isinstance(keys, dict) else {k: k for k in keys}
    wanted = outputs or {c: c for c in table.columns if c not in pairs}
    right = table.select(*[col(k).alias(f"__k_{k}") for k in pairs], *[col(c).alias(f"__v_{n}") for c, n in wanted.items()])
    cond = None
    for k, own in pairs.items():
        one = col(own) == F.col(f"`__k_{k}`")
        cond = one if cond is None else cond & one
    found = df.join(right, cond, "left")
    new = {n: F.coalesce(col(n), F.col(f"`__v_{n}`")) if append and n in df.columns else F.col(f"`__v_{n}`") for n in wanted.values()}
    return found.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns], *[v.alias(n) for n, v in new.items() if n not in df.columns])


def graph_lookup(df: DataFrame, edges: DataFrame, start: str, source: str, target: str, output: str, max_depth: int = 0, depth_field: str | None = None, both_ways: bool = False, where: Column | None = None) -> DataFrame:
    """For each row the edges reached breadth-first from its ``start`` within ``max_depth`` further steps, as an array of structs.

    ``where``: only edges that meet it are followed. ``start`` and ``target`` may be arrays: each element is a vertex.
    ``edges`` joins its ``source`` to the value sought; its ``target`` is sought next. Each row's vertices are visited once.
    Every depth is written to the shared folder, so that plans stay short, and the search ends where nothing new is met.
    """
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "graph")
    edges = edges.where(where) if where is not None else edges
    step = edges.withColumn("__from", col(source)).withColumn("__to", col(target))
    if isinstance(edges.schema[target].dataType, T.ArrayType):
        step = step.withColumn("__to", F.explode_outer("__to"))
    if both_ways:
        step = step.union(step.select(*[col(c) for c in edges.columns], F.col("__to").alias("__from"), F.col("__from").alias("__to")))
    at = F.explode(col(start)) if isinstance(df.schema[start].dataType, T.ArrayType) else col(start)
    front = rows.select("__row", at.alias("__at")).where(F.col("__at").isNotNull()).distinct()
    seen, found = front, None
    for depth in range(max_depth + 1):
        met = materialize(front.join(step, F.col("__at") == F.col("__from")).withColumn("__depth", F.lit(depth)), "graph")
        found = met if found is None else found.union(met)
        if depth == max_depth:
            break
        front = met.select("__row", F.col("__to").alias("__at")).where(F.col("__at").isNotNull()).distinct().join(seen, ["__row", "__at"], "left_anti")
        front = materialize(front, "graph")
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    parts = [col(c) for c in edges.columns] + ([F.col("__depth").alias(depth_field)] if depth_field else [])
    first = found.groupBy("__row", *[col(c) for c in edges.columns]).agg(F.min("__depth").alias("__depth"))
    gathered = first.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__depth", F.struct(*parts).alias("edge")))).alias("__found"))
    done = rows.join(gathered, "__row", "left")
    kind = T.ArrayType(T.StructType([f for f in edges.schema] + ([T.StructField(depth_field, T.IntegerType())] if depth_field else [])))
    return done.select(*[col(c) for c in df.columns], F.coalesce(F.transform("__found", lambda x: x["edge"]), F.array().cast(kind)).alias(output))


def in_subquery(df: DataFrame, names: Sequence[str], sub: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose columns are (not) among the rows of ``sub``, as SQL has it.

    IN is an equi semi join. NOT IN keeps a row only if it surely differs from every row of ``sub``: one that agrees
    wherever neither of the two is null goes too, so a null in a single column's subquery leaves nothing, and an empty
    subquery leaves all. Which nulls there are is looked up first (a few rows for each side); every combination of them is
    an equi anti join on the columns that are not null.
    """
    right = sub.toDF(*[f"__s{k}" for k in range(len(names))])
    if not negate:
        cond = col(names[0]) == F.col("__s0")
        for k, n in enumerate(names[1:], 1):
            cond = cond & (col(n) == F.col(f"__s{k}"))
        return df.join(right, cond, "left_semi")

    def known(columns: Sequence[str]) -> Column:
        return F.array(*[col(c).isNotNull() for c in columns])

    def having(part: DataFrame, columns: Sequence[str], pattern: Sequence[bool]) -> DataFrame:
        for c, there in zip(columns, pattern, strict=True):
            part = part.where(col(c).isNotNull() if there else col(c).isNull())
        return part

    def patterns(part: DataFrame, columns: Sequence[str]) -> list[tuple[bool, ...]]:
        return sorted(tuple(r[0]) for r in part.select(known(columns)).distinct().collect())  # 2^columns at most

    theirs = patterns(right, right.columns)
    if not theirs:
        return df
    parts = []
    for mine in patterns(df, names):
        own = having(df, names, mine)
        for other in theirs:
            both = [k for k in range(len(names)) if mine[k] and other[k]]
            if not both:
                own = None
                break
            cond = col(names[both[0]]) == F.col(f"__s{both[0]}")
            for k in both[1:]:
                cond = cond & (col(names[k]) == F.col(f"__s{k}"))
            own = own.join(having(right, right.columns, other).select(*[f"__s{k}" for k in both]), cond, "left_anti")
        if own is not None:
            parts.append(own)
    out = parts[0] if parts else df.limit(0)
    for p in parts[1:]:
        out = out.union(p)
    return out


def exists_subquery(df: DataFrame, sub: DataFrame, condition: Column, negate: bool = False) -> DataFrame:
    return df.join(sub, condition, "left_anti" if negate else "left_semi")


def scalar_subquery(df: DataFrame, name: str, sub: DataFrame) -> DataFrame:
    """The one value of a result as a column: null if it has no row, an error if it has several."""
    kind = sub.schema[0].dataType
    one = sub.toDF(name).limit(2).agg(F.count("*").alias("__n"), F.first(name).alias(name))
    value = F.when(F.col("__n") > 1, F.raise_error(F.lit("a scalar subquery returned more than one row")).cast(kind)).otherwise(F.col(name))
    return df.crossJoin(F.broadcast(one.select(value.alias(name))))  # one row


def with_missing(df: DataFrame, names: Sequence[str], types: dict[str, T.DataType]) -> DataFrame:
    return df.select(*[col(c).cast(types[c]).alias(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in names])


def append(main: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both; missing columns are null; one name must have one type."""
    for f in other.schema:
        if f.name in main.columns and main.schema[f.name].dataType != f.dataType:
            raise TypeError(f"{f.name} has two types")
    return main.unionByName(other, allowMissingColumns=True)


def appendpipe(main: DataFrame, pipe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return append(main, pipe(main))


def union(*parts: DataFrame, most: int | None = None) -> DataFrame:
    """All rows of two or more results; a column of several types becomes their common type, else text."""
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    rank = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    types: dict[str, T.DataType] = {}
    for n in names:
        kinds = [p.schema[n].dataType for p in parts if n in p.columns]
        types[n] = kinds[0] if all(k == kinds[0] for k in kinds) else max(kinds, key=lambda k: rank.index(type(k))) if all(type(k) in rank for k in kinds) else T.StringType()
    out = with_missing(parts[0], names, types)
    for p in parts[1:]:
        out = out.union(with_missing(p, names, types))
    return out.limit(most) if most is not None else out


def multisearch(*parts: DataFrame, time: str = "@timestamp") -> DataFrame:
    out = union(*parts)
    return out.orderBy(col(time).desc_nulls_last()) if time in out.columns else out


def appendcol(main: DataFrame, other: DataFrame, order: Sequence[Column], other_order: Sequence[Column], override: bool = False) -> DataFrame:
    """Two ordered results side by side by row number, the longer one's rows kept.

    Rows are numbered by range, not in one task: see ``numbered``.
    """
    a, b = numbered(main, order, "__n"), numbered(other, other_order, "__n")
    both = [c for c in other.columns if c in main.columns]
    b = b.select("__n", *[col(c).alias(f"__o_{c}") for c in other.columns])
    joined = a.join(b, "__n", "full")
    out = [F.coalesce(F.col(f"`__o_{c}`"), col(c)).alias(c) if override and c in both else col(c) for c in main.columns]
    return joined.select(*out, *[F.col(f"`__o_{c}`").alias(c) for c in other.columns if c not in both])


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in an order, by range partitions whose sizes are summed up first.

    The ranges come from a sample, so the ordered rows are written once, with their partition and place in it, before
    anything is counted. Rows equal in the order are told apart by a hash of all their columns.
    """
    keys = [*order, F.xxhash64(*[F.to_json(F.struct(col(c))) for c in df.columns]).asc()]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id()).withColumn("__i", place)
    ranged = materialize(ranged, "numbered")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__b"))  # a row for each partition
    return ranged.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__i") + 1).drop("__p", "__i", "__b")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str] = (), tolerance: str | None = None) -> DataFrame:
    """Every left row with the latest right row of its key that is not after it (null if none, or older than ``tolerance``).

    Both sides are put in one order per key and the last right row is carried forward, so no pair of rows is made.
    Keys are columns that both sides name alike; other columns must differ in name. Among right rows of one time the
    greatest of the remaining columns counts.
    """
    others = [c for c in right.columns if c not in by]
    carried = F.struct(*[col(c) for c in [right_time, *[c for c in others if c != right_time]]])
    a = left.select(*[col(k) for k in by], col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[col(c) for c in left.columns]).alias("__l"), F.lit(None).cast(right.select(carried.alias("r")).schema[0].dataType).alias("__r"))
    b = right.where(col(right_time).isNotNull()).select(*[col(k) for k in by], col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), carried.alias("__r"))
    w = Window.partitionBy(*[col(k) for k in by]).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where(F.col("__side") == 1)
    fits = F.col("__l")[left_time].isNotNull()
    for k in by:
        fits = fits & col(k).isNotNull()
    if tolerance:
        fits = fits & (F.col("__last")[right_time] >= F.col("__t") - F.expr(f"INTERVAL {tolerance}"))
    return met.select(*[F.col("__l")[c].alias(c) for c in left.columns], *[F.when(fits, F.col("__last")[c]).alias(c) for c in others])


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a left value and a right interval [low, high) that holds it, as an equi join on bins of ``width``.

    An interval is laid into every bin that it touches, so choose the width near the usual length of an interval.
    """
    bins_of = F.sequence(F.floor(col(low) / width).cast("long"), F.floor(col(high) / width).cast("long"))
    spread = right.where(col(low) < col(high)).withColumn("__bin", F.explode(bins_of))
    met = left.withColumn("__bin", F.floor(col(value) / width).cast("long")).join(spread, "__bin")
    return met.where((col(value) >= col(low)) & (col(value) < col(high))).drop("__bin")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
