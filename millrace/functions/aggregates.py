"""Aggregates beyond Spark's own names: ordered, limited and approximate ones, for ``stats`` and its kin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_count_approx(c: Column, error: float = 0.05) -> Column:
    """HyperLogLog++ estimate of the number of distinct values."""
    return F.approx_count_distinct(c, error)


def first(c: Column, order: Column) -> Column:
    """The value that is not null and stands first in ``order``."""
    return F.min_by(c, F.when(c.isNotNull(), order))


def last(c: Column, order: Column) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), order))


def earliest(c: Column, time: Column | None = None) -> Column:
    """The value at the least time (``@timestamp`` unless given)."""
    return F.min_by(c, F.col("`@timestamp`") if time is None else time)


def latest(c: Column, time: Column | None = None) -> Column:
    return F.max_by(c, F.col("`@timestamp`") if time is None else time)


def take(c: Column, order: Column, n: int = 10) -> Column:
    """The first ``n`` values in ``order``, nulls too; the group's values must fit into memory."""
    got = F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("v")))), 1, n)
    return F.transform(got, lambda x: x["v"])


def listed(c: Column, order: Column, most: int = 100) -> Column:
    """The first values that are not null, as text, in ``order``, repeats included."""
    got = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.cast("string").alias("v")))))
    return F.transform(F.slice(got, 1, most), lambda x: x["v"])


def values(c: Column, most: int = 0) -> Column:
    """Distinct values as text, in the order of their characters; ``most`` 0: all."""
    got = F.array_sort(F.collect_set(c.cast("string")))
    return F.slice(got, 1, most) if most else got


def where(aggregate: str, condition: str) -> Column:
    """SQL's ``agg(x) FILTER (WHERE p)``."""
    return F.expr(f"{aggregate} FILTER (WHERE {condition})")


def percentile(c: Column, p: float, approx: bool = False) -> Column:
    """The percentile from 0 to 100, interpolated; ``approx``: a value near it, in bounded memory."""
    if not 0 <= p <= 100:
        raise ValueError("0 to 100")
    return F.percentile_approx(c, p / 100, 10_000) if approx else F.percentile(c, p / 100)
