"""Keyed state over streams: what each key has added up to so far, closed when the key has been idle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_totals(stream: DataFrame, key: str, value: str, time: str, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, n, total, last, closed): after every batch the keys that it changed, and once, closed, each key that the
    watermark has left ``idle`` behind; a key that comes again begins anew. Rows with a null key or time are passed over, a null value
    adds nothing to ``total``. The state of a key is three numbers, whatever its rows.
    """
    seconds = int(pd.Timedelta(idle).total_seconds())
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", late)

    def told(k: str, n: int, total: float, last: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [k], "n": [n], "total": [total], "last": [pd.Timestamp(last, unit="us")], "closed": [closed]})

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, total, last = state.get
            state.remove()
            yield told(k[0], n, total, last, True)
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for part in parts:
            n += len(part)
            total += float(part["value"].sum())
            last = max(last, int(part["time"].max().timestamp() * 1_000_000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield told(k[0], n, total, last, False)

    return rows.groupBy("key").applyInPandasWithState(step, "key string, n long, total double, last timestamp, closed boolean", "n long, total double, last long", "update", GroupStateTimeout.EventTimeTimeout)


def each_batch(result: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Hand every batch of a result to ``write`` with its number, which it can use to write a batch only once."""
    writer = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
