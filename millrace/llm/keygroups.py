"""Counting content keys over all documents without a row per key.

Documents are dealt to groups of a few MB. A group sends its distinct keys, packed, to
buckets by key range; a bucket adds up what all groups sent and answers each with a count per
key, in the order sent. A group thus learns which of its keys occur elsewhere, and two passes over
the texts replace a shuffle of all keys. A key costs at most one entry per group, however often
it occurs in it. The numbers of partitions follow the bytes of text, so that a task's share stays the same at
every size up to PARTITIONS; beyond that a task works through more groups or buckets, one at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, release

#: Bytes of text in a group and in a partition, keys in a bucket, and partitions at most.
GROUP_BYTES, PARTITION_BYTES = 4 << 20, 32 << 20
BUCKET_KEYS, PARTITIONS = 500_000, 20_000
#: Counts end here: in what a group sends, and in what it is told.
SENT_MOST, MOST = 255, 65535


def dealt(source: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int, int]:
    """(g, doc_id, text, and rest if there), dealt to groups by a hash of id and text; the bytes of text; the partitions.

    Where rows equal in both would overfill a group, the rows are written and numbered first, and dealt by number.
    """
    same = source.groupBy(F.xxhash64("doc_id", "text").alias("same")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 100).alias("bytes"))
    found = same.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-found[0] // group_bytes))
    columns = source.columns
    deal = F.xxhash64("doc_id", "text")
    if found[1] > 4 * group_bytes:
        source = materialize(source.withColumn("row", F.monotonically_increasing_id()), "dealt")
        deal = F.xxhash64("row")
    cores = source.sparkSession.sparkContext.defaultParallelism
    parts = min(groups, PARTITIONS, max(cores, -(-found[0] // PARTITION_BYTES)))
    return source.select(F.pmod(deal, F.lit(groups)).alias("g"), *columns).repartition(parts, "g"), found[0], parts


def buckets_for(keys: int, per_bucket: int = BUCKET_KEYS) -> int:
    return max(1, -(-keys // per_bucket))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys: sorted keys have sorted buckets."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def in_order(table: pa.Table) -> pa.Table:
    """Rows of a group in an order that doesn't depend on how they arrived."""
    return table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def key_counts(groups: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], buckets: int, parts: int) -> DataFrame:
    """(g, bucket, counts): for each group's sorted distinct keys, 16-bit counts over all groups.

    ``keys_of`` gives a group's sorted distinct 64-bit keys and how often each counts there. Keys
    of a bucket are told apart by 32 bits, so a count may be too high, never too low.
    """

    def send(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        keys, counts = keys_of(in_order(table))
        own = bucket_of(keys, buckets)
        cut = np.flatnonzero(np.diff(own)) + 1
        edges = [0, *cut.tolist(), len(keys)] if len(keys) else [0]
        low, counts = keys.astype(np.uint32), np.minimum(counts, SENT_MOST).astype(np.uint8)
        rows = [(int(own[a]), low[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
        release()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "g": pa.array([g] * len(rows), pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
        _, place = np.unique(np.concatenate(sent), return_inverse=True)
        place = place.astype(np.int32)
        total = np.minimum(np.bincount(place, weights=counts), MOST).astype(np.uint16)[place]
        edges = np.cumsum([0, *map(len, sent)]).tolist()
        del place
        release()
        return pa.table({"g": table.column("g"), "bucket": table.column("bucket"), "counts": pa.array([total[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())})

    sent = groups.groupBy("g").applyInArrow(send, "bucket long, g long, keys binary, counts binary")
    told = sent.repartition(min(buckets, parts), "bucket").groupBy("bucket").applyInArrow(answer, "g long, bucket long, counts binary")
    return told.repartition(parts, "g")


def answers(table: pa.Table) -> np.ndarray:
    """What ``key_counts`` returned for a group, in the order of its sorted keys."""
    table = table.sort_by("bucket")
    return np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16)


def told(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each of a group's keys, in any order and repeated at will, what ``answers`` has for it."""
    _, place = np.unique(keys, return_inverse=True)
    return seen[place]
