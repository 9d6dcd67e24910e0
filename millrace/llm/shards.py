"""Sharding by balanced label propagation.

Linked documents (those with equal texts, through their group) move round by round towards the
shard where most of their neighbours are, within quotas that the shards' capacities allow. Groups too
large to move so are dealt to shards first; groups that the rounds leave apart are placed together after
them. The documents without links then fill every shard to its exact size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.llm.common import inputs, materialize

#: Rows that one numbering task orders.
NUMBERED_ROWS = 20_000


def numbered(df: DataFrame, rows: int, by: list[str], deal: tuple[str, ...] = ("doc_id", "salt")) -> DataFrame:
    """``df`` with ``number``: gapless from 0 within each value of ``by``, without sorting all of it in one task.

    Rows are dealt to buckets by a hash of the columns ``deal``, and rows equal in them get consecutive numbers; buckets
    are numbered apart and offset by the rows of the buckets before them.
    """
    buckets = max(1, -(-rows // NUMBERED_ROWS))
    order = [*deal, *[c for c in ("doc_id", "salt") if c not in deal]]
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(*deal), F.lit(buckets)).cast("int"))
    keys = [*by, "bucket"]
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys).agg(F.count("*").alias("in_bucket")).withColumn("offset", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket")
    inside = Window.partitionBy(*keys).orderBy(*order)
    return dealt.withColumn("place", F.row_number().over(inside) - 1).join(offsets, keys).withColumn("number", F.col("offset") + F.col("place")).drop("bucket", "place", "offset")


def dealt_whole(large: list[tuple[str, int]], room: list[int]) -> list[tuple[str, int, int, int, int]]:
    """(grp, shard, first, end, room left before) of the large groups' rows; ``room`` shrinks by them.

    From the largest down, each goes to the fullest shard that holds all of it; where none does, it fills the emptiest and goes on.
    """
    out = []
    for grp, members in sorted(large, key=lambda x: (-x[1], x[0])):
        at = 0
        while at < members:
            fits = [s for s, r in enumerate(room) if r >= members - at]
            s = min(fits, key=lambda s: room[s]) if fits else max(range(len(room)), key=lambda s: room[s])
            part = min(members - at, room[s])
            out.append((grp, s, at, at + part, room[s]))
            at, room[s] = at + part, room[s] - part
    return out


def flows(wanted: dict[tuple[int, int], int], load: list[int], capacity: list[int]) -> dict[tuple[int, int], float]:
    """The share of each wish (from, to) that may move: swaps first, then what room the shards have."""
    share: dict[tuple[int, int], float] = {}
    room = [max(0, c - x) for c, x in zip(capacity, load, strict=True)]
    extra: dict[tuple[int, int], int] = {}
    for (a, b), n in wanted.items():
        swap = min(n, wanted.get((b, a), 0))
        share[a, b] = swap / n
        extra[a, b] = n - swap
    for b in range(len(load)):
        asked = sum(n for (_, to), n in extra.items() if to == b)
        part = min(1.0, room[b] / asked) if asked else 0
        for (a, to), n in extra.items():
            if to == b and n:
                share[a, b] += part * n / wanted[a, b]
    return share


def unit(*cols: Column | str) -> Column:
    """A number in [0, 1) from the hash of columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def at_shard(values: list[int], shard: str = "shard") -> Column:
    """The value of a row's shard."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(shard) + 1)


def propagate(linked: DataFrame, shards: int, capacity: list[int], rounds: int) -> DataFrame:
    """(doc_id, salt, grp, shard) of linked documents after moves towards their neighbours' shards.

    They start in proportion to the capacities. Equal votes go to a shard with room, then by a hash of group and shard, so
    that as many wish for a shard as wish to leave it.
    """
    ends = [sum(capacity[: s + 1]) for s in range(shards)]
    draw = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(max(1, ends[-1])))
    start = sum(((draw >= F.lit(e)).cast("int") for e in ends[:-1]), F.lit(0))
    state = materialize(linked.select("doc_id", "salt", "grp", start.alias("shard")), "shards")
    for turn in range(rounds):
        count = {r.shard: r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        load = [count.get(s, 0) for s in range(shards)]
        room = at_shard([int(x < c) for c, x in zip(capacity, load, strict=True)])
        votes = state.groupBy("grp", "shard").agg(F.count("*").alias("votes"))
        most = votes.groupBy("grp").agg(F.max(F.struct("votes", room.alias("room"), F.xxhash64("grp", "shard").alias("tie"), "shard")).alias("best"))
        # Written first, so that both sides of the join are shuffled and Spark can split a large group's rows.
        most = materialize(most.select("grp", F.col("best.shard").alias("to")), "most")
        wish = state.join(most, "grp")
        found = wish.where(F.col("shard") != F.col("to")).groupBy("shard", "to").agg(F.count("*").alias("n")).collect()  # shards squared rows at most
        wanted = {(r.shard, r.to): r.n for r in found}
        share = flows(wanted, load, capacity)
        if not any(share.values()):
            break
        quota = F.create_map(*[x for (a, b), v in share.items() for x in (F.lit(a * shards + b), F.lit(float(v)))])
        # A group's members in one shard move as one.
        moves = (F.col("shard") != F.col("to")) & (unit("grp", F.lit(turn)) < F.coalesce(F.try_element_at(quota, F.col("shard") * shards + F.col("to")), F.lit(0.0)))
        state = materialize(wish.select("doc_id", "salt", "grp", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shards")
    return state


def settled(state: DataFrame, rows: int, capacity: list[int]) -> DataFrame:
    """(salt, shard, number) of the groups that are whole in a shard and within its capacity."""
    whole = state.groupBy("grp").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).where("lo = hi").select("grp")
    ranked = materialize(numbered(state.join(whole, "grp"), rows, ["shard"], ("grp",)).select("salt", "grp", "shard", "number"), "ranked")
    size = at_shard(capacity)
    # The groups that a shard's end cuts, one a shard at most: their last numbers leave no gap.
    ends = [r.grp for r in ranked.where((F.col("number") == size) | (F.col("number") == size - 1)).select("grp").collect()]
    cut = sorted({g for g in ends if ends.count(g) > 1})
    return ranked.where((F.col("number") < size) & (~F.col("grp").isin(cut) if cut else F.lit(True))).select("salt", "shard", "number")


def assign(docs: DataFrame, shards: int = 16, rounds: int = 4) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    The law is ``rows``: the shards' numbers of rows are at most one apart. Equal texts are neighbours and
    go to one shard as far as its size allows; a null text has none. size: UTF-8 bytes of the text (null: 0) plus 1; slots
    are gapless from 0. Repeated rows are rows of their own. Empty input gives no rows. Column names beside doc_id and text
    don't matter; of a text only its size and hashes are moved, however long it is.

    A group of over an eighth of a shard is split only where no shard has room for it, and then over as few as that
    allows. Of the other groups, one at most is split at the end of each shard.
    """
    source = inputs(docs).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.sha2("text", 256).alias("grp"))
    rows = materialize(source.withColumn("salt", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    target = [n // shards + (s < n % shards) for s in range(shards)]
    limit = max(1, min(target) // 8)
    groups = materialize(rows.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("m")).where("m > 1"), "groups")
    linked = materialize(rows.join(groups, "grp").select("doc_id", "salt", "grp", "m"), "linked")
    large = [(r.grp, r.m) for r in groups.where(F.col("m") > limit).collect()]  # 16 a shard at most
    room = list(target)
    plan = [(grp, s, first, end, target[s] - left - first) for grp, s, first, end, left in dealt_whole(large, room)]
    parts = linked.sparkSession.createDataFrame(plan, "grp string, shard int, first long, end long, shift long")
    ranked = numbered(linked.where(F.col("m") > limit), max((m for _, m in large), default=0), ["grp"])
    inside = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end"))
    whole = ranked.join(F.broadcast(parts), "grp").where(inside).select("salt", "shard", (F.col("number") + F.col("shift")).alias("slot"))  # 17 parts a shard at most
    small = linked.where(F.col("m") <= limit)
    stay = materialize(settled(propagate(small, shards, room, rounds), small.count(), room), "stay")
    count = {r.shard: r.n for r in stay.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    held = [t - r + count.get(s, 0) for s, (t, r) in enumerate(zip(target, room, strict=True))]
    stay = stay.select("salt", "shard", (F.col("number") + at_shard([t - r for t, r in zip(target, room, strict=True)])).alias("slot"))
    # Groups left apart come next, each in one piece, then the documents without links.
    apart = materialize(small.join(stay.select("salt"), "salt", "left_anti"), "apart")
    first = apart.count()
    alone = rows.join(linked.select("salt"), "salt", "left_anti")
    shard, slot, at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        need, have = target[s] - held[s], held[s]
        mine = (F.col("number") >= at) & (F.col("number") < at + need)
        shard, slot = F.when(mine, F.lit(s)).otherwise(shard), F.when(mine, F.col("number") - at + have).otherwise(slot)
        at += need
    filled = numbered(apart.withColumn("all", F.lit(0)), first, ["all"], ("grp",)).select("salt", shard.alias("shard"), slot.alias("slot"))
    rest = numbered(alone.withColumn("all", F.lit(0)), n, ["all"]).withColumn("number", F.col("number") + first)
    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    placed = rows.join(whole.union(stay).union(filled), "salt").select(*columns)
    return placed.union(rest.withColumn("shard", shard).withColumn("slot", slot).select(*columns))
