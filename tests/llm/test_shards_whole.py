"""Equal texts stay together: nearly all rows linked, and a group larger than a shard."""

from collections import Counter, defaultdict

from millrace.llm import shards


def placed(spark, data, count=16):
    """Shards of each text's rows, after a check of sizes and slots."""
    text = dict(data)
    slots, of = defaultdict(list), defaultdict(Counter)
    for r in shards.assign(spark.createDataFrame(data, "doc_id long, text string"), shards=count).collect():
        slots[r.shard].append(r.slot)
        of[text[r.doc_id]][r.shard] += 1
    sizes = [len(slots[s]) for s in range(count)]
    assert sum(sizes) == len(data) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return of


def test_all_pairs(spark):
    of = placed(spark, [(k, f"pair {k // 2}") for k in range(3200)])
    assert sum(len(c) > 1 for c in of.values()) <= 16  # one at the end of a shard at most, of 1600


def test_hot_group_and_pairs(spark):
    of = placed(spark, [(k, "hot" if k < 1100 else f"pair {k // 2}") for k in range(3300)])
    assert len(of.pop("hot")) == 6  # 1100 rows, 206 or 207 a shard
    assert sum(len(c) > 1 for c in of.values()) <= 16
    of = placed(spark, [(k, "hot" if k % 3 == 0 else f"own {k}") for k in range(1600)])
    assert len(of["hot"]) == 6  # 534 rows, 100 a shard


def test_dealt_whole():
    room = [10, 10, 10]
    parts = shards.dealt_whole([("a", 14), ("b", 6), ("c", 6)], room)
    assert sorted((g, end - first) for g, _, first, end, _ in parts) == [("a", 4), ("a", 10), ("b", 6), ("c", 6)] and room == [0, 0, 4]
