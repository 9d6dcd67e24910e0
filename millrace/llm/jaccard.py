"""Near-duplicate documents: exact n-gram Jaccard join with rare-first prefix filtering.

Each document is the set of its word n-grams. The n-grams are counted over all documents and each
set is ordered rare first; two sets as similar as the threshold must share an n-gram within
their prefixes of that order. An n-gram of one document only can't be shared, so a document whose
whole prefix is its own has no partner and goes no further. What remains is joined on prefix
n-grams under length, positional and suffix filters, and every pair is verified once. Large groups of near
copies are first linked in rounds, in each of which a set meets HUBS others at most, one of the hubs of its n-grams for
each seed: first the most central set, whose rarest n-grams are the most frequent ones, as the text that copies were made
from, then others by chance; only pairs that those links leave in different components are then compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BASE, LOWER, column_bytes, discard, distinct, inputs, materialize, mix, release, steps, word_keys
from millrace.llm.keygroups import answers, buckets_for, dealt, in_order, key_counts, told

#: Bits of a set's parity map, which the suffix filter compares; longs of the folded map that a posting carries; hubs per prefix
#: n-gram and round; rounds at most; and the links of a round after which another one pays. After fewer links, but some, another one
#: pays while there are more than APART pairs a posting left.
BITS, FOLDS, HUBS, ROUNDS, FEW, APART = 512, 2, 2, 6, 1000, 4
ROW = "doc_id long, n long, set_key binary, keys array<long>, pos array<int>, shared array<long>, bits array<long>, central double"


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit keys of its word n-grams."""
    raw, offsets = column_bytes(column)
    out: list[np.ndarray] = []
    powers = [np.uint64(pow(BASE, j + 1, 1 << 64)) for j in range(width)]
    for a, b in steps(offsets):
        words, edges = word_keys(raw[offsets[i] : offsets[i + 1]].tobytes().translate(LOWER) for i in range(a, b))
        grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width):
            grams += words[j : j + len(grams)] * powers[j]
        grams = mix(grams)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = hi - lo
            if n >= width:
                out.append(distinct(grams[lo : hi - width + 1]))
            elif n:
                whole = (words[lo:hi] * np.array(powers[:n], np.uint64)).sum(keepdims=True, dtype=np.uint64)
                out.append(mix(whole + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(threshold: int, a: Column, b: Column) -> Column:
    """The fewest common n-grams that sets of a and b n-grams need."""
    return F.ceil(threshold * (a + b) / F.lit(100.0 + threshold) - 1e-9)


def set_rows(sets: list[np.ndarray], seen: np.ndarray, threshold: int) -> list[tuple]:
    """The columns of ROW after doc_id for each set of a group; ``seen``: how often each of the group's sorted distinct keys stands in all documents."""
    often_all = told(seen, np.concatenate([*sets, np.zeros(0, np.uint64)]))
    rows, end = [], 0
    for own in sets:
        n = len(own)
        often = often_all[end : end + n]
        end += n
        if not n:
            rows.append((0, None, None, None, None, None, None))
            continue
        key = np.array([own.sum(dtype=np.uint64), mix(own ^ np.uint64(BASE)).sum(dtype=np.uint64)]).tobytes()
        prefix = n - -(-threshold * n // 100) + 1
        single = int((often == 1).sum())
        if single >= prefix:
            rows.append((n, key, None, None, None, None, None))
            continue
        order = np.lexsort((own, often))
        parity = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
        central = float(np.log2(often[order[:prefix]]).mean())
        rows.append((n, key, own[order[single:prefix]].view(np.int64), np.arange(single, prefix, dtype=np.int32), own[often > 1].view(np.int64), np.packbits(parity.astype(np.uint8)).view(np.int64), central))
    return rows


def described(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Per document the size and key of its set and, if its prefix has n-grams of others, what the join needs."""
    groups, size, parts = dealt(inputs(docs))

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = shingle_sets(table.column("text").combine_chunks(), width)
        return np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)

    counts = key_counts(groups, keys_of, buckets_for(size // 6), parts)

    def describe(table: pa.Table, counted: pa.Table) -> pa.Table:
        table = in_order(table)
        rows = set_rows(shingle_sets(table.column("text").combine_chunks(), width), answers(counted), threshold)
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64()]
        names = ["n", "set_key", "keys", "pos", "shared", "bits", "central"]
        release()
        return pa.table({"doc_id": table.column("doc_id")} | {n: pa.array(list(c), k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return groups.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(describe, ROW)


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for each vertex of the edges (a, b), the least vertex that it reaches.

    Labels spread along the edges and jump along the labels until none changes; each round is
    written to the shared folder, so that a lost executor costs no earlier round.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    labels = materialize(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        spread = labels.join(near, "v").join(jump, "label", "left").select("v", F.least("label", "near", "far").alias("label"), F.col("label").alias("was"))
        new = materialize(spread, "labels")
        done = not new.where("label <> was").limit(1).count()
        discard(labels)
        labels = new.select("v", "label")
        if done:
            return labels


def apart_by(left: Column, right: Column, longs: int) -> Column:
    """Bits that differ between two parity maps: each n-gram in one set alone turns one bit, so they bound those n-grams from below."""
    return sum((F.bit_count(left[k].bitwiseXOR(right[k])) for k in range(longs)), F.lit(0))


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity reaches the threshold, each compared once on its whole sets.

    Whole parity maps are compared first, so that few sets travel.
    """
    maps = [sets.select(F.col("sid").alias(v), F.col("n").alias(f"n_{v}"), F.col("bits").alias(f"bits_{v}")) for v in "ab"]
    both = F.col("n_a") + F.col("n_b")
    near = pairs.join(maps[0], "a").join(maps[1], "b").where(both - apart_by(F.col("bits_a"), F.col("bits_b"), BITS // 64) >= 2 * least_overlap(threshold, F.col("n_a"), F.col("n_b")))
    whole = [sets.select(F.col("sid").alias(v), F.col("shared").alias(f"shared_{v}")) for v in "ab"]
    common = F.size(F.array_intersect("shared_a", "shared_b"))
    return near.select("a", "b", "n_a", "n_b").join(whole[0], "a").join(whole[1], "b").where(100 * common >= threshold * (both - common)).select("a", "b")


def may_link(threshold: int, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Length, positional and suffix filters for two postings of one prefix n-gram, given their columns."""
    n, m = x("n"), y("n")
    need = least_overlap(threshold, n, m)
    length = (100 * F.least(n, m)) >= threshold * F.greatest(n, m)
    positional = 1 + F.least(n - x("pos") - 1, m - y("pos") - 1) >= need
    return length & positional & (n + m - apart_by(x("fold"), y("fold"), FOLDS) >= 2 * need) & (x("label") != y("label"))


def ordered_pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def candidates(known: DataFrame, threshold: int, seeds: range) -> DataFrame:
    """Pairs (a, b) of different components: for each set and seed the first one among the hubs of its n-grams that may link with it.

    Seed 0 ranks the sets from the most central one on, the others by chance.
    """
    rank = {s: F.xxhash64("sid", F.lit(s)).cast("double") if s else -F.col("central") for s in seeds}
    hubs = known.groupBy("key").agg(*[F.min(F.struct(rank[s].alias("h"), "sid", "n", "pos", "fold", "label")).alias(f"hub{s}") for s in seeds])
    met = known.join(hubs, "key")
    first = met.groupBy("sid").agg(*[F.min(F.when(may_link(threshold, F.col, F.col(f"hub{s}").__getitem__), F.struct(F.col(f"hub{s}.h").alias("h"), F.col(f"hub{s}.sid").alias("hub")))).alias(f"m{s}") for s in seeds])
    found = first.select("sid", F.explode(F.array(*[F.col(f"m{s}.hub") for s in seeds])).alias("hub")).where("hub IS NOT NULL")
    return found.select(*ordered_pair(F.col("sid"), F.col("hub"))).distinct()


def still_apart(known: DataFrame) -> DataFrame:
    """Postings of the n-grams that stand in several components."""
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return materialize(known.join(mixed, "key"), "postings")


def few_apart(known: DataFrame) -> bool:
    """Whether postings of one n-gram and different components make at most APART pairs a posting."""
    own = known.groupBy("key", "label").agg(F.count("*").cast("double").alias("c"))
    keys = own.groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("within"))
    pairs, n = keys.agg(F.sum((F.col("c") * F.col("c") - F.col("within")) / 2), F.sum("c")).first()
    return n is None or pairs <= APART * n


def postings(sets: DataFrame) -> DataFrame:
    own = ["sid", "n", "fold", "central", "label"]
    return sets.select(*own, F.explode(F.arrays_zip("keys", "pos")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.pos").alias("pos"), *own)


def labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.drop("label").join(labels.withColumnRenamed("v", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are what white space (0x20, 0x09-0x0D) separates after lower-casing A-Z. A text of fewer
    than ``width`` words is one n-gram; a null, empty or blank text has none and links with nothing. Rows
    link when 100 * common >= ``threshold`` * united n-grams; component_id is the least doc_id
    among the rows that links reach. Rows with equal sets, repeated rows too, are one class and are
    compared once. A row with a null doc_id is linked like others but can't name a component; without
    another id in it, component_id is null. An empty table gives no rows; a text of any length is taken whole. Column
    names beside doc_id and text don't matter.
    """
    described_rows = materialize(described(docs, width, threshold), "sets")
    one = described_rows.where("keys IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "keys", "pos", "shared", "bits", "central")])
    sets = materialize(one.withColumn("sid", F.monotonically_increasing_id()), "classes")
    rows = materialize(described_rows.select("doc_id", F.col("n").alias("n_shingles"), "set_key"), "sizes")
    discard(described_rows)
    fold = F.array(*[reduce(Column.bitwiseXOR, [F.col("bits")[k] for k in range(f, BITS // 64, FOLDS)]) for f in range(FOLDS)])
    heads = sets.select("sid", "n", "keys", "pos", fold.alias("fold"), "central", F.col("sid").alias("label"))
    known, edges, labels = postings(heads), None, None
    for r in range(ROUNDS):
        new = materialize(verified(candidates(known, threshold, range(r * HUBS, (r + 1) * HUBS)), sets, threshold), "links")
        edges = new if edges is None else edges.union(new)
        labels = components(edges)
        last, known = known, still_apart(labelled(known, labels) if r else postings(labelled(heads, labels)))
        if r:
            discard(last)
        found = new.limit(FEW).count()
        if not found or found < FEW and few_apart(known):
            break
    # Pairs that the hubs' links leave apart.
    # The first n-gram that two sets share lies still further in front in the smaller one: its prefix is shorter than the other's.
    smaller = known.where(F.col("pos") <= F.col("n") - F.ceil(2 * threshold * F.col("n") / F.lit(100.0 + threshold) - 1e-9))
    ordered = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.sid") < F.col("x.sid")))
    apart = known.alias("x").join(smaller.alias("y"), (F.col("x.key") == F.col("y.key")) & ordered & may_link(threshold, lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
    more = materialize(verified(apart.select(*ordered_pair(F.col("x.sid"), F.col("y.sid"))).distinct(), sets, threshold), "links")
    if more.limit(1).count():
        labels = components(edges.union(more))
    class_of = labelled(sets.select("sid", "set_key", "doc_id"), labels)
    named = class_of.join(class_of.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("set_key", "component_id")
    return rows.join(named, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
