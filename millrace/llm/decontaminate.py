"""Benchmark decontamination by Wu-Manber multi-pattern search.

Benchmark items become patterns: every window of ``width`` consecutive words, spelt as
" w1 w2 ... wn ". A document is normalised the same way and searched by block shift tables that
skip positions where no pattern can end; where the shift is 0, the bucket of the block's hash
names the patterns to compare byte by byte.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column_bytes, inputs, materialize, release, steps, with_rest

SPACE, STOP = 0x20, 0xFF
#: Bytes to their normal form: A-Z to lower case, word bytes kept, the others a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x80 <= b < 0xFF else SPACE for b in range(256))
#: Benchmark text that one set of tables is built from; a larger benchmark is searched in such blocks. A window costs some
#: 40 bytes beside its text, so the tables of a block take about ten times these bytes at most.
BLOCK_BYTES = 8 << 20
#: Words of an item that lie in one piece, apart from the words that it shares with the next one.
PIECE_WORDS = 1000


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class WuManber:
    """Tables for patterns of similar length, given as places in a common text, as numpy arrays."""

    def __init__(self, text: bytes, starts: np.ndarray, sizes: np.ndarray) -> None:
        self.text, raw = text, np.frombuffer(text, np.uint8)
        self.m = m = min(int(sizes.min()), 64)
        self.block = b = min(8, m)
        self.bits = int(np.clip(np.ceil(np.log2(len(starts) * m * 4)), 12, 24))
        self.shift = np.full(1 << self.bits, min(m - b + 1, 255), np.uint8)
        for end in range(b, m + 1):
            keys = self.key(self.eight(raw, starts + end - b, b))
            np.minimum.at(self.shift, keys, min(m - end, 255))
        order = np.argsort(keys, kind="stable")
        self.bucket_keys, self.order = keys[order].astype(np.int32), order.astype(np.int32)
        self.starts, self.sizes = starts[order].astype(np.int32), sizes[order].astype(np.int32)
        self.heads = self.eight(raw, self.starts.astype(np.int64), b)
        self.mask = np.uint64((1 << (8 * b)) - 1)

    @staticmethod
    def eight(raw: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` (8 at most) bytes at each place as a number."""
        out = np.zeros(len(at), np.uint64)
        for j in range(n):
            out |= raw[at + j].astype(np.uint64) << np.uint64(8 * j)
        return out

    def key(self, block: np.ndarray) -> np.ndarray:
        return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(positions, pattern numbers) of all occurrences; text must end in 8 bytes of padding.

        Many stretches of the text are searched at once, each with a place of its own.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(text) - 8 - self.m + 1
        if n <= 0:
            return none
        eight = np.ndarray((len(text) - 7,), "<u8", text.data, 0, (1,))
        step = max(64, -(-n // lanes))
        at = np.arange(0, n, step)
        end = np.minimum(at + step, n)
        found, last = [], self.m - self.block
        while len(at):
            keys = self.key(eight[at + last] & self.mask)
            jump = self.shift[keys].astype(np.int64)
            zero = jump == 0
            if zero.any():
                found.append((at[zero], keys[zero]))
                jump[zero] = 1
            at = at + jump
            alive = at < end
            if not alive.all():
                at, end = at[alive], end[alive]
        if not found:
            return none
        where, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        lo = np.searchsorted(self.bucket_keys, keys, "left")
        size = np.searchsorted(self.bucket_keys, keys, "right") - lo
        # Every place with every pattern of its bucket that begins alike; then their bytes.
        place = np.repeat(np.arange(len(where)), size)
        which = np.arange(len(place)) - np.repeat(np.cumsum(size) - size - lo, size)
        alike = self.heads[which] == (eight[where] & self.mask)[place]
        where, which = where[place[alike]], which[alike]
        whole, own = text.data, self.text
        same = [whole[w : w + n] == own[s : s + n] for w, s, n in zip(where.tolist(), self.starts[which].tolist(), self.sizes[which].tolist(), strict=True)]
        same = np.array(same, bool)
        return where[same], self.order[which[same]].astype(np.int64)


def pieces_of(items: DataFrame, width: int) -> DataFrame:
    """(item_id, piece): each item's normal words, " w1 w2 ... wn ", in pieces that hold every window once; no piece twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = normal_words(text.encode())
                parts = [words[a : a + PIECE_WORDS + width - 1] for a in range(0, max(1, len(words) - width + 1), PIECE_WORDS)] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([str(item)] * len(parts), pa.string()), pa.array([b" " + b" ".join(p) + b" " for p in parts], pa.binary())], names=["item_id", "piece"])

    return items.mapInArrow(run, "item_id string, piece binary").distinct()


def build(pieces: list[tuple[str, bytes]], width: int) -> list[tuple[WuManber, np.ndarray, np.ndarray, list[str]]]:
    """For each class of pattern lengths, so that a short item doesn't shorten all jumps: (searcher, words and item of each
    pattern, items). Patterns are windows of ``width`` words, or all words of a shorter piece."""
    text = b"".join(p for _, p in pieces) + bytes(8)
    names = sorted({i for i, _ in pieces})
    number = {n: k for k, n in enumerate(names)}
    starts, sizes, words, items = [], [], [], []
    at = 0
    for item, piece in pieces:
        space = np.flatnonzero(np.frombuffer(piece, np.uint8) == SPACE)  # one before each word, and the last
        n = min(width, len(space) - 1)
        starts.append(space[: len(space) - n] + at)
        sizes.append(space[n:] - space[: len(space) - n] + 1)
        words.append(np.full(len(starts[-1]), n, np.int32))
        items.append(np.full(len(starts[-1]), number[item], np.int32))
        at += len(piece)
    if not starts:
        return []
    start, size, word, item = (np.concatenate(x) for x in (starts, sizes, words, items))
    kind = np.minimum(np.ceil(np.log2(size + 1)).astype(int), 6)
    return [(WuManber(text, start[own], size[own]), word[own], item[own], names) for own in (kind == k for k in np.unique(kind))]


def search(texts: list[bytes], searchers: list) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text its number of words, the spans of words hit, and the items found."""
    raw = np.frombuffer((b" " + b"   ".join(texts) + b"   ").translate(NORMAL), np.uint8).copy()
    ends = np.cumsum(np.array([len(t) + 3 for t in texts])) - 1
    raw[ends] = STOP
    space = raw == SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[0] = True
    flat = np.concatenate([raw[keep], np.zeros(8, np.uint8)])
    stops = np.cumsum(keep)[ends] - 1
    first = np.zeros(len(flat), np.int64)  # 1 where a word starts
    first[1:-8] = (flat[:-9] == SPACE) & (flat[1:-8] != SPACE) & (flat[1:-8] != STOP)
    number = np.cumsum(first)
    upto = np.concatenate([[0], number[stops]])
    total = int(upto[-1])
    change = np.zeros(total + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for tables, words, owners, names in searchers:
        where, which = tables.find(flat)
        if len(where):
            a = number[where + 1] - 1
            np.add.at(change, a, 1)
            np.add.at(change, a + words[which], -1)
            for d, k in set(zip(np.searchsorted(stops, where).tolist(), owners[which].tolist(), strict=True)):
                items[d].add(names[k])
    hit = np.cumsum(change[:-1]) > 0
    for d in range(len(texts)):
        spans: list[tuple[int, int]] = []
        if d in items:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[upto[d] : upto[d + 1]], [False]]).astype(np.int8)))
            spans = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        yield int(upto[d + 1] - upto[d]), spans, sorted(items.get(d, ()))


RESULT = "doc_id long, n_words long, spans array<struct<start:long,length:long>>, item_ids array<string>"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("item_ids", pa.list_(pa.string()))])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: words, spans of words inside benchmark windows, and the items they come from.

    Words are ``[0-9a-z]`` and all characters from U+0080 on, after lower-casing A-Z. A document
    without text has no words; an empty table gives no rows, an empty benchmark no hits. Benchmark rows without id or words
    are ignored; rows that share an id are one item. Each row of ``docs`` gives one row, in any number of repeats; a
    null doc_id stays null. Texts of any length are searched whole. The benchmark's tables are broadcast only up to
    ``block_bytes`` of its words (long items are cut to pieces first); a larger one is split in blocks of that
    size, searched one by one, whose hits are joined. Column names beside doc_id and text don't matter.
    ``keep``: columns of ``docs`` to carry along, as a struct ``rest`` and, for the text, as ``text``.
    """
    spark = docs.sparkSession
    items = inputs(benchmark.select(F.col("item_id"), F.col("text")), "item_id").select(F.col("doc_id").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    pieces = materialize(pieces_of(items, width), "benchmark")
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    source = inputs(docs, keep=keep)
    schema = with_rest(RESULT, source, keep)
    if blocks > 1:
        blocks += blocks // 4  # hashing deals unevenly
        source = materialize(source.withColumn("row_key", F.monotonically_increasing_id()), "searched")
        schema = schema.add("row_key", "long")
    carried = tuple(schema.fieldNames()[4:])
    parts = []
    for k in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)) == k) if blocks > 1 else pieces
        tables = spark.sparkContext.broadcast(build(sorted((r.item_id, bytes(r.piece)) for r in own.toLocalIterator()), width))

        def run(batches: Iterator[pa.RecordBatch], tables=tables, names=carried) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = column_bytes(batch.column("text"))
                for a, b in steps(offsets):
                    rows = list(search([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)], tables.value))
                    part = batch.slice(a, b - a)
                    cols = [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([[{"start": s, "length": n} for s, n in r[1]] for r in rows], ARROW.field(2).type), pa.array([r[2] for r in rows], ARROW.field(3).type)]
                    yield pa.RecordBatch.from_arrays([*cols, *[part.column(n) for n in names]], names=[*ARROW.names, *names])
            release()

        parts.append(source.mapInArrow(run, schema))
    if blocks == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    merged = out.groupBy("row_key").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "n_words", *carried[:-1])],
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    return merged.withColumn("spans", union_spans("spans")).drop("row_key")


def union_spans(column: str):
    """Overlapping and touching spans made one, in order."""
    empty = F.expr("cast(array() as array<struct<start:long,length:long>>)")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["start"].alias("start"), (F.greatest(last["start"] + last["length"], x["start"] + x["length"]) - last["start"]).alias("length")))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["start"] + F.try_element_at(acc, F.lit(-1))["length"] >= x["start"]), joined).otherwise(F.array_append(acc, x))

    return F.aggregate(F.array_sort(column), empty, step)


def report(found: DataFrame) -> DataFrame:
    """The digest of ``contamination``: counts, the items' hash, and the verdict."""
    return found.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
