"""Removal of repeated byte strings by hash-compared suffix sorting.

Each ``width``-byte string has an anchor: the ``gram`` inside it with the least hash, the same
wherever the string stands. Anchors are counted over all documents; only strings whose anchor
occurs in more than one document go on, as fragments keyed by their anchor. A bucket of anchors
sorts the fragments' suffixes by mergesort whose comparisons find common extensions by binary
search on prefix hashes; neighbours that seem equal are compared byte by byte. Equal suffixes name
the least document, and the others' bytes are covered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import MIX_A, column_bytes, inputs, mix, prefix_hashes, release, span_hash, with_rest
from millrace.llm.keygroups import answers, bucket_of, buckets_for, dealt, in_order, key_counts, told

#: Bytes of an anchor. From FREQUENT on, of its count over all groups, an anchor's fragments are keyed by a longer
#: gram; from COMMON on each of its strings is keyed by itself, so that no bucket grows with a common anchor.
GRAM, FREQUENT, COMMON = 20, 1000, 20_000
#: Bytes that anchors are found in at once, and bytes of fragments that are sorted at once.
SEGMENT_BYTES, SORT_BYTES = 1 << 19, 1 << 19
NULL_ID = np.iinfo(np.int64).min
SEED = np.uint64(0x2545F4914F6CDD1D)


def segments(offsets: np.ndarray, width: int, limit: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, start, end) of about ``limit`` bytes that hold every string of ``width`` bytes once."""
    part, size = [], 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for s in range(0, b - a - width + 1, limit):
            e = min(b - a, s + limit + width - 1)
            part.append((row, s, e))
            size += e - s
            if size >= limit:
                yield part
                part, size = [], 0
    if part:
        yield part


def anchored(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each run of strings with one anchor: (row, start and end in the row, the anchor's place, the anchor's key)."""
    found = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
    for part in segments(offsets, width, SEGMENT_BYTES):
        own = np.concatenate([data[offsets[r] + s : offsets[r] + e] for r, s, e in part])
        ends = np.cumsum([e - s for _, s, e in part])
        starts = ends - [e - s for _, s, e in part]
        prefix = prefix_hashes(own)
        at = np.arange(len(own) - gram + 1)
        h = span_hash(prefix, at, at + gram)
        h ^= h >> np.uint64(29)
        h *= np.uint64(MIX_A)
        low = h >> np.uint64(24) << np.uint64(24)
        low |= at.astype(np.uint64)
        del prefix, at
        window, reach = width - gram + 1, 1
        while reach * 2 <= window:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if window > reach:
            low = np.minimum(low[: -(window - reach)], low[window - reach :])
        good = np.zeros(len(low) + 1, np.int32)
        np.add.at(good, starts, 1)
        np.add.at(good, ends - width + 1, -1)
        first = np.flatnonzero(np.cumsum(good[:-1]) > 0)
        anchor = (low[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        a, b = first[new], first[np.concatenate([new[1:] - 1, [len(first) - 1]])]
        seg = np.searchsorted(ends, a, side="right")
        rows = np.array([r for r, _, _ in part])[seg]
        shift = np.array([s for _, s, _ in part])[seg] - starts[seg]
        found.append((rows, a + shift, b + width + shift, anchor[new] + shift, mix(h[anchor[new]] ^ SEED)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def compare_equal(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of suffixes x and y, up to ``limit``, by binary search on prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), limit)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) >> 1
        same = span_hash(prefix, x, x + mid) == span_hash(prefix, y, y + mid)
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def suffix_sort(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, part: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes within each part, on their first ``limit`` bytes.

    The first eight bytes give runs; suffixes that agree there are merged bottom-up, all runs at
    once: each finds its rank in the sister run by binary search, and each comparison finds the
    common extension by hashes, then looks at one byte.
    """
    head = np.zeros(len(starts), np.uint64)
    for j in range(8):
        head = (head << np.uint64(8)) | data[starts + j].astype(np.uint64)
    order = np.lexsort((head, part))
    p, h = part[order], head[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (h[1:] != h[:-1])])
    lead = np.flatnonzero(new)
    size = np.diff(np.concatenate([lead, [len(order)]]))
    base, length = np.repeat(lead, size), np.repeat(size, size)
    width, active = 1, np.flatnonzero(length > 1)
    while len(active):
        inside = active - base[active]
        run = inside // width
        left = run % 2 == 0
        pair = base[active] + (run - run % 2) * width
        end = base[active] + length[active]
        lo = np.minimum(np.where(left, pair + width, pair), end)
        hi = np.minimum(np.where(left, pair + 2 * width, pair + width), end)
        first = lo.copy()
        mine = starts[order[active]]
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            other, own = starts[order[mid]], mine[open_]
            ext = compare_equal(prefix, own, other, limit)
            cut = np.minimum(ext, limit - 1)
            a, b = data[own + cut], data[other + cut]
            # A suffix of the left run precedes its equals in the right one.
            before = np.where(ext >= limit, ~left[open_], b < a)
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        place = pair + (inside - run * width) + (lo - first)
        merged = order.copy()
        merged[place] = order[active]
        order = merged
        width *= 2
        active = active[length[active] > width]
    return order


def pack_spans(spans: np.ndarray) -> list[tuple[int, bytes]]:
    """Covered bytes (group, row, start, end) by group: (g, rows, starts and ends as 64-bit numbers)."""
    order = np.argsort(spans[0], kind="stable")
    edges = np.flatnonzero(np.diff(spans[0][order])) + 1
    return [(int(spans[0][k[0]]), merge(spans[1:, k]).astype(np.int64).tobytes()) for k in np.split(order, edges) if len(k)]


def covered(fragments: list[bytes], keys: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, offset) of each string of ``width`` bytes that also stands in a fragment of a smaller document.

    ``keys``: fragments that can share strings have one key.
    """
    data = np.frombuffer(b"".join(fragments) + bytes(8), np.uint8)
    size = np.array([len(f) for f in fragments])
    at = np.cumsum(size) - size
    count = size - width + 1
    owner = np.repeat(np.arange(len(fragments)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts = at[owner] + offset
    prefix = prefix_hashes(data)
    order = suffix_sort(data, prefix, starts, keys[owner], width)
    s, o = starts[order], owner[order]
    same = (keys[o[1:]] == keys[o[:-1]]) & (span_hash(prefix, s[1:], s[1:] + width) == span_hash(prefix, s[:-1], s[:-1] + width))
    for k in np.array_split(np.flatnonzero(same), max(1, len(same) // 50_000)):  # the hashes agree: look at the bytes
        spread = np.arange(width)
        same[k] = (data[s[k + 1][:, None] + spread] == data[s[k][:, None] + spread]).all(axis=1)
    run = np.concatenate([[0], np.cumsum(~same)])
    least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run, docs[o])
    hit = docs[o] > least[run]
    return o[hit], offset[order][hit]


def halves(raw: bytes, start: int, end: int, anchor: int, width: int, gram: int) -> list[tuple[int, int, int]]:
    """(start, end, key) of the strings that reach ``side`` bytes before the anchor, and of the others, which reach
    as far behind it; each is keyed by the longer gram that all its strings hold."""
    side = (width - gram) // 2
    out = []
    # A string that starts at x holds text[anchor - side : anchor + gram] if x <= anchor - side.
    last = min(end - width, anchor - side)
    if last >= start:
        out.append((start, last + width, gram_key(raw[anchor - side : anchor + gram])))
    first = max(start, anchor - side + 1)
    if first <= end - width:
        out.append((first, end, gram_key(raw[anchor : anchor + gram + side])))
    return out


def gram_key(piece: bytes) -> int:
    return int.from_bytes(blake2b(piece, digest_size=8).digest(), "little")


def row_bytes(data: np.ndarray, offsets: np.ndarray, row: int) -> bytes:
    return data[offsets[row] : offsets[row + 1]].tobytes()


def distinct_anchors(table: pa.Table, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted anchors of a group, each with 1 or, if several documents have it, 2."""
    data, offsets = column_bytes(table.column("text").combine_chunks())
    rows, _, _, _, key = anchored(data, offsets, width, gram)
    doc = ids_of(table)[rows]
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[lead], 1 + (np.minimum.reduceat(doc, lead) != np.maximum.reduceat(doc, lead)) if len(key) else np.zeros(0, np.int64)


def packed(blob: bytes) -> bytes:
    return pa.compress(blob, "zstd", asbytes=True) + np.int64(len(blob)).tobytes() if blob else b""


def shared_fragments(table: pa.Table, seen: np.ndarray, buckets: int, width: int, gram: int) -> pa.Table:
    """(bucket, g, meta, bytes): a group's strings whose anchor occurs elsewhere, packed by bucket.

    A string that the group repeats is sent once, for its least document; the others are covered here (a row without meta).
    """
    g = table.column("g")[0].as_py()
    data, offsets = column_bytes(table.column("text").combine_chunks())
    ids = ids_of(table)
    rows, starts, ends, anchors, keys = anchored(data, offsets, width, gram)
    often = told(seen, keys)
    first: dict[bytes, int] = {}
    local, kept = [], []
    row, raw = -1, b""
    for k in np.flatnonzero(often > 1).tolist():
        if rows[k] != row:
            row = int(rows[k])
            raw, doc = row_bytes(data, offsets, row), int(ids[row])
        s, e = int(starts[k]), int(ends[k])
        if often[k] < FREQUENT:
            parts = [(s, e, int(keys[k]))]
        elif often[k] < COMMON:
            parts = halves(raw, s, e, int(anchors[k]), width, gram)
        else:
            parts = [(x, x + width, gram_key(raw[x : x + width])) for x in range(s, e - width + 1)]
        for x, y, to in parts:
            text = raw[x:y]
            if doc > first.setdefault(text, doc):
                local.append((row, x, y))
            else:
                kept.append((to, text, doc, row, x))
    del first
    out = []
    if local:
        out.append((g % buckets, b"", packed(merge(np.array(local, np.int64).T).tobytes())))
    if kept:
        to = np.array([x[0] for x in kept], np.uint64)
        bucket = bucket_of(to, buckets)
        order = np.argsort(bucket, kind="stable")
        meta = np.array([(len(x[1]), *x[2:]) for x in kept], np.int64)
        meta = np.concatenate([to.astype(np.uint32).astype(np.int64)[:, None], meta], axis=1)
        for k in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            out.append((int(bucket[k[0]]), packed(meta[k].T.tobytes()), packed(b"".join(kept[i][1] for i in k.tolist()))))
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "g": pa.array([g] * len(out), pa.int64()), "meta": pa.array([x[1] for x in out], pa.binary()), "bytes": pa.array([x[2] for x in out], pa.binary())})


def spans_of(texts: list[bytes], keys: list[int], docs: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
    """(g, row, start, end) of the bytes that smaller documents cover; ``where`` has each fragment's group, row and start."""
    first: dict[tuple[int, bytes], int] = {}
    number = np.array([first.setdefault(x, len(first)) for x in zip(keys, texts, strict=True)])
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, number, docs)
    size = np.array([len(t) for t in texts])
    later = docs > least[number]
    out = [np.stack([*where[:, later], where[2, later] + size[later]])]
    # Equal fragments stand for one another; where a key has several, their strings are sorted.
    part = np.array([k for k, _ in first])
    _, part, count = np.unique(part, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[part] > 1)
    if len(several):
        distinct = [t for _, t in first]
        f, offset = covered([distinct[i] for i in several.tolist()], part[several], least[several], width)
        holders = np.flatnonzero(~later & np.isin(number, several))
        holders = holders[np.argsort(number[holders], kind="stable")]
        lo = np.searchsorted(number[holders], several[f])
        n = np.searchsorted(number[holders], several[f], side="right") - lo
        at = holders[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        start = where[2, at] + np.repeat(offset, n)
        out.append(np.stack([where[0, at], where[1, at], start, start + width]))
    return np.concatenate(out, axis=1)


def resolved(table: pa.Table, width: int) -> pa.Table:
    """(g, spans) of a bucket, some keys at a time, so that memory follows the packed bucket and SORT_BYTES."""
    out: list[tuple[int, bytes]] = []
    groups, metas, raws = [], [], []
    for g, meta, raw in zip(table.column("g").to_pylist(), table.column("meta").to_pylist(), table.column("bytes").to_pylist(), strict=True):
        if not meta:
            out.append((g, unpacked(raw)))
            continue
        metas.append(np.frombuffer(unpacked(meta), np.int64).reshape(5, -1))
        groups.append(np.full(metas[-1].shape[1], g))
        raws.append(unpacked(raw))
    if metas:
        raw = b"".join(raws)
        del raws
        key, size, doc, row, start = np.concatenate(metas, axis=1)
        g = np.concatenate(groups)
        at = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        lead = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0, [True]]))
        upto = np.concatenate([[0], np.cumsum(size[order])])[lead]
        i = 0
        while i < len(lead) - 1:  # whole keys, of SORT_BYTES together or one
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + SORT_BYTES, side="right")) - 1)
            k = order[lead[i] : lead[j]]
            texts = [raw[a:b] for a, b in zip(at[k].tolist(), (at[k] + size[k]).tolist(), strict=True)]
            spans = spans_of(texts, key[k].tolist(), doc[k], np.stack([g[k], row[k], start[k]]), width)
            if spans.shape[1]:
                out += pack_spans(spans)
            i = j
    return pa.table({"g": pa.array([x[0] for x in out], pa.int64()), "spans": pa.array([merge(np.frombuffer(x[1], np.int64).reshape(3, -1)).tobytes() for x in out], pa.binary())})


def repeated_spans(groups: DataFrame, size: int, parts: int, width: int, gram: int) -> DataFrame:
    """(g, spans): packed byte ranges of a group's rows that are covered by strings of smaller documents."""
    buckets = buckets_for(size * 2 // (width - gram + 2))
    counts = key_counts(groups, lambda table: distinct_anchors(table, width, gram), buckets, parts)

    def fragments(table: pa.Table, counted: pa.Table) -> pa.Table:
        out = shared_fragments(in_order(table), answers(counted), buckets, width, gram)
        release()
        return out

    def resolve(table: pa.Table) -> pa.Table:
        out = resolved(table, width)
        release()
        return out

    sent = groups.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(fragments, "bucket long, g long, meta binary, bytes binary")
    found = sent.repartition(min(buckets, parts), "bucket").groupBy("bucket").applyInArrow(resolve, "g long, spans binary")
    return found.repartition(parts, "g")


def unpacked(blob: bytes) -> bytes:
    return b"" if not blob else pa.decompress(blob[:-8], int(np.frombuffer(blob[-8:], np.int64)[0]), "zstd", asbytes=True)


def merge(spans: np.ndarray) -> np.ndarray:
    """(rows, starts, ends) with overlapping and touching ranges of a row made one."""
    rows, starts, ends = spans[:, np.lexsort((spans[1], spans[0]))]
    if not len(rows):
        return spans
    room = np.int64(ends.max() + 2)
    reach = np.maximum.accumulate(ends + rows * room)
    new = np.concatenate([[True], (starts + rows * room)[1:] > reach[:-1]])
    lead = np.flatnonzero(new)
    last = np.concatenate([lead[1:] - 1, [len(rows) - 1]])
    return np.stack([rows[lead], starts[lead], reach[last] - rows[lead] * room])


def without_repeats(docs: DataFrame, width: int = 50, gram: int = GRAM, as_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``docs``.

    Texts are UTF-8 bytes; a null text is empty. ``spans`` lists the maximal runs removed: bytes
    covered by a string of ``width`` bytes that also starts in a document with a smaller doc_id,
    judged on the whole input; ``kept`` is the rest. Rows that share a doc_id don't remove
    from each other; a null doc_id counts as smaller than all others. Texts shorter than
    ``width`` lose nothing; a longer text of any length is searched whole. An empty table gives no rows. Column names beside
    doc_id and text don't matter. ``as_text``:
    ``kept`` is text, without the bytes of characters that a cut splits. ``keep``: columns of ``docs``
    to carry along, as a struct ``rest``.
    """
    groups, size, parts = dealt(inputs(docs, keep=keep))
    schema = with_rest(f"doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept {'string' if as_text else 'binary'}", groups, keep)
    spans = repeated_spans(groups, size, parts, width, gram)

    def apply(table: pa.Table, found: pa.Table) -> pa.Table:
        table = in_order(table)
        data, offsets = column_bytes(table.column("text").combine_chunks())
        parts = [np.frombuffer(x, np.int64).reshape(3, -1) for x in found.column("spans").to_pylist()]
        rows, starts, ends = merge(np.concatenate([np.zeros((3, 0), np.int64), *parts], axis=1))
        edges = np.searchsorted(rows, np.arange(table.num_rows + 1))
        kept, removed = [], []
        for r in range(table.num_rows):
            text = data[offsets[r] : offsets[r + 1]].tobytes()
            own = list(zip(starts[edges[r] : edges[r + 1]].tolist(), ends[edges[r] : edges[r + 1]].tolist(), strict=True))
            cuts = [0, *[x for pair in own for x in pair], len(text)]
            left = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
            removed.append([{"start": a, "length": b - a} for a, b in own])
        release()
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        cols = {"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "spans": pa.array(removed, spans_type), "kept": pa.array(kept, pa.string() if as_text else pa.binary())}
        return pa.table(cols | {c: table.column(c) for c in schema.fieldNames()[4:]})

    return groups.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(apply, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
