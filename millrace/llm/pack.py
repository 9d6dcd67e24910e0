"""Harmonic packing of tokenised documents into fixed-length training sequences.

Lengths fall into reciprocal-capacity classes: class j holds pieces that fit j times, and no more,
into a sequence. Every worker fills the bins of each class with exactly j pieces, on its own,
without knowing of the other workers; nothing is shuffled.
"""

from __future__ import annotations

import itertools
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column_bytes, inputs, release, steps

#: Texts between spaces whose ids a worker remembers, and the longest of them; beyond that they become the older ones, which go at the
#: next time unless they were met again. An entry takes some 200 bytes, so both together stay under 80 MB.
CACHE_CHUNKS, CACHED_LENGTH = 60_000, 100
#: Bytes of text that are split into words at once, and words whose ids are put in place at once.
STEP_BYTES, STEP_WORDS = 8 << 20, 1 << 18
#: Marks that, after a letter or digit, are ids of their own whatever stands before them.
MARKS = ".,!?;:%&$*#)"
#: How the word-level vocabulary splits a text (a fixed value of that vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_CACHES: dict[str, list[dict[str, bytes]]] = {}


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, then from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def encode(path: str, words: list[str]) -> Iterator[tuple[str, bytes]]:
    """Ids of words; a plain lower-case word goes to the vocabulary's model directly, past steps that leave it as it is."""
    model, letters = tokenizer(path).model, byte_letters()
    others = []
    for w in words:
        if w.isalpha() and w == w.lower() and (w.isascii() or is_normalized("NFC", w)):
            spelt = w if w.isascii() else w.encode().decode("latin-1").translate(letters)
            yield w, array("I", [t.id for t in model.tokenize(spelt)]).tobytes()
        else:
            others.append(w)
    for i in range(0, len(others), 20_000):
        part = others[i : i + 20_000]
        for w, e in zip(part, tokenizer(path).encode_batch_fast(part, add_special_tokens=False), strict=True):
            yield w, array("I", e.ids).tobytes()


@lru_cache(4)
def by_word(path: str) -> bool:
    """Whether a vocabulary splits texts as ``word_ids`` does: case and white space dropped, letters apart from marks."""
    told = json.loads(tokenizer(path).to_str())
    names = [x.get("type") for x in (told["normalizer"] or {}).get("normalizers", [])]
    steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = steps[0] if steps else {}
    return (
        names == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == SPLIT and split.get("behavior") == "Removed" and bool(split.get("invert"))
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not any(c.isspace() for t in told["added_tokens"] for c in t["content"])
        and told["model"]["type"] == "BPE" and not told["post_processor"]
    )


def text_ids(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers; word by word where the vocabulary allows it, whole otherwise."""
    if by_word(path):
        return word_ids(path, texts)
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def word_ids(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as 32-bit numbers of the machine's order (little-endian here).

    The vocabulary's pre-tokenizer drops white space and never joins what stands on both its
    sides, nor a letter or digit with a mark after it, and case doesn't count: so the ids of a text are
    those of its words and marks in order, and each distinct word is encoded once.
    """
    found = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
    coded = found.flatten().dictionary_encode()
    at = coded.indices.to_numpy()
    known = chunk_ids(path, coded.dictionary.to_pylist(), (np.bincount(at) > 1).tolist())
    flat = np.frombuffer(b"".join(known), np.uint32)
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
    starts = np.cumsum(sizes) - sizes
    ids = [np.zeros(0, np.uint32)]
    for a in range(0, len(at), STEP_WORDS):
        own = at[a : a + STEP_WORDS]
        n = sizes[own]
        place = np.repeat(starts[own] - np.cumsum(n) + n, n)
        place += np.arange(len(place))
        ids.append(flat[place])
    ends = 4 * np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[at])])[found.offsets.to_numpy()]
    all_ids = np.concatenate(ids).tobytes()
    return [all_ids[a:b] for a, b in itertools.pairwise(ends.tolist())]


def chunk_ids(path: str, chunks: list[str], again: list[bool]) -> list[bytes]:
    """Ids of distinct texts between spaces; those that stand more than once in this one, ``again``, are remembered."""
    cache = _CACHES.setdefault(path, [{}, {}])
    if len(cache[0]) > CACHE_CHUNKS:
        cache[:] = [{}, cache[0]]
    recent, older = cache
    out = list(map(recent.get, chunks))
    new, cores, tails = [], [], []
    for i in [i for i, e in enumerate(out) if e is None]:
        c = chunks[i]
        out[i] = older.get(c)
        if out[i] is not None:
            recent[c] = out[i]
            continue
        core = c if c.isalnum() else c.rstrip(MARKS)
        if not core or not core[-1].isalnum():
            core = c
        new.append(i)
        cores.append(core.lower() if core.isascii() and "<" not in core else core)
        tails.append(c[len(core) :])
    words = dict(encode(path, list({*cores, *tails})))
    for i, core, tail in zip(new, cores, tails, strict=True):
        out[i] = words[core] + words[tail] if tail else words[core]
        if again[i] and len(chunks[i]) <= CACHED_LENGTH:
            recent[chunks[i]] = out[i]
    return out


@lru_cache(8)
def cuts(capacity: int, waste: int) -> list[list[int]]:
    """For each length below capacity, the pieces to cut it into.

    A length whose class leaves at most ``waste`` free in a full bin stays whole; from any other
    the largest capacity / j is cut, and the rest is treated likewise.
    """
    out: list[list[int]] = [[]]
    for r in range(1, capacity):
        if capacity % r <= waste:
            out.append([r])
        else:
            size = capacity // -(-capacity // r)
            out.append([size, *out[r - size]])
    return out


class Packer:
    """The open bins of one worker."""

    def __init__(self, capacity: int, waste: int, first: int) -> None:
        self.capacity, self.cuts, self.next = capacity, cuts(capacity, waste), first
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, ids, total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        full, rest = divmod(total, self.capacity)
        for size in [self.capacity] * full + self.cuts[rest]:
            piece = (doc, start, ids[4 * start : 4 * (start + size)], total)
            start += size
            j = self.capacity // size
            if j == 1:
                self.close([piece])
                continue
            pieces = self.open.setdefault(j, [])
            pieces.append(piece)
            if len(pieces) == j:
                self.close(self.open.pop(j))

    def finish(self) -> None:
        """Lay what the unfilled bins hold end to end in full sequences; the last is cut at powers of two, which need no padding."""
        rest = [p for j in sorted(self.open) for p in self.open[j]]
        left = sum(len(p[2]) // 4 for p in rest)
        bin_, room = [], self.capacity if left >= self.capacity else 1 << left.bit_length() - 1 if left else 0
        for doc, start, ids, total in rest:
            while ids:
                n = min(room, len(ids) // 4)
                bin_.append((doc, start, ids[: 4 * n], total))
                ids, start, room, left = ids[4 * n :], start + n, room - n, left - n
                if not room:
                    self.close(bin_)
                    bin_, room = [], self.capacity if left >= self.capacity else 1 << left.bit_length() - 1 if left else 0
        self.open = {}


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to STEP_BYTES; a larger one is left as it is."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > STEP_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int | None = 2, waste: int | None = None) -> DataFrame:
    """Pieces of documents with their place in sequences of ``capacity`` tokens.

    One row per piece: its ids (little-endian 32-bit), where it starts in its document, the
    document's tokens, and sequence and offset. Every id lies in one piece. A null text counts as
    empty and still has ``end_id``; without ``end_id`` an empty document has no piece. Repeated rows
    are packed each for itself; a null doc_id stays null. ``capacity`` is a power of two.
    Full bins waste ``waste`` tokens at most (a hundredth of the capacity unless given); a sequence
    that is not full has a power of two of tokens. The numbers of sequences follow the partitions
    of ``docs``, so read them from a table, not from an unordered shuffle.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    waste = capacity // 100 if waste is None else waste
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, waste, TaskContext.get().partitionId() << 36)

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(NAMES, cols, strict=True)], names=NAMES)

        for table in gathered(batches):
            docs, column = table.column("doc_id").to_pylist(), table.column("text").combine_chunks()
            for a, b in steps(column_bytes(column)[1], STEP_BYTES):
                texts = [t or "" for t in column[a:b].to_pylist()]
                for doc, ids in zip(docs[a:b], text_ids(vocabulary, texts), strict=True):
                    packer.add(doc, ids + end)
                yield out()
        packer.finish()
        yield out()
        _CACHES.clear()  # a worker outlives its task
        release()

    return inputs(docs).mapInArrow(run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
