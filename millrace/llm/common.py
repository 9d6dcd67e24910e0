"""Helpers shared by the text operators: inputs, tables in the shared folder, byte batches, hashes."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import discard, materialize, shared_dir, ship

__all__ = ["discard", "materialize", "shared_dir", "ship"]

#: Bytes of text that one step of a task works on at once; a longer text is a step of its own.
STEP_BYTES = 2 << 20

#: Odd multiplier of the polynomial hashes, and the multipliers that mix 64 bits.
BASE = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB


def inputs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns an operator reads, so that others, whatever their names, can't clash.

    ``keep``: columns to carry along untouched, as one struct ``rest``; the text, which is there anyway, isn't put into it.
    """
    ship(df.sparkSession)
    others = [c for c in keep if c != text_col]
    rest = [F.struct(*others).alias("rest")] if others else []
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in extra], *rest)


def with_rest(ddl: str, source: DataFrame, keep: tuple[str, ...] = (), text_col: str = "text") -> T.StructType:
    """A schema with the carried struct of ``source``, if it has one, and the text, if it is to be kept, at its end."""
    schema = T.StructType.fromDDL(ddl)
    schema = schema.add(source.schema["rest"]) if "rest" in source.columns else schema
    return schema.add("text", "string") if text_col in keep else schema


def carried(docs: DataFrame) -> list[Column]:
    """All columns of ``docs`` from a result that kept them."""
    return [F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(MIX_A)
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX_B)
    h ^= h >> np.uint64(31)
    return h


def distinct(keys: np.ndarray) -> np.ndarray:
    """The sorted distinct keys. By sorting: ``np.unique`` without counts goes through a hash table, which takes tens of times as long."""
    keys = np.sort(keys)
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return keys[first]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, so that a task's memory doesn't follow its batch."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class Powers:
    """Powers of BASE and of its inverse modulo 2^64; a worker keeps KEPT of them, longer runs make their own."""

    KEPT = (1 << 20) + 8192

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(BASE, -1, 1 << 64)
        if n > self.KEPT:
            return powers(BASE, n), powers(inverse, n)
        if len(self.up) < n:
            size = min(self.KEPT, max(n, 2 * len(self.up), 1 << 16))
            self.up, self.down = powers(BASE, size), powers(inverse, size)
        return self.up[:n], self.down[:n]


POWERS = Powers()
#: A random 64-bit value for each byte, from a fixed seed.
BYTE_VALUES = np.random.default_rng(20240917).integers(1, 1 << 64, 256, dtype=np.uint64)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of data[:i]; ``span_hash`` compares any two spans by it.

    Modulo 2^64, so crafted spans of 1,024 bytes and more can collide: only for spans that are short, or
    whose bytes are compared afterwards. Words and lines take ``Keys``.
    """
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the span lies."""
    _, down = POWERS.get(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


class Keys(dict):
    """64-bit keys of byte strings, from a cryptographic hash; a string met again costs a look-up."""

    def __missing__(self, word: bytes) -> int:
        key = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return key


#: Distinct words that a worker remembers at once.
KNOWN_WORDS = 200_000
#: A-Z to lower case.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, limit: int = STEP_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``limit`` bytes, cut before white space, so that no word is split."""
    at = 0
    while len(text) - at > limit:
        found = WHITE.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def word_keys(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all words, edges) of texts; words are what white space (0x20, 0x09-0x0D) separates."""
    known = Keys()
    parts, edges = [np.zeros(0, np.uint64)], [0]
    for text in texts:
        n = edges[-1]
        for piece in pieces(text):
            words = piece.split()
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            n += len(words)
            if len(known) > KNOWN_WORDS:
                known.clear()
        edges.append(n)
    return np.concatenate(parts), np.array(edges)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: nothing to trim
    _TRIM = None


def release() -> None:
    """Give memory that a finished step has freed back to the machine: a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
