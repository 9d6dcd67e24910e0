"""Quality rules: base rules per document, then cross-document line frequency per host.

Lines are normalised, hashed, and counted by the distinct documents of a host that hold them;
lines above the limits are removed, and a document that loses too much is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BASE, LOWER, column_bytes, inputs, materialize, mix, pieces, release, steps, word_keys

SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
WHITE_BYTE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
#: Rows of flagged lines up to which they are broadcast to the documents' lines.
BROADCAST_ROWS = 200_000
ROW = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_keys array<long>, line_words array<int>, own_keys array<long>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def line_key(line: bytes) -> tuple[int, int]:
    """(key, words) of a line: a cryptographic hash of its lower-cased words, one space apart."""
    digest, n = blake2b(digest_size=8), 0
    for piece in pieces(line):
        words = piece.translate(LOWER).split()
        if words:
            digest.update(b" ".join(words) if not n else b" " + b" ".join(words))
            n += len(words)
    return int.from_bytes(digest.digest(), "little", signed=True), n


def lines_of(text: bytes) -> tuple[list[int], list[int], int]:
    """(keys, numbers of words) of the lines with a word, and how many of these equal an earlier one."""
    keys, words, seen = [], [], set()
    for line in text.split(b"\n"):
        key, n = line_key(line)
        if n:
            keys.append(key)
            words.append(n)
            seen.add(line)
    return keys, words, len(keys) - len(seen)


def measure(data: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray | list]:
    """Counts and lines of texts that lie end to end."""
    rows = len(offsets) - 1
    texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    words, word_edges = word_keys(texts)
    row_of_word = np.repeat(np.arange(rows), np.diff(word_edges))
    out: dict = {"n_words": np.diff(word_edges), "word_chars": sums(((data & 0xC0) != 0x80) & ~WHITE_BYTE[data], offsets), "n_symbols": sums(SYMBOL[data], offsets)}
    # Words inside windows that stand twice or more in the text.
    grams = np.zeros(max(0, len(words) - window + 1), np.uint64)
    for j in range(window):
        grams += words[j : j + len(grams)] * np.uint64(pow(BASE, j + 1, 1 << 64))
    inside = row_of_word[: len(grams)] == row_of_word[window - 1 :] if len(grams) else np.zeros(0, bool)
    place = np.flatnonzero(inside)
    keys = mix(grams[place] + mix(row_of_word[place].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, place[twice], 1)
    np.add.at(change, place[twice] + window, -1)
    out["n_repeat_words"] = sums(np.cumsum(change[:-1]) > 0, word_edges)
    found = [lines_of(t) for t in texts]
    out["n_dup_lines"] = np.array([d for _, _, d in found])
    out["line_keys"], out["line_words"] = [k for k, _, _ in found], [w for _, w, _ in found]
    out["own_keys"] = [sorted(set(k)) for k, _, _ in found]
    return out


def measured(docs: DataFrame, host_col: str, window: int) -> DataFrame:
    source = inputs(docs, extra=(host_col,))
    source = source.select("doc_id", "text", F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in steps(offsets):
                found = measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window)
                part = batch.slice(a, b - a)
                cols = {"doc_id": part.column("doc_id"), "host": part.column("host")}
                cols |= {c: pa.array(found[c].astype(np.int64)) for c in COUNTS}
                cols |= {c: pa.array(found[c], pa.list_(kind)) for c, kind in (("line_keys", pa.int64()), ("line_words", pa.int32()), ("own_keys", pa.int64()))}
                yield pa.RecordBatch.from_pydict(cols)
        release()

    return source.mapInArrow(run, ROW)


def line_rules(
    docs: DataFrame, host_col: str = "source", min_words: int = 20, most_repeated: int = 30, window: int = 8, min_docs: int = 20, root: float = 2.0, min_left: float = 0.5
) -> DataFrame:
    """Per row of ``docs`` the base counts, base_failed, the lines to remove, and kept.

    Words are what white space separates. base_failed: fewer than ``min_words`` words, or more than
    ``most_repeated`` per cent of them in ``window``-word windows found twice. A line (its lower-cased words) is
    removed where more than ``min_docs`` documents of its host, and more than ``root`` times the square root of their
    number, hold it (so the limit grows with a host, but slower than boilerplate does); each row is a document, copies of a text too. kept: not base_failed, and after the removal
    ``min_words`` words and ``min_left`` of the words are left. ``removed``: numbers, from 0, of those among the
    lines that hold a word. A null text has no words; a null host is a host of its own (""); each
    repeated row gives a row; an empty table gives none. A text of any length is measured whole. Column names
    beside doc_id, text and the host don't matter.
    """
    rows = materialize(measured(docs, host_col, window).withColumn("row", F.monotonically_increasing_id()), "lines")
    holders = rows.select("host", F.explode("own_keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("holders")).where(F.col("holders") > min_docs)
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    flagged = materialize(holders.join(hosts, "host").where(F.col("holders") > root * F.sqrt("docs")).select("host", "key"), "flagged")
    few = flagged.count() <= BROADCAST_ROWS
    lines = rows.select("row", "host", F.posexplode(F.arrays_zip("line_keys", "line_words")).alias("at", "line")).select("row", "host", "at", F.col("line.line_keys").alias("key"), F.col("line.line_words").alias("words"))
    lost = lines.join(F.broadcast(flagged) if few else flagged, ["host", "key"]).groupBy("row").agg(F.sum("words").alias("lost"), F.array_sort(F.collect_list("at")).alias("removed"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return rows.join(lost, "row", "left").select(
        "doc_id", *COUNTS, failed.alias("base_failed"), F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"),
        (~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the removed lines; lines without a word stay."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    tagged = F.aggregate(
        lines, F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<string>)").alias("kept")),
        lambda s, x: F.when(~x.rlike(r"[^\x20\x09-\x0D]"), F.struct(s["n"].alias("n"), F.array_append(s["kept"], x).alias("kept")))
        .otherwise(F.struct((s["n"] + 1).alias("n"), F.when(F.array_contains(removed, s["n"]), s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"))),
        lambda s: s["kept"],
    )
    return F.array_join(tagged, "\n")
