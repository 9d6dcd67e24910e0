"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a learned embedding, as its character sequence (learned filters over each three characters in a row, each
filter's highest value), and as evidence: how much more often it, and its character n-grams, stand in toxic training texts than
chance allows. The network reads overlapping windows; the highest window decides a document, through a calibration fitted
on texts the network was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BASE, column_bytes, inputs, mix, pieces, prefix_hashes, release, span_hash, steps, with_rest

#: Labelled rows to fit on, at most, of either label; of a text of more than FIT_CHARS characters FIT_SLICES pieces, spread over all
#: of it, which have that many together. (Scoring reads every text whole.)
FIT_TOXIC, FIT_CLEAN, FIT_CHARS, FIT_SLICES = 1500, 3000, 20_000, 10
#: Labelled texts below which no network is fitted.
LEAST_TEXTS = 8
WINDOW, STRIDE, HIDDEN, EMBED, FILTERS = 64, 32, 8, 6, 8
TABLE = 1 << 18
WORD_ROWS = 4096
GRAMS = (3, 4, 5)
SCALARS = 2 + len(GRAMS)
INPUTS = SCALARS + EMBED + FILTERS
#: Letters and digits to lower case (A-Z), all other ASCII to a space; bytes from 0x80 on are letters.
SPELT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


class Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Words:
    """Distinct words of some texts and the texts as numbers of words."""

    codes: np.ndarray
    edges: np.ndarray
    word_rows: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    number = Numbers()
    codes, edges = [np.zeros(0, np.int32)], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = edges[-1]
        for piece in pieces(data[a:b].tobytes().translate(SPELT)):
            words = piece.split()
            codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            n += len(words)
        edges.append(n)
    # The distinct words end to end, each between two spaces, so that n-grams know where words begin and end.
    stop = np.cumsum(np.fromiter((len(w) + 2 for w in number), np.int64, len(number)))
    spelt = np.frombuffer(b"".join(b" %b " % w for w in number), np.uint8)
    rows = np.fromiter((crc32(w) % WORD_ROWS for w in number), np.int32, len(number))
    return Words(np.concatenate(codes), np.array(edges), rows, spelt, np.concatenate([np.zeros(1, np.int64), stop[:-1]])[: len(stop)], stop)


def word_keys(w: Words) -> np.ndarray:
    """Rows of the evidence table for the words themselves."""
    p = prefix_hashes(w.data)
    return (mix(span_hash(p, w.starts, w.ends) ^ np.uint64(BASE)) % np.uint64(TABLE)).astype(np.int64)


def gram_keys(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, row of the evidence table) of all character n-grams, boundaries included."""
    p = prefix_hashes(w.data)
    count = np.maximum(w.ends - w.starts - n + 1, 0)
    word = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + w.starts[word]
    return word, (mix(span_hash(p, at, at + n) + np.uint64(n)) % np.uint64(TABLE)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def parts_of(w: Words, words: int = 20_000) -> Iterator[Words]:
    """The distinct words in parts, so that what is computed for each of their characters stays small."""
    for a in range(0, len(w.starts), words):
        b = min(a + words, len(w.starts))
        first = w.starts[a]
        yield Words(w.codes, w.edges, w.word_rows[a:b], w.data[first : w.ends[b - 1]], w.starts[a:b] - first, w.ends[a:b] - first)


@dataclass
class Model:
    evidence: np.ndarray = field(default_factory=lambda: np.zeros((2, TABLE), np.float32))
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    level: float = 0.0
    constant: float | None = None
    blank: float = 0.0

    def scalars(self, w: Words) -> np.ndarray:
        return np.concatenate([np.zeros((0, SCALARS), np.float32), *map(self.some_scalars, parts_of(w))])

    def some_scalars(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.starts), SCALARS), np.float32)
        out[:, 0] = self.evidence[0][word_keys(w)]
        total, number = np.zeros(len(w.starts), np.float32), np.zeros(len(w.starts), np.float32)
        for j, n in enumerate(GRAMS):
            word, row = gram_keys(w, n)
            value = self.evidence[1][row]
            if len(word):
                lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[word[lead], 1 + j] = np.maximum.reduceat(value, lead)
                total[word[lead]] += np.add.reduceat(value, lead)
                number[word[lead]] += np.diff(np.concatenate([lead, [len(word)]]))
        out[:, -1] = total / np.maximum(number, 1)
        return out

    def chars(self, w: Words, of: np.ndarray) -> np.ndarray:
        """The filters' highest values over the characters of each of the words ``of``."""
        word, at = places(w, of)
        high = np.zeros((len(of), FILTERS), np.float32)
        if len(word):
            lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            high[word[lead]] = np.maximum(np.maximum.reduceat(filtered(self.p["char"], w, at), lead), 0)
        return high

    def char_gradient(self, w: Words, of: np.ndarray, high: np.ndarray, d_high: np.ndarray) -> np.ndarray:
        """Of the filters: where a filter is highest in a word, its three characters get the word's gradient."""
        word, at = places(w, of)
        grad = np.zeros_like(self.p["char"])
        hit, f = np.nonzero((filtered(self.p["char"], w, at) == high[word]) & (high[word] > 0))
        for j in range(3):
            np.add.at(grad[j], (w.data[at[hit] + j], f), d_high[word[hit], f])
        return grad


def places(w: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``of``, place in the spelt words) of each three characters in a row, boundaries included."""
    size = (w.ends - w.starts)[of] - 2
    word = np.repeat(np.arange(len(of)), size)
    return word, np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + w.starts[of][word]


def filtered(tables: np.ndarray, w: Words, at: np.ndarray) -> np.ndarray:
    return tables[0][w.data[at]] + tables[1][w.data[at + 1]] + tables[2][w.data[at + 2]]


def fresh_parameters(rnd: np.random.Generator) -> dict[str, np.ndarray]:
    d = INPUTS
    p = {"word": rnd.normal(0, 0.05, (WORD_ROWS, EMBED)), "char": rnd.normal(0, 0.3, (3, 256, FILTERS)), "out": rnd.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1), "att": rnd.normal(0, 0.3, 2 * HIDDEN)}
    for side in "fb":
        p |= {f"W{side}": rnd.normal(0, d**-0.5, (d, 3 * HIDDEN)), f"U{side}": rnd.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"c{side}": np.zeros(3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def gates(p: dict[str, np.ndarray], side: str, x: np.ndarray) -> np.ndarray:
    return x @ p[f"W{side}"] + p[f"c{side}"]


def run_gru(u: np.ndarray, g: np.ndarray, codes: np.ndarray, mask: np.ndarray, backward: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, window, hidden) over windows of words; ``g`` has the gate inputs of each word."""
    steps_, n = codes.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((steps_, n, HIDDEN), np.float32)
    trace = []
    for t in range(steps_ - 1, -1, -1) if backward else range(steps_):
        x, y = g[codes[t]], h @ u
        zr = sigmoid(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * y[:, 2 * HIDDEN :])
        new = np.where(mask[t][:, None], c + z * (h - c), h)
        if keep:
            trace.append((t, h, z, r, c, y[:, 2 * HIDDEN :]))
        h = out[t] = new
    return out, trace


def attend(p: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    score = np.where(mask, states @ p["att"], -30.0)
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    return weight, pooled, pooled @ p["out"] + p["bias"][0]


def windows(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window: one each STRIDE words until the text's end is covered."""
    size = np.diff(edges)
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, edges[:-1][text] + k * STRIDE, np.minimum(WINDOW, size[text] - k * STRIDE)


def laid(codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, window) word numbers and which of them are real."""
    t = np.arange(max(1, int(size.max(initial=1))))[:, None]
    mask = t < size
    if not len(codes):
        return np.zeros(mask.shape, np.int32), mask
    return codes[np.where(mask, first + t, 0)], mask


def window_logits(m: Model, w: Words, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(text, logit) of all windows."""
    text, first, size = windows(w.edges)
    scal = m.scalars(w)
    g = {s: np.zeros((max(1, len(w.starts)), 3 * HIDDEN), np.float32) for s in "fb"}
    for a in range(0, len(w.starts), 20_000):
        of = np.arange(a, min(a + 20_000, len(w.starts)))
        x = np.concatenate([scal[of], m.p["word"][w.word_rows[of]], m.chars(w, of)], axis=1)
        for s in "fb":
            g[s][of] = gates(m.p, s, x)
    out = np.zeros(len(text), np.float32)
    for a in range(0, len(text), chunk):
        codes, mask = laid(w.codes, first[a : a + chunk], size[a : a + chunk])
        states = np.concatenate([run_gru(m.p[f"U{s}"], g[s], codes, mask, s == "b", False)[0] for s in "fb"], axis=2)
        out[a : a + chunk] = attend(m.p, states, mask)[2]
    return text, out


def text_logits(m: Model, w: Words) -> np.ndarray:
    """The highest window's logit of each text."""
    text, logit = window_logits(m, w)
    best = np.full(len(w.edges) - 1, -np.inf, np.float32)
    np.maximum.at(best, text, logit)
    return best


def text_scores(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The chance of each text to be toxic; a text without words, of which the network sees nothing, has that of such labelled texts."""
    w = words_of(data, offsets)
    return np.where(np.diff(w.edges) > 0, sigmoid(m.slope * text_logits(m, w).astype(np.float64) + m.level), m.blank)


def gram_rows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first gram of each word and the end, rows of the evidence table) as ``gram_keys`` has them."""
    lead = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.maximum(w.ends - w.starts - n + 1, 0))])
    rows = [gram_keys(part, n)[1].astype(np.int32) for part in parts_of(w)]
    return lead, np.concatenate([np.zeros(0, np.int32), *rows])


def gather_evidence(w: Words, rows: int, toxic: np.ndarray) -> np.ndarray:
    """How far each word and n-gram is over its expected number of toxic texts, in standard deviations (a fifth of them)."""
    out = np.zeros((2, TABLE), np.float32)
    share = toxic.mean()
    own = [np.unique(w.codes[w.edges[r] : w.edges[r + 1]]) for r in range(rows)]
    count = np.zeros((2, 2, TABLE), np.int32)
    keys = word_keys(w)
    for r in range(rows):
        np.add.at(count[0, int(toxic[r])], np.unique(keys[own[r]]), 1)
    for n in GRAMS:
        lead, row = gram_rows(w, n)
        for r in range(rows):
            size = lead[own[r] + 1] - lead[own[r]]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lead[own[r]], size)
            np.add.at(count[1, int(toxic[r])], np.unique(row[at]), 1)
    for j in (0, 1):
        expected = count[j].sum(axis=0) * share
        out[j] = np.clip((count[j, 1] - expected) / np.sqrt(expected + 1), -5, 15) / 5
    return out


def richest(m: Model, w: Words, toxic: np.ndarray, rnd: np.random.Generator) -> np.ndarray:
    """Of each text the window with the most evidence; of a clean one also another."""
    text, first, size = windows(w.edges)
    peak = m.scalars(w)[:, :-1].max(axis=1)[w.codes]
    rich = np.array([np.sort(peak[a : a + n])[-3:].sum() if n else 0.0 for a, n in zip(first, size, strict=True)])
    edges = np.searchsorted(text, np.arange(len(toxic) + 1))
    pick = [a + np.argmax(rich[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return np.array(pick + [rnd.integers(edges[r], edges[r + 1]) for r in np.flatnonzero(~toxic)])


def highest(m: Model, w: Words, texts: int) -> np.ndarray:
    """Of each text the window with the highest logit."""
    text, logit = window_logits(m, w)
    order = np.lexsort((-logit, text))
    return order[np.searchsorted(text[order], np.arange(texts))]


def train(m: Model, w: Words, toxic: np.ndarray, pick: np.ndarray, moment: dict, rnd: np.random.Generator, batch: int = 128, least_steps: int = 100, epochs: int = 3) -> None:
    """Adam over the picked windows, each under its text's label."""
    if not len(w.codes):
        return
    p = m.p
    text, first, size = windows(w.edges)
    scal = m.scalars(w)
    labels = toxic[text[pick]].astype(np.float32)
    weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3)).astype(np.float32)
    rounds = max(epochs, -(-least_steps * batch // len(pick)))
    for _ in range(rounds):
        order = rnd.permutation(len(pick))
        for a in range(0, len(order), batch):
            k = order[a : a + batch]
            codes, mask = laid(w.codes, first[pick[k]], size[pick[k]])
            of, codes = np.unique(codes, return_inverse=True)
            codes = codes.reshape(mask.shape)
            high = m.chars(w, of)
            x = np.concatenate([scal[of], p["word"][w.word_rows[of]], high], axis=1)
            grad = gradients(p, x, codes, mask, labels[k], weight[k] / len(k))
            dx = grad.pop("x")
            grad["word"] = np.zeros_like(p["word"])
            np.add.at(grad["word"], w.word_rows[of], dx[:, SCALARS : SCALARS + EMBED])
            grad["char"] = m.char_gradient(w, of, high, dx[:, SCALARS + EMBED :])
            moment["steps"] += 1
            for name, g in grad.items():
                m1, m2 = moment.setdefault(name, [np.zeros_like(p[name]), np.zeros_like(p[name])])
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p[name] -= (0.01 * (m1 / (1 - 0.9 ** moment["steps"])) / (np.sqrt(m2 / (1 - 0.999 ** moment["steps"])) + 1e-8)).astype(np.float32)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss by backpropagation through attention and time; "x": of the words' inputs."""
    runs = {s: run_gru(p[f"U{s}"], gates(p, s, x), codes, mask, s == "b", True) for s in "fb"}
    states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    att, pooled, logit = attend(p, states, mask)
    d = (sigmoid(logit) - labels) * weight
    grad = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * p["out"]
    d_att = (states * d_pooled).sum(axis=2)
    d_score = att * (d_att - (att * d_att).sum(axis=0)) * mask
    grad["att"] = (d_score[:, :, None] * states).sum(axis=(0, 1))
    d_states = att[:, :, None] * d_pooled + d_score[:, :, None] * p["att"]
    d_x = np.zeros_like(x)
    order = np.argsort(codes.ravel(), kind="stable")
    flat = codes.ravel()[order]
    lead = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    for i, s in enumerate("fb"):
        u = p[f"U{s}"]
        own, dh = d_states[:, :, i * HIDDEN : (i + 1) * HIDDEN], np.zeros((codes.shape[1], HIDDEN), np.float32)
        d_u, d_each = np.zeros_like(u), np.zeros((*codes.shape, 3 * HIDDEN), np.float32)
        for t, h, z, r, c, y in reversed(runs[s][1]):
            dh = dh + own[t]
            live = mask[t][:, None]
            new = dh * live
            dc = new * (1 - z) * (1 - c * c)
            pre = np.concatenate([new * (h - c) * z * (1 - z), dc * y * r * (1 - r), dc], axis=1)
            to_u = pre.copy()
            to_u[:, 2 * HIDDEN :] *= r
            d_u += h.T @ to_u
            d_each[t] = pre
            dh = dh * ~live + new * z + to_u @ u.T
        d_g = np.zeros((len(x), 3 * HIDDEN), np.float32)
        d_g[flat[lead]] = np.add.reduceat(d_each.reshape(-1, 3 * HIDDEN)[order], lead)
        grad |= {f"W{s}": x.T @ d_g, f"U{s}": d_u, f"c{s}": d_g.sum(axis=0)}
        d_x += d_g @ p[f"W{s}"].T
    return grad | {"x": d_x}


def fit(texts: list[str], toxic: list[int], rounds: int = 4, seed: int = 7, evidence: bool = True) -> Model:
    """A model of labelled texts: three quarters fit the network, the rest the calibration (all fit both if they are under a thousand).

    The network first learns from windows rich in evidence, then, round by round, from the windows that it
    scores highest, which corrects the clean ones among them. Without ``evidence`` it has words and characters only (for comparison).

    With fewer than LEAST_TEXTS texts, or one label only, nothing is learned: the model is a constant, the share of toxic texts.
    """
    y = np.array(toxic, bool)
    if len(y) < LEAST_TEXTS or y.all() or not y.any():
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    rnd = np.random.default_rng(seed)
    apart = (rnd.random(len(y)) < 0.25) & (len(y) >= 1000)
    if not (y[apart].any() and (~y[apart]).any() and y[~apart].any() and (~y[~apart]).any()):
        apart = np.zeros(len(y), bool)
    m = Model(p=fresh_parameters(rnd))
    w = words_of(*column_bytes(pa.array([t for t, k in zip(texts, apart, strict=True) if not k], pa.string())))
    m.evidence = gather_evidence(w, int((~apart).sum()), y[~apart])
    release()
    moment: dict = {"steps": 0}
    pick = richest(m, w, y[~apart], rnd)
    if not evidence:
        m.evidence = np.zeros_like(m.evidence)
    train(m, w, y[~apart], pick, moment, rnd)
    for _ in range(rounds - 1):
        pick = np.concatenate([pick, highest(m, w, int((~apart).sum()))])
        train(m, w, y[~apart], pick, moment, rnd, epochs=2)
    del w
    kept = apart if apart.any() else ~apart
    best = text_logits(m, words_of(*column_bytes(pa.array([t for t, k in zip(texts, kept, strict=True) if k], pa.string()))))
    own = y[kept].astype(np.float64)
    # Logistic fit of the label on the highest window, under the labels' natural shares.
    a, b = 1.0, 0.0
    for _ in range(2000):
        gap = sigmoid(a * best + b) - own
        a, b = a - 0.05 * (gap * best).mean() - 1e-4 * a, b - 0.05 * gap.mean()
    m.slope, m.level = max(float(a), 0.05), float(b)
    wordless = y[[not t.encode().translate(SPELT).split() for t in texts]]
    m.blank = float((wordless.sum() + y.mean()) / (len(wordless) + 1))
    return m


def spread(text: F.Column, most_chars: int) -> F.Column:
    """A text, or, if it has more characters, FIT_SLICES pieces at even distances from its first to its last character."""
    size, piece = F.char_length(text), most_chars // FIT_SLICES
    starts = F.transform(F.sequence(F.lit(0), F.lit(FIT_SLICES - 1)), lambda k: F.floor(k * (size - piece) / (FIT_SLICES - 1)).cast("int") + 1)
    return F.when(size <= most_chars, text).otherwise(F.array_join(F.transform(starts, lambda a: F.substring(text, a, F.lit(piece))), "\n"))


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = FIT_TOXIC, most_clean: int = FIT_CLEAN, most_chars: int = FIT_CHARS) -> list[tuple[str, int]]:
    """Labelled texts to fit on: a fixed draw of at most so many of either label, none of a held-out id, long ones in pieces."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    named = named.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id")
    parts = [named.where(F.col("toxic") == y).orderBy(draw, "doc_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    chosen = F.broadcast(parts[0].union(parts[1]))  # most_toxic + most_clean rows of two numbers at most
    texts = inputs(docs).where(F.col("text").isNotNull()).join(chosen, "doc_id")
    found = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("text", spread(F.col("text"), most_chars))
    return [(r.text, r.toxic) for r in sorted(found.collect(), key=lambda r: r.doc_id)]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, most_toxic: int = FIT_TOXIC, most_clean: int = FIT_CLEAN) -> Model:
    """The model of the labelled texts of ``docs``; a constant where they are too few or of one label."""
    found = sample(docs, labels, most_toxic, most_clean)
    model = fit([t for t, _ in found], [y for _, y in found])
    del found
    release()
    return model


def toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = FIT_TOXIC, most_clean: int = FIT_CLEAN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    The network is fitted on the driver on at most ``most_toxic`` and ``most_clean`` labelled texts (of one with more than FIT_CHARS
    characters, pieces from all over it), drawn by a hash of their ids, none of them held out (crc32 of the id modulo 5 is 0;
    a null id isn't). Every window of every whole text is scored. All texts without
    words, null and empty ones too, score alike: the share of toxic ones among labelled texts without words, drawn towards that among all. Repeated rows score alike; an empty table gives no rows; column names beside
    doc_id and text don't matter. ``keep``: columns of ``docs`` to carry along, as a struct ``rest`` and, for the text, as ``text``.

    With fewer than LEAST_TEXTS (8) such texts, or one label only, no network is fitted and every row scores the
    share of toxic ones, which says nothing about a text.
    """
    return scored(docs, fitted(docs, labels, most_toxic, most_clean), keep)


def scored(docs: DataFrame, fit_model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``toxicity`` by a model that is there already."""
    source = inputs(docs, keep=keep)
    schema = with_rest("doc_id long, score double", source, keep)
    model = docs.sparkSession.sparkContext.broadcast(fit_model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in steps(offsets, 1 << 20):
                if m.constant is not None:
                    score = np.full(b - a, m.constant)
                else:
                    score = text_scores(m, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(score, pa.float64())} | {c: part.column(c) for c in schema.fieldNames()[2:]})
        release()

    return source.mapInArrow(run, schema).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *schema.fieldNames()[2:])
