"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of text blocks, each with the tags and names above it. The field scores
each block as article or not from ancestor and text features and scores neighbouring labels together; it
is trained on labelled pages by gradient ascent on the conditional likelihood and decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.labelled_pages import labelled_page
from millrace.session import ship

#: Labelled pages the field is trained on, and the rounds of training.
TRAIN_PAGES, ROUNDS = 600, 150
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of a page's prose.
SILENT = frozenset("script style noscript template svg iframe object head title select option textarea button canvas audio video".split())
RAW = frozenset(("script", "style", "textarea", "title"))
RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
#: A new one of these ends an open one, up to the element that bounds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ANCESTORS = "nav header footer aside article main form section ul ol li table td div p h1 h2 h3 h4 blockquote pre figure figcaption label a dl body cite span".split()
#: Parts of class names and ids that tell what an element holds.
NAME_PARTS = "ad ads advert sponsor promo banner cookie notice gdpr consent alert popup modal sidebar related widget recommend most rail comment comments respon repl discuss share social follow tools breadcrumb crumb path newsletter signup search login subscri menu nav header masthead topbar top footer bottom legal copyright content post entry article story main body text copy".split()
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<(?=[^a-zA-Z/!?])|[^<]+|<", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPACE = re.compile(r"[\s\x00-\x1f]+")
BUCKETS = (2, 5, 10, 20, 40, 80)


@lru_cache(20_000)
def name_features(attributes: str) -> tuple[str, ...]:
    words = re.split(r"[^a-z0-9]+", " ".join("".join(m) for m in NAMES.findall(attributes)).lower())
    return tuple({f"name:{part}" for w in words if w for part in NAME_PARTS if w == part or (len(part) > 3 and w.startswith(part))})


def blocks(html: str) -> list[tuple[str, frozenset, int]]:
    """(text, features of the elements above, characters inside links) of every text block, in page order.

    Character references are decoded and white space made one space. Inline elements don't end
    a block; every other tag, and a line break, does. Unclosed and crossed tags are taken as browsers do in the main.
    """
    out: list[tuple[str, frozenset, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = silent = in_link = 0
    above: frozenset | None = None
    at = 0

    def flush() -> None:
        nonlocal text, linked, above
        joined = SPACE.sub(" ", unescape("".join(text))).strip()
        if joined:
            out.append((joined, above or frozenset(), linked))
        text, linked, above = [], 0, None

    def pop(k: int) -> None:
        nonlocal silent, in_link
        for tag, _ in stack[k:]:
            silent -= tag in SILENT
            in_link -= tag == "a"
        del stack[k:]

    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        slash, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if tag is None:
            raw = m.group(0)
            if raw.startswith(("<!", "<?")) and len(raw) > 1:
                continue
            if not silent:
                if above is None and not raw.isspace():
                    above = frozenset([f"in:{t}" for t, _ in stack] + [f for _, fs in stack for f in fs])
                text.append(raw)
                linked += len(raw) if in_link else 0
            continue
        tag = tag.lower()
        if slash:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag not in INLINE:
            flush()
            if stack and stack[-1][0] == "p" or any(t == "p" for t, _ in stack[-4:]):
                k = max(k for k, (t, _) in enumerate(stack) if t == "p")
                if all(t in INLINE for t, _ in stack[k + 1 :]):
                    pop(k)
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in bounds:
                    break
                if stack[k][0] in ends:
                    pop(k)
                    break
        if tag in VOID or attributes.endswith("/"):
            if tag == "br":
                flush()
            continue
        stack.append((tag, name_features(attributes) if attributes else ()))
        silent += tag in SILENT
        in_link += tag == "a"
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = end.start() if end else len(html)
    flush()
    return out


@lru_cache(1)
def feature_index() -> dict[str, int]:
    names = ["one", "first", "last", "dot", "mark", "upper", "copyright", "no letters", "half linked", "all linked", "some linked", "comma", "in any part"]
    names += [f"words<{b}" for b in BUCKETS] + [f"in:{t}" for t in ANCESTORS] + [f"name:{p}" for p in NAME_PARTS]
    return {n: i for i, n in enumerate(names)}


def features(page: list[tuple[str, frozenset, int]]) -> list[list[int]]:
    """Numbers of the features that hold for each block."""
    index, out = feature_index(), []
    for k, (text, above, linked) in enumerate(page):
        own = ["one", *above]
        words = text.count(" ") + 1
        own += [f"words<{b}" for b in BUCKETS if words < b]
        if text[-1] in ".!?":
            own.append("dot")
        if text[-1] in ":*%$#&|":
            own.append("mark")
        if text.isupper():
            own.append("upper")
        if "©" in text:
            own.append("copyright")
        if ", " in text:
            own.append("comma")
        if linked:
            own.append("some linked")
            if 2 * linked >= len(text):
                own.append("half linked")
            if linked + 2 >= len(text):
                own.append("all linked")
        if k == 0:
            own.append("first")
        if k == len(page) - 1:
            own.append("last")
        out.append([index[f] for f in own if f in index])
    return out


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of a two-label chain: by feature for the article label, and between neighbouring labels."""

    def __init__(self) -> None:
        self.weights = np.zeros(len(feature_index()))
        self.moves = np.zeros((2, 2))

    def train(self, pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, decay: float = 1e-3) -> None:
        """Adam on the conditional log likelihood of all pages at once, by forward and backward sums."""
        longest, n = max(len(y) for _, y in pages), len(pages)
        x = np.zeros((n, longest, len(self.weights)), np.float32)
        y, real = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for k, (rows, labels) in enumerate(pages):
            for t, (row, label) in enumerate(zip(rows, labels, strict=True)):
                x[k, t, row] = 1
                y[k, t], real[k, t] = label, True
        both = real[:, 1:] & real[:, :-1]
        seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
        m, v = np.zeros(len(self.weights) + 4), np.zeros(len(self.weights) + 4)
        for step in range(1, rounds + 1):
            emit = np.stack([np.zeros((n, longest)), x @ self.weights], axis=2) * real[:, :, None]
            forward = np.zeros((longest, n, 2))
            backward = np.zeros((longest, n, 2))
            forward[0] = emit[:, 0]
            for t in range(1, longest):
                moved = log_sum(forward[t - 1][:, :, None] + self.moves, 1) + emit[:, t]
                forward[t] = np.where(real[:, t, None], moved, forward[t - 1])
            for t in range(longest - 2, -1, -1):
                moved = log_sum(self.moves + (emit[:, t + 1] + backward[t + 1])[:, None, :], 2)
                backward[t] = np.where(real[:, t + 1, None], moved, backward[t + 1])
            total = log_sum(forward[-1], 1)
            share = np.exp((forward + backward)[:, :, 1] - total).T
            gap = (y - share) * real
            pairs = np.zeros((2, 2))
            for t in range(longest - 1):
                joint = forward[t][:, :, None] + self.moves + (emit[:, t + 1] + backward[t + 1])[:, None, :] - total[:, None, None]
                pairs += (np.exp(joint) * both[:, t, None, None]).sum(axis=0)
            grad = np.concatenate([np.tensordot(gap, x, ([0, 1], [0, 1])), (seen - pairs).ravel()]) / n
            grad -= decay * np.concatenate([self.weights, self.moves.ravel()])
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.weights += change[:-4]
            self.moves += change[-4:].reshape(2, 2)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not rows:
            return []
        w, ((m00, m01), (m10, m11)) = self.weights, self.moves.tolist()
        s0, s1, back = 0.0, float(w[rows[0]].sum()), []
        for row in rows[1:]:
            a, b = s0 + m00 >= s1 + m10, s0 + m01 >= s1 + m11
            back.append((0 if a else 1, 0 if b else 1))
            s0, s1 = (s0 + m00 if a else s1 + m10), (s0 + m01 if b else s1 + m11) + float(w[row].sum())
        labels = [0 if s0 >= s1 else 1]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


@lru_cache(2)
def trained(pages: int = TRAIN_PAGES) -> Field:
    """A field trained on so many labelled pages."""
    examples = []
    for seed in range(pages):
        html, labels = labelled_page(seed)
        rows = features(blocks(html))
        if len(rows) == len(labels):
            examples.append((rows, labels))
    field = Field()
    field.train(examples)
    return field


def main_text(html: str, field: Field) -> str:
    page = blocks(html)
    return "\n".join(b[0] for b, label in zip(page, field.decode(features(page)), strict=True) if label)


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    text: the blocks labelled article, joined by line feeds; empty for a null or empty page and where no block is
    article. n_chars: its code points. Repeated rows and null ids or urls pass through; an empty table gives no rows; a
    page of any length is read whole; other columns, whatever their names, don't matter.
    """
    ship(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(trained(train_pages))  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(h.as_py() or "", model.value) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
