"""The trained operators: held-out accuracy, gradients, and small pages and conversations."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import extract, toxicity
from millrace.llm.common import column_bytes
from millrace.llm.labelled_pages import labelled_page


def test_page_generator_agrees_with_blocks():
    for seed in range(120):
        html, labels = labelled_page(seed)
        assert len(extract.blocks(html)) == len(labels)


def test_crf_on_unseen_pages():
    field = extract.trained()
    right = total = 0
    for seed in range(50_000, 50_150):
        html, labels = labelled_page(seed)
        got = field.decode(extract.features(extract.blocks(html)))
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right >= 0.98 * total


def test_viterbi_is_the_best_sequence():
    import itertools

    field = extract.Field()
    rnd = np.random.default_rng(3)
    field.weights = rnd.normal(0, 1, len(field.weights))
    field.moves = rnd.normal(0, 1, (2, 2))
    rows = [rnd.integers(0, len(field.weights), 3).tolist() for _ in range(7)]
    score = lambda y: sum(field.weights[r].sum() * k for r, k in zip(rows, y, strict=True)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))
    assert tuple(field.decode(rows)) == max(itertools.product((0, 1), repeat=7), key=score)
    assert field.decode([]) == []


def test_blocks():
    html = "<head><title>t</title></head><body><p>One &amp; <b>two</b>\n three<br>four<p>five<script>if (a<b) '</p>'</script><!-- <p>no</p> --><div>a<span>b</span> &eacute;&#x41; <i>c</i></div><p>5 < 6 &am"
    assert [b[0] for b in extract.blocks(html)] == ["One & two three", "four", "five", "ab éA c", "5 < 6 &am"]


def test_extract(spark):
    page = (
        "<html><head><title>x</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>The heading.</h1>"
        "<p>First  paragraph of the\n article, with some words.</p><p>Second paragraph &amp; more of it.</p></article><div class='comments'><p>I liked it, thanks.</p></div><footer>&copy; example</footer></body></html>"
    )
    rows = [(1, "u", page, 3), (2, None, None, 1), (3, "u", "", 1), (None, "u", "<p>", 1), (1, "u", page, 3)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    want = "The heading.\nFirst paragraph of the article, with some words.\nSecond paragraph & more of it."
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, want, len(want)), (2, "", 0), (3, "", 0), (None, "", 0), (1, want, len(want))]
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_agrees_with_article_elements():
    """The test tables' pages keep their main text in article elements; the field must find the same blocks."""
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    field = extract.trained()
    right = total = 0
    for html in pq.read_table(path).column("html").to_pylist():
        page = extract.blocks(html or "")
        labels = field.decode(extract.features(page))
        right += sum(("in:article" in b[1]) == bool(y) for b, y in zip(page, labels, strict=True))
        total += len(page)
    assert total > 1000 and right >= 0.99 * total


def test_extract_long_page(spark):
    long = "<html><body><nav><a href='/'>Home</a></nav><article>" + "<p>Some words of the article, again and again.</p>" * 20_000 + "</article></body></html>"
    got = extract.extract(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")).first()
    assert got.text.count("\n") == 19_999 and got.n_chars == len(got.text)


def toxic_texts(n, seed):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abdeilnorst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for _ in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 300))]
        y = rnd.random() < 0.3
        if y:
            for _ in range(rnd.randint(2, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(["vilest", "grubby", "oaf" + rnd.choice(vocab)])
        texts.append(" ".join(words))
        labels.append(int(y))
    return texts, labels


def test_gradients_match_differences():
    rnd = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh_parameters(rnd).items()}
    x = rnd.normal(0, 1, (6, toxicity.INPUTS))
    codes = rnd.integers(0, 6, (5, 4))
    mask = np.arange(5)[:, None] < np.array([5, 3, 1, 4])
    labels, weight = np.array([1.0, 0, 1, 0]), np.array([0.3, 0.2, 0.4, 0.1])

    def loss():
        states = np.concatenate([toxicity.run_gru(p[f"U{s}"], toxicity.gates(p, s, x), codes, mask, s == "b", False)[0].astype(np.float64) for s in "fb"], axis=2)
        z = toxicity.sigmoid(toxicity.attend(p, states, mask)[2])
        return -(weight * (labels * np.log(z) + (1 - labels) * np.log(1 - z))).sum()

    grad = toxicity.gradients(p, x, codes, mask, labels, weight)
    for name in ("Wf", "Ub", "cf", "att", "out", "bias"):
        at = tuple(rnd.integers(0, n) for n in p[name].shape)
        old, step = p[name][at], 1e-2
        p[name][at] = old + step
        up = loss()
        p[name][at] = old - step
        down = loss()
        p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_char_gradient_matches_differences():
    rnd = np.random.default_rng(4)
    m = toxicity.Model(p=toxicity.fresh_parameters(rnd))
    m.p["char"] = m.p["char"].astype(np.float64)
    w = toxicity.words_of(*column_bytes(pa.array(["the miller grinds the corn", "a"])))
    of = np.array([4, 0, 1, 2])
    d = rnd.normal(0, 1, (4, toxicity.FILTERS))
    value = lambda: np.stack([np.maximum(toxicity.filtered(m.p["char"], w, at[word == k]).max(axis=0), 0) for k in range(4)])
    word, at = toxicity.places(w, of)
    grad = m.char_gradient(w, of, value(), d)
    for _ in range(40):
        k = tuple(rnd.integers(0, n) for n in m.p["char"].shape[::2])
        place = (k[0], int(rnd.choice(w.data)), k[1])
        old = m.p["char"][place]
        m.p["char"][place] = old + 1e-6
        up = (value() * d).sum()
        m.p["char"][place] = old - 1e-6
        down = (value() * d).sum()
        m.p["char"][place] = old
        assert grad[place] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    assert w.codes.tolist() == [0, 1, 2, 0, 3, 4] and w.edges.tolist() == [0, 5, 6]
    assert np.abs(grad).sum() > 0 and np.allclose(m.chars(w, of), value(), atol=1e-5)


def plain_logit(m, text):
    """The network as loops over windows, words and states."""
    words = text.encode().translate(toxicity.SPELT).split()
    sig = lambda v: 1 / (1 + np.exp(-v))
    best = -np.inf
    for a in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        own = words[a : a + toxicity.WINDOW]
        inputs = []
        for word in own:
            w = toxicity.words_of(*column_bytes(pa.array([word.decode()])))
            spelt = b" " + word + b" "
            chars = [max(0.0, max(float(sum(m.p["char"][j][spelt[k + j]][f] for j in range(3))) for k in range(len(spelt) - 2))) for f in range(toxicity.FILTERS)]
            inputs.append(np.concatenate([m.scalars(w)[0], m.p["word"][toxicity.crc32(word) % toxicity.WORD_ROWS], chars]))
        h = toxicity.HIDDEN
        states = {}
        for side, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
            s, out = np.zeros(h), {}
            for t in order:
                g, u = inputs[t] @ m.p[f"W{side}"] + m.p[f"c{side}"], s @ m.p[f"U{side}"]
                z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                c = np.tanh(g[2 * h :] + r * u[2 * h :])
                s = z * s + (1 - z) * c
                out[t] = s
            states[side] = out
        rows = [np.concatenate([states["f"][t], states["b"][t]]) for t in range(len(own))] or [np.zeros(2 * h)]
        score = np.array([x @ m.p["att"] for x in rows])
        weight = np.exp(score - score.max())
        pooled = sum(k * x for k, x in zip(weight / weight.sum(), rows, strict=True))
        best = max(best, float(pooled @ m.p["out"] + m.p["bias"][0]))
    return best


def test_scores_equal_plain_loops():
    texts, labels = toxic_texts(120, 9)
    m = toxicity.fit(texts, labels, rounds=1)
    cases = ["", texts[0], texts[1], " ".join(texts[:3]), "VILEST, grubby-oaf é!"]
    got = toxicity.text_logits(m, toxicity.words_of(*column_bytes(pa.array(cases))))
    assert np.allclose(got, [plain_logit(m, t) for t in cases], atol=1e-3)


def test_long_labelled_texts_are_fitted_on(spark):
    from pyspark.sql import functions as F

    text = "".join(chr(97 + k % 26) for k in range(1000))
    got = spark.createDataFrame([(text,), ("short",)], "t string").select(toxicity.spread(F.col("t"), 100)).collect()
    parts = got[0][0].split("\n")
    assert got[1][0] == "short" and len(parts) == 10 and parts[0] == text[:10] and parts[-1] == text[-10:] and all(p in text for p in parts)


def test_windows_cover_whole_texts():
    edges = np.cumsum([0, 0, 1, 64, 65, 500])
    text, first, size = toxicity.windows(edges)
    for r in range(5):
        own = [(a - edges[r], n) for t, a, n in zip(text, first, size, strict=True) if t == r]
        assert {k for a, n in own for k in range(a, a + n)} == set(range(edges[r + 1] - edges[r])) and own[-1][1] + own[-1][0] == edges[r + 1] - edges[r]


def test_toxicity_held_out(spark):
    texts, labels = toxic_texts(700, 4)
    docs = spark.createDataFrame([(i, t, "score") for i, t in enumerate(texts)] + [(9000, None, ""), (9001, "", ""), (None, texts[0], ""), (3, texts[3], "")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)] + [(None, 1, 0), (5, None, 0), (123456, 1, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == 704 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    import zlib

    held = [r for r in got if r.doc_id is not None and r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in held} | {i for i in (9000, 9001) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.9
    by = {r.doc_id: r.score for r in got}
    assert by[9000] == by[9001] and by[None] == pytest.approx(by[0])
    one = toxicity.toxicity(docs, marks.where("toxic = 0")).collect()
    assert {r.score for r in one} == {0.0}
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0


def test_a_text_scores_alike_in_any_batch():
    texts, labels = toxic_texts(300, 6)
    m = toxicity.fit(texts, labels, rounds=1)
    whole = toxicity.text_logits(m, toxicity.words_of(*column_bytes(pa.array(texts[:20]))))
    alone = [toxicity.text_logits(m, toxicity.words_of(*column_bytes(pa.array([t]))))[0] for t in texts[:20]]
    assert np.allclose(whole, alone, atol=1e-4)
