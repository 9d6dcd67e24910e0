"""Small fixtures against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import decontaminate, fixity, jaccard, keygroups, line_rules, pack, shards, suffix_dedup
from millrace.llm.common import column_bytes, distinct
from millrace.llm.queries import vocabulary_path

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 160))) for _ in range(n)]
    rows = []
    for i, t in enumerate(base):
        rows.append((3 * i, t))
        if i % 4 == 0:
            words = t.split()
            for _ in range(rnd.randint(1, 4)):
                if words:
                    words[rnd.randrange(len(words))] = "Changed"
            rows.append((3 * i + 1, " ".join(words)))
        if i % 9 == 0:
            rows.append((3 * i + 2, t))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "one two"), (1005, "é" * 9000), (1006, base[1] + "\n" + base[2]), (1007, "a b c d e f g h " * 40)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have the names that the operators use inside."""
    return spark.createDataFrame([(i, t, "h%d" % (i % 3), "x", 7) for i, t in rows], "doc_id long, text string, source string, g string, n long").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_pack(spark, docs, rows):
    path = vocabulary_path()
    got = pack.pack(docs, path, capacity=256).collect()
    tok = pack.tokenizer(path)
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, t in rows:
        own = sorted(pieces[i], key=lambda r: r.start)
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert b"".join(r.ids for r in own) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert [r.start for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))] and {r.doc_tokens for r in own} == {len(ids)}
    padding = total = 0
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))]
        size = sum(r.length for r in own)
        assert size <= 256
        total += size
        padding += 0 if size & (size - 1) == 0 else 256 - size
    assert padding <= total / 80
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in pack.digest(pack.pack(docs, path)).collect()}
    assert all(digest[r.doc_id, r.start] == zlib.crc32(r.ids) for r in pack.pack(docs, path).collect())
    assert pack.pack(empty(spark), path).count() == 0


def thue_morse(n):
    """Two words of n bytes that every polynomial hash modulo 2^64 takes for one, if n is 1,024 or more."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_long_words_are_told_apart(spark, size):
    one, two = thue_morse(size)
    rest = " ".join(f"w{k}" for k in range(4))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    lines = [" ".join("ab"[b == "b"] for b in x) for x in (one, two)]
    got = line_rules.line_rules(spark.createDataFrame([(k, lines[k % 2], "h") for k in range(60)], "doc_id long, text string, source string"), min_docs=40, root=1.0).collect()
    assert all(r.removed == [] for r in got)
    from millrace.llm import toxicity
    from millrace.llm.common import column_bytes
    import pyarrow as pa

    assert toxicity.words_of(*column_bytes(pa.array([f"{one} {two}"]))).codes.tolist() == [0, 1]


def test_one_row_repeated_is_dealt_to_several_groups(spark):
    from millrace.llm import keygroups

    text = "word " * 20000
    source = spark.createDataFrame([(1, text)] * 300 + [(2, "x"), (None, None)], "doc_id long, text string")
    groups, size, parts = keygroups.dealt(source, 1 << 20)
    found = groups.groupBy("g").count().collect()
    assert len(found) > 20 and max(r["count"] for r in found) < 60 and size > 29_000_000 and parts > 1
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.digest(suffix_dedup.without_repeats(source.select("doc_id", "text"))).collect()}
    assert got == {(1, 0), (2, 0), (None, 0)}


def test_vocabularies_that_keep_white_space(spark):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" The mill,\n\twheel's  turn", "", "ÀB c"]
    assert not pack.by_word(path) and pack.by_word(vocabulary_path())
    for e, own in zip(pack.tokenizer(path).encode_batch(texts, add_special_tokens=False), pack.text_ids(path, texts), strict=True):
        assert b"".join(x.to_bytes(4, "little") for x in e.ids) == own


def test_word_ids_keep_frequent_words(monkeypatch):
    path, seen, plain = vocabulary_path(), Counter(), pack.encode
    monkeypatch.setattr(pack, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(pack, "CACHE_WORDS", 50, raising=False)
    monkeypatch.setattr(pack, "STEP_WORDS", 7, raising=False)
    monkeypatch.setattr(pack, "encode", lambda path, words: seen.update(words) or plain(path, words))
    pack._CACHES.clear()
    for i in range(40):
        texts = ["the common words of " * 2, "", "of " + " ".join(f"rare{'abcdefghij'[k]}{'xyzuvw'[i % 6] * (1 + i // 6)}," for k in range(10)), " \n the\ncommon  words "]
        for e, own in zip(pack.tokenizer(path).encode_batch(texts, add_special_tokens=False), pack.word_ids(path, texts), strict=True):
            assert memoryview(own).cast("I").tolist() == e.ids
    assert max(seen[w] for w in ("the", "common", "words", "of")) <= 3  # once for each way it is written
    pack._CACHES.clear()


def test_word_ids_equal_whole_texts():
    path = vocabulary_path()
    texts = ["", "  a  b ", "can't won't. O'neil's, x.y.z... 3.5% $9&& é.é́ ÀÉ. İstanbul. ΣΑΣ. <|endoftext|>. ½. ²) á. 日本.。", "\tq\rz x. y.\n\nfin"]
    for e, own in zip(pack.tokenizer(path).encode_batch(texts, add_special_tokens=False), pack.word_ids(path, texts), strict=True):
        assert b"".join(x.to_bytes(4, "little") for x in e.ids) == own


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(spark, docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_jaccard_large_group_of_borderline_copies(spark):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(120)] = f"x{i}{rnd.random()}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_links_of_a_large_group_stay_few(spark, monkeypatch):
    rnd, seen, plain = random.Random(6), [], jaccard.components
    monkeypatch.setattr(jaccard, "FEW", 50)
    monkeypatch.setattr(jaccard, "components", lambda edges: seen.append(edges.count()) or plain(edges))
    rows = []
    for i in range(120):
        words = [f"w{k}" for k in range(120)]
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(120)] = f"x{i}{rnd.random()}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert 0 < max(seen) <= 4 * len(rows)


@pytest.mark.parametrize("n", [100, 200])
def test_jaccard_copies_that_link_with_their_source_only(spark, monkeypatch, n):
    rnd, seen, plain = random.Random(7), [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    rows = []
    for i in range(2 * n):
        words = [f"w{k}" for k in range(120)]
        for at in rnd.sample(range(10, 110, 10), (i > 0) + (i % 3 == 2)):
            words[at] = f"x{i}{at}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert {c for _, c in got.values()} == {0}
    assert sum(seen) <= 4 * len(rows)


def seconds(f):
    """CPU seconds, the least of three times."""
    times = []
    for _ in range(3):
        began = time.process_time()
        f()
        times.append(time.process_time() - began)
    return min(times)


def test_jaccard_describes_sets_at_the_cost_of_some_sorts():
    sets = [np.sort(k) for k in np.random.default_rng(8).integers(0, 1 << 63, (8, 80_000), dtype=np.uint64)]
    sets[1][:50_000] = sets[0][:50_000]
    sets[1].sort()
    known, seen = np.unique(np.concatenate(sets), return_counts=True)
    seen = seen.astype(np.uint16)

    got = jaccard.set_rows([*sets, sets[0][:0]], seen, 50)
    assert [r[0] for r in got] == [80_000] * 8 + [0]
    assert [r[2] is not None for r in got] == [True] * 2 + [False] * 7
    assert set(got[1][4].view(np.uint64)) == set(sets[0]) & set(sets[1])
    assert seconds(lambda: jaccard.set_rows(sets, seen, 50)) < 30 * seconds(lambda: np.sort(np.concatenate(sets[::-1])))


def test_distinct_and_told():
    for n in (0, 1, 2, 1000):
        keys = np.random.default_rng(n).integers(0, 300, n).astype(np.uint64)
        known = distinct(keys)
        assert known.tolist() == sorted(set(keys.tolist()))
        assert keygroups.told(10 * known, keys).tolist() == (10 * keys).tolist()


def test_jaccard_null_ids_and_repeats(spark):
    t = " ".join(f"w{k}" for k in range(40))
    got = jaccard.near_duplicates(spark.createDataFrame([(5, t), (5, t), (None, t), (None, "alone here"), (2, t + " more")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got if r.n_shingles > 1) == [(False, 2, 2), (False, 5, 2), (False, 5, 2), (True, 0, 2)]
    assert [r.component_id for r in got if r.n_shingles == 1] == [None]


def test_suffix_dedup_looks_counts_up_at_the_cost_of_a_sort():
    letters = np.random.default_rng(9).integers(97, 123, (1000, 8000), dtype=np.uint8)
    table = pa.table({"g": pa.array([0] * 1000, pa.int64()), "doc_id": pa.array(range(1000), pa.int64()), "text": pa.array([x.tobytes().decode() for x in letters])})
    keys, _ = suffix_dedup.distinct_anchors(table, 50, 20)
    alone = np.ones(len(keys), np.uint16)
    data, offsets = column_bytes(table.column("text").combine_chunks())
    assert suffix_dedup.shared_fragments(table, alone, 4, 50, 20).num_rows == 0
    assert seconds(lambda: suffix_dedup.shared_fragments(table, alone, 4, 50, 20)) < 1.5 * seconds(lambda: suffix_dedup.anchored(data, offsets, 50, 20))


def brute_repeats(rows, width=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in texts:
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            least[s] = min(least.get(s, i), i)
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark, docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.without_repeats(docs)).collect()}
    assert got == brute_repeats(rows)
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["FREQUENT", "COMMON"])
def test_suffix_dedup_common_anchors(spark, docs, rows, monkeypatch, name):
    from pyspark import cloudpickle

    monkeypatch.setattr(suffix_dedup, "FREQUENT", 2)
    monkeypatch.setattr(suffix_dedup, name, 2)
    cloudpickle.register_pickle_by_value(suffix_dedup)
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.without_repeats(docs)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    assert got == brute_repeats(rows)


def test_suffix_sort_orders_by_bytes():
    import numpy as np

    rnd = random.Random(2)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(600)) + bytes(58), np.uint8)
    starts = np.array(rnd.sample(range(600), 300))
    part = np.array([rnd.randrange(3) for _ in starts])
    order = suffix_dedup.suffix_sort(data, suffix_dedup.prefix_hashes(data), starts, part, 50)
    raw = data.tobytes()
    keys = [(part[k], raw[starts[k] : starts[k] + 50]) for k in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(300))


def test_decontamination(spark, docs, rows):
    items = [(1, rows[3][1]), (2, " ".join(rows[5][1].split()[3:15])), (3, "one two"), (3, rows[10][1]), (4, None), (None, "a b c"), (5, "?!"), (11, "changed")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(ASCII_LOWER))
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(str(i))
    want = {}
    for i, t in rows:
        w = word.findall((t or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    for size in (1 << 20, 300):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(decontaminate.contamination(docs, bench, block_bytes=size)).collect()}
        assert got == want
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.spans for r in none)
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_line_rules(spark):
    rnd = random.Random(3)
    word = [f"w{k}" for k in range(500)]
    rows = []
    for i in range(90):
        lines = [" ".join(rnd.choices(word, k=30)) for _ in range(3)]
        if i % 2:
            lines.append("Shared  LINE of %d hosts" % 3)
        if i % 7 == 0:
            lines = ["shared line of 3 hosts"] * 9
        rows.append((i, "\n".join(lines), "a" if i % 3 else None))
    rows += [(100, None, "a"), (101, "", "a"), (102, "x " * 50, "a"), (102, "x " * 50, "a"), (None, "#$ é|<>\n\n", "b")]
    got = line_rules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    held, docs = defaultdict(set), Counter()
    norm = lambda x: " ".join(WORDS.findall(x.translate(ASCII_LOWER)))
    for k, (_, t, h) in enumerate(rows):
        docs[h or ""] += 1
        for x in (t or "").split("\n"):
            if norm(x):
                held[h or "", norm(x)].add(k)
    want = []
    for i, t, h in rows:
        t = t or ""
        w = WORDS.findall(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        gone = [k for k, x in enumerate(lines) if len(held[h or "", norm(x)]) > max(20, 2 * docs[h or ""] ** 0.5)]
        left = len(w) - sum(len(WORDS.findall(lines[k])) for k in gone)
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), failed, gone, not failed and left >= 20 and left >= 0.5 * len(w)))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert any(r.removed for r in got) and line_rules.line_rules(empty(spark)).count() == 0


def test_without_lines(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\n\nb\nc", [1]), (None, [])], "t string, r array<int>")
    assert [r[0] for r in df.select(line_rules.without_lines(F.col("t"), F.col("r"))).collect()] == ["a\n\nc", ""]


def test_shards(spark, docs, rows):
    hot = [(5000 + k, "the hot text") for k in range(200)]
    extra = [(None, "null id"), (None, None), (7, "seven")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(hot + extra, "doc_id long, text string"))
    got = shards.assign(df, shards=16).collect()
    total = len(rows) + len(hot) + len(extra)
    assert len(got) == total
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    text = {i: t for i, t in rows}
    for r in got:
        if r.doc_id in text and r.doc_id != 7:
            assert (r.size, r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 1, zlib.crc32((text[r.doc_id] or "").encode()))
    of = {r.doc_id: r.shard for r in got}
    pairs = [(a, a + 2) for a, t in rows if a < 180 and a + 2 in text and text[a] == text[a + 2]]
    assert sum(of[a] == of[b] for a, b in pairs) >= 0.7 * len(pairs)
    assert shards.assign(empty(spark)).count() == 0


def test_fixity_of_many_copies_and_null_ids(spark):
    from pyspark.sql import functions as F

    rows = [(None, f"u{k}", "n") for k in range(300)] + [(7, "u", f"v{k}") for k in range(200)] + [(8, "u", "same")] * 500 + [(k, "u", "w") for k in range(20, 40)]
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame(rows, schema)
    other = spark.createDataFrame(rows[3:300] + [(None, "new", "n")] + rows[302:500] + [(7, "u", "bad")] * 5 + rows[510:] + [(8, "u", "other")] * 4 + [(50, "u", "w")], schema)
    got = fixity.audit(pages, other, file_ids=10, fan=4).collect()
    states = Counter((r.page_id, r.state) for r in got)
    # Of null ids 3 are lost and 1 came: 1 altered, 2 missing. Of id 7 2 are lost and 5 came; of id 8 10 copies are lost, 4 came.
    assert {k: n for k, n in states.items() if k[1] != "intact"} == {(None, "corrupt"): 1, (None, "missing"): 2, (7, "corrupt"): 2, (7, "surplus"): 3, (8, "corrupt"): 4, (8, "missing"): 6, (50, "surplus"): 1}
    assert states[None, "intact"] == 297 and states[7, "intact"] == 198 and states[8, "intact"] == 490 and len(got) == len(rows) + 4
    assert len({r.file_part for r in got if r.page_id is None}) > 3
    places = defaultdict(list)
    for r in got:
        if r.record_index is not None:
            places[r.file_id, r.file_part].append((r.record_index, r.record_offset, r.record_length))
    for own in places.values():
        own.sort()
        assert [i for i, _, _ in own] == list(range(len(own))) and [o for _, o, _ in own] == [sum(n for _, _, n in own[:k]) for k in range(len(own))]
    assert {r.state for r in fixity.audit(pages, pages.orderBy(F.rand(1)), file_ids=10, fan=4).collect()} == {"intact"}


def test_fixity(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "p" * (k % 50)) for k in range(0, 2600, 2)] + [(4, "http://h/4", "again"), (None, None, None), (-3, "u", "v")], "page_id long, url string, html string")
    from pyspark.sql import functions as F

    other = pages.where("page_id IS NULL OR page_id <> 1000").withColumn("html", F.when(F.col("page_id").isin(6, 2400), "changed").otherwise(F.col("html"))).union(spark.createDataFrame([(5, "new", "x")], pages.schema))
    got = fixity.audit(pages, other).collect()
    assert {(r.page_id, r.state) for r in got if r.state != "intact"} == {(6, "corrupt"), (2400, "corrupt"), (1000, "missing"), (5, "surplus")}
    assert len(got) == pages.count() + 1
    files = defaultdict(list)
    for r in got:
        if r.record_index is not None:
            files[r.file_id].append(r)
    for own in files.values():
        own.sort(key=lambda r: r.record_index)
        assert [r.record_offset for r in own] == [sum(x.record_length for x in own[:k]) for k in range(len(own))]
    assert {r.state for r in fixity.audit(pages, pages).collect()} == {"intact"}
    assert fixity.audit(pages.limit(0), pages.limit(0)).count() == 0
