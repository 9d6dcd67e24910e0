"""Quotation linking against plain Python and against its SQL, on planted quotes."""

import random
import re
from collections import Counter

import pytest

from millrace.llm import quotes
from millrace.llm.queries import OP8_SQL

SCHEMA = "conv_id long, turn long, role string, text string, key string"
ROWS = [
    (1, 0, "user", "Shall we  meet\non Monday?"),
    (1, 1, "assistant", "On Friday Ann wrote:\n\n> shall we meet\n> On Monday?\n\nYes.\nAt noon."),
    (1, 2, "user", ">> on monday?\n> at NOON.\nFine"),
    (1, 3, "user", "> nobody said this\nOther"),
    (1, 4, "user", "no quotes: 3 > 2"),
    (1, 5, "user", "> fine"),
    (2, 0, "user", "> fine\nAnother conversation"),
    (None, 0, "user", "> fine"),
    (3, 0, "user", None),
    (3, 0, "user", None),
]


def test_small_conversation(spark):
    df = spark.createDataFrame([(*r, "k") for r in ROWS], SCHEMA)
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    assert [(got[1, k].text, got[1, k].reply_to, got[1, k].thread, got[1, k].reply_depth, got[1, k].position, got[1, k].n_quoted, got[1, k].n_linked, got[1, k].quote_depth) for k in range(6)] == [
        ("Shall we  meet\non Monday?", None, 0, 0, 0, 0, 0, 0),
        ("Yes.\nAt noon.", 0, 0, 1, 1, 1, 1, 1),
        ("Fine", 1, 0, 2, 2, 2, 2, 2),
        ("Other", None, 3, 0, 0, 1, 0, 1),
        ("no quotes: 3 > 2", None, 4, 0, 0, 0, 0, 0),
        ("", 2, 0, 3, 3, 1, 1, 1),
    ]
    assert got[2, 0].reply_to is None and got[None, 0].reply_to is None and got[3, 0].text == ""
    assert quotes.link_quotes(df).count() == len(ROWS) and quotes.link_quotes(df.limit(0)).count() == 0
    threads = {(r.conv_id, r.thread): [(m.turn, m.text) for m in r.messages] for r in quotes.assembled(quotes.link_quotes(df)).collect()}
    assert threads[1, 0] == [(0, "Shall we  meet\non Monday?"), (1, "Yes.\nAt noon."), (2, "Fine"), (5, "")]


def planted(seed):
    """Conversations in the table's shape: replies that quote whole messages, parts of lines, wrapped anew, nested, or common lines."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abdeilnorstué") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    rows = []
    for conv in range(25):
        own = []
        for turn in range(rnd.randint(1, 9)):
            lines = [prose(rnd.randint(1, 14)) for _ in range(rnd.randint(1, 3))]
            if rnd.random() < 0.3:
                lines.append("Thanks a lot.")
            text = list(lines)
            if own and rnd.random() < 0.7:
                words = " ".join(rnd.choice(own)).split()
                a = rnd.randrange(len(words))
                part = words[a : a + rnd.randint(1, 20)]
                wrap = rnd.randint(2, 6)
                depth = rnd.choice([1, 1, 1, 2])
                quoted = [("> " * depth if rnd.random() < 0.5 else ">" * depth) + " ".join(part[k : k + wrap]).upper() for k in range(0, len(part), wrap)]
                if rnd.random() < 0.3:
                    quoted = [">> " + " ".join(rnd.choice(own))] + quoted
                if rnd.random() < 0.3:
                    quoted.append("> Thanks a  lot.")
                head = ["On Monday someone wrote:"] + [""] * rnd.randint(0, 1) if rnd.random() < 0.5 else []
                text = head + quoted + text if rnd.random() < 0.7 else text[:1] + head + quoted + text[1:]
            rows.append((conv, turn if rnd.random() < 0.97 else None, rnd.choice(["user", "assistant"]), "\n".join(text)))
            own.append(lines)
        if rnd.random() < 0.2:
            rows.append(rows[-1])
    return rows


def brute(rows, width=5):
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t.translate({i: i + 32 for i in range(65, 91)}))
    keys = lambda w: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    attribution = re.compile(r"^\s*(?:on\b.*\bwrote|.*\b(?:wrote|schrieb|a écrit|escribió))\s*:\s*$", re.I)
    parsed = []
    for conv, turn, role, text in rows:
        text = text or ""
        lines = []
        for line in text.split("\n"):
            m = re.match(r"[ \t]*(?:>[ \t]?)+", line)
            lines.append((m.group(0).count(">"), line[m.end() :]) if m else (0, line))
        own, passages = [], []
        for k, (depth, body) in enumerate(lines):
            following = [d for d, b in lines[k + 1 :] if d or b.strip()]
            if depth and passages and k and lines[k - 1][0] == depth:
                passages[-1][1].append(body)
            elif depth:
                passages.append((depth, [body]))
            elif not (attribution.match(body) and following and following[0] > 0):
                own.append(body)
        named = conv is not None and turn is not None
        found = [(d, keys(words(" ".join(b)))) for d, b in passages] if named else []
        said = keys(words(" ".join(own))) | {k for x in own if len(words(x)) < width for k in keys(words(x))}
        quoted = any(d for d, _ in lines)
        parsed.append({"conv": conv, "turn": turn, "role": role, "text": "\n".join(own).strip("\n") if quoted and named else text, "passages": [p for p in found if p[1]], "said": said if named else set()})
    parent, linked = {}, Counter()
    for i, p in enumerate(parsed):
        direct = Counter()
        for depth, asked in p["passages"]:
            votes = Counter()
            for key in asked:
                at = [(q["turn"], j) for j, q in enumerate(parsed) if q["conv"] == p["conv"] and key in q["said"] and q["turn"] < p["turn"]]
                if at:
                    votes[max(at)] += 1
            if votes:
                n, origin = max((n, o) for o, n in votes.items())
                if 2 * n >= len(asked):
                    linked[i] += 1
                    if depth == 1:
                        direct[origin] += n
        if direct:
            parent[i] = max((n, o) for o, n in direct.items())[1][1]
    head, depth = {}, {}
    for i in range(len(parsed)):
        k, n = i, 0
        while k in parent:
            k, n = parent[k], n + 1
        head[i], depth[i] = k, n
    out = []
    for i, p in enumerate(parsed):
        mates = sorted((parsed[j]["turn"], j) for j in head if head[j] == head[i]) if any(head[j] == head[i] for j in head if j != i) else [(p["turn"], i)]
        out.append((p["conv"], p["turn"], p["role"], p["text"], len(p["passages"]), linked[i], max((d for d, _ in p["passages"]), default=0), parsed[parent[i]]["turn"] if i in parent else None, parsed[head[i]]["turn"], depth[i], mates.index((p["turn"], i))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_quotes(spark, tmp_path, seed):
    duckdb = pytest.importorskip("duckdb")
    rows = planted(seed) + [(r[0] + 100 if r[0] is not None else None, *r[1:]) for r in ROWS]
    spark.createDataFrame([(*r, "k") for r in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    want = sorted(map(repr, brute(rows)))
    got = quotes.link_quotes(df)
    names = got.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert sum("None, None" not in x for x in want) > 20
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    told = con.execute(OP8_SQL)
    at = [[x[0] for x in told.description].index(n) for n in names]
    assert sorted(repr(tuple(r[k] for k in at)) for r in told.fetchall()) == want
