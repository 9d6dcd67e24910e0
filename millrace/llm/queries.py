"""The registered queries of this subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, extract, fixity, jaccard, line_rules, pack, quotes, shards, suffix_dedup, toxicity
from millrace.session import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path() -> str:
    """Place of the public vocabulary that production packing uses."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.digest(pack.pack(table(spark, sf_dir, "documents"), vocabulary_path()))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT r.v, e.y FROM r JOIN e ON r.c = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY v) m ON m.v = d.doc_id
"""


def op3_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica to audit: about one page in a hundred is altered, and as many are lost."""
    draw = F.col("page_id") % 100
    html = F.when(draw == 7, F.concat(F.lit("#"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    return pages.where(F.coalesce(draw != 8, F.lit(True))).select("page_id", "url", html.alias("html"))


def op4_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(pages, damaged(pages))


OP4_SQL = """
WITH r AS (
  SELECT page_id, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html' || e
    || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS rec
  FROM pages, (SELECT chr(13) || chr(10) AS e)),
l AS (SELECT page_id, page_id // 1000 AS file_id, page_id % 1000 AS slot, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS hash FROM r),
p1 AS (SELECT file_id, slot // 16 AS up, sha256(string_agg(sha256(hash), '' ORDER BY slot)) AS h FROM l GROUP BY 1, 2),
p2 AS (SELECT file_id, up // 16 AS up, sha256(string_agg(h, '' ORDER BY up)) AS h FROM p1 GROUP BY 1, p1.up // 16),
p3 AS (SELECT file_id, sha256(string_agg(h, '' ORDER BY up)) AS file_root FROM p2 GROUP BY 1)
SELECT page_id, file_id, 0 AS file_part, row_number() OVER w - 1 AS record_index, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset, length AS record_length, hash AS record_sha256, file_root,
  CASE page_id % 100 WHEN 7 THEN 'corrupt' WHEN 8 THEN 'missing' ELSE 'intact' END AS state
FROM l JOIN p3 USING (file_id) WINDOW w AS (PARTITION BY file_id ORDER BY page_id)
"""


def op5_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(table(spark, sf_dir, "documents")).select("doc_id", *line_rules.COUNTS, "base_failed", "kept", F.size("removed").cast("long").alias("n_removed_lines"))


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
gg AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM gg WHERE c > 1) GROUP BY r),
l AS (SELECT r, host, t, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS lw
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d)),
ll AS (SELECT r, host, t, line, array_to_string(lw, ' ') AS norm, len(lw) AS words FROM l WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ll GROUP BY r),
held AS (SELECT host, norm, count(DISTINCT r) AS holders FROM ll GROUP BY 1, 2),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY 1),
flag AS (SELECT held.host, norm FROM held JOIN hosts USING (host) WHERE holders > 20 AND holders > 2.0 * sqrt(docs)),
lost AS (SELECT r, sum(words) AS lost, count(*) AS gone FROM ll JOIN flag USING (host, norm) GROUP BY r),
f AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(gone, 0) AS gone
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - lost >= 20 AND n_words - lost >= 0.5 * n_words AS kept, gone AS n_removed_lines
FROM f
"""


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


OP8_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP8_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS t, regexp_matches(coalesce(text, ''), '(?m)^[ \t]*(?:>[ \t]?)+') AS quotes FROM conversations),
l AS (
  SELECT r, conv_id, turn, unnest(generate_series(1, len(ls))) AS place, unnest(ls) AS line
  FROM (SELECT *, string_split(t, chr(10)) AS ls FROM m WHERE turn IS NOT NULL AND conv_id IN (SELECT conv_id FROM m WHERE quotes AND turn IS NOT NULL))),
e AS (
  SELECT *, len(regexp_replace(marks, '[^>]', '', 'g')) AS depth, substr(line, len(marks) + 1) AS body FROM (SELECT *, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') AS marks FROM l)),
f AS (
  SELECT *, CASE WHEN depth <> lag(depth) OVER (PARTITION BY r ORDER BY place) THEN 1 ELSE 0 END AS fresh,
    first_value(CASE WHEN depth > 0 OR regexp_matches(line, '[^\x20\x09-\x0D]') THEN depth END IGNORE NULLS) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM e),
g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY place) AS run,
    depth = 0 AND regexp_matches(line, '(?i)^\s*(?:on\b.*\bwrote|.*\b(?:wrote|schrieb|a écrit|escribió))\s*:\s*$') AND coalesce(following > 0, false) AS named FROM f),
pw AS (SELECT r, conv_id, turn, run, depth, {OP8_WORDS.format("string_agg(body, ' ' ORDER BY place)")} AS w FROM g WHERE depth > 0 GROUP BY r, conv_id, turn, run, depth),
pk AS (SELECT DISTINCT r, conv_id, turn, run, depth, array_to_string(w[i:i + 4], ' ') AS key FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM pw WHERE len(w) > 0)),
own AS (SELECT * FROM g WHERE depth = 0 AND NOT named),
ow AS (
  SELECT r, conv_id, turn, {OP8_WORDS.format("string_agg(line, ' ' ORDER BY place)")} AS w FROM own GROUP BY r, conv_id, turn
  UNION ALL SELECT * FROM (SELECT r, conv_id, turn, {OP8_WORDS.format("line")} AS w FROM own) WHERE len(w) < 5),
sk AS (SELECT DISTINCT r, conv_id, turn, array_to_string(w[i:i + 4], ' ') AS key FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM ow WHERE len(w) > 0)),
met AS (SELECT p.r, p.run, p.depth, p.key, arg_max(s.r, (s.turn, s.r)) AS origin FROM pk p JOIN sk s ON s.conv_id = p.conv_id AND s.key = p.key AND s.turn < p.turn GROUP BY p.r, p.run, p.depth, p.key),
votes AS (SELECT met.r, run, depth, origin, m.turn AS origin_turn, count(*) AS n FROM met JOIN m ON m.r = origin GROUP BY met.r, run, depth, origin, m.turn),
best AS (SELECT r, run, depth, arg_max(origin, (n, origin_turn, origin)) AS origin, max(n) AS n FROM votes GROUP BY r, run, depth),
lk AS (SELECT best.* FROM best JOIN (SELECT r, run, count(*) AS k FROM pk GROUP BY r, run) USING (r, run) WHERE 2 * n >= k),
dr AS (SELECT r, origin, sum(n) AS n FROM lk WHERE depth = 1 GROUP BY r, origin),
rp AS (SELECT dr.r, arg_max(origin, (n, m.turn, origin)) AS parent FROM dr JOIN m ON m.r = origin GROUP BY dr.r),
th AS (SELECT r, parent AS head, 1 AS k FROM rp UNION ALL SELECT th.r, rp.parent, k + 1 FROM th JOIN rp ON rp.r = th.head),
hd AS (SELECT r, arg_max(head, k) AS head, max(k) AS depth FROM th GROUP BY r),
mem AS (SELECT r, head, depth FROM hd UNION SELECT head, head, 0 FROM hd),
pos AS (SELECT mem.r, mem.depth, h.turn AS thread, row_number() OVER (PARTITION BY mem.head ORDER BY x.turn, x.r) - 1 AS position FROM mem JOIN m x ON x.r = mem.r JOIN m h ON h.r = mem.head),
cl AS (SELECT r, regexp_replace(string_agg(line, chr(10) ORDER BY place), '^\n+|\n+$', '', 'g') AS own FROM own GROUP BY r),
pc AS (SELECT r, count(DISTINCT run) AS n, max(depth) AS depth FROM pk GROUP BY r),
lc AS (SELECT r, count(*) AS n FROM lk GROUP BY r)
SELECT m.conv_id, m.turn, m.role, CASE WHEN m.quotes AND m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN coalesce(cl.own, '') ELSE m.t END AS text,
  coalesce(pc.n, 0) AS n_quoted, coalesce(lc.n, 0) AS n_linked, CAST(coalesce(pc.depth, 0) AS BIGINT) AS quote_depth, o.turn AS reply_to, coalesce(pos.thread, m.turn) AS thread,
  CAST(coalesce(pos.depth, 0) AS BIGINT) AS reply_depth, coalesce(pos.position, 0) AS position
FROM m LEFT JOIN cl USING (r) LEFT JOIN pc USING (r) LEFT JOIN lc USING (r) LEFT JOIN rp USING (r) LEFT JOIN m o ON o.r = rp.parent LEFT JOIN pos ON pos.r = m.r
"""


def op9_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


OP9_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
occ AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.without_repeats(table(spark, sf_dir, "documents")))


OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c0 AS (SELECT doc_id, k, h[2000 * k + 1:2000 * k + 2098] AS part FROM (SELECT doc_id, h, unnest(generate_series(0, (len(h) // 2 - 50) // 1000)) AS k FROM d WHERE len(h) >= 100)),
w AS (SELECT doc_id, 1000 * k + q AS p, part[2 * q + 1:2 * q + 100] AS s FROM (SELECT doc_id, k, part, unnest(generate_series(0, len(part) // 2 - 50)) AS q FROM c0)),
m AS (SELECT hash(s) AS s, min(doc_id) AS least FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
c AS (SELECT w.doc_id, w.p FROM w JOIN m ON hash(w.s) = m.s WHERE w.doc_id > m.least),
r AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM c)),
x AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY 1, 2),
g AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM x),
k AS (SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) AS kept
  FROM g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE kept || h[2 * last + 1:] END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_harmonic_packing, op2_ngram_jaccard_join, op3_label_propagation_shards, op4_merkle_fixity, op5_crf_extraction, op6_bigru_toxicity, op7_line_frequency_rules, op8_quotation_linking, op9_wu_manber_decontamination, op10_suffix_dedup)}
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op4_merkle_fixity": OP4_SQL,
    "op7_line_frequency_rules": OP7_SQL,
    "op8_quotation_linking": OP8_SQL,
    "op9_wu_manber_decontamination": OP9_SQL,
    "op10_suffix_dedup": OP10_SQL,
}
