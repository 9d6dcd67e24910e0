"""Merkle fixity audit of WARC archives.

Records are laid out in archive files; each file's records, in offset order, are the leaves of a
hash tree whose inner nodes cover ordered ranges, and the files' roots form one tree above. Two replicas
are compared from the root down; only the children of nodes that differ are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.llm.common import materialize
from millrace.session import ship

#: Ids to a file, and children to a node.
FILE_IDS, FAN = 1000, 16
#: Distinct records to an id, on average, beyond which a file is several archives; copies of a record that one task makes at once.
PART_FILL, COPIES = 4, 10_000
FILE = ["file_id", "part"]


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.1 resource record; a null url or payload counts as empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves_of(pages: DataFrame, file_ids: int) -> DataFrame:
    """(page_id, range, hash, length, n): the distinct records of an archive, and how often each is there.

    Equal records are counted before anything is shuffled by id, so a record that is there many times is one leaf.
    Only hashes and lengths are shuffled, never payloads.
    """
    ship(pages.sparkSession)
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("hash"))
    found = found.groupBy("page_id", "hash").agg(F.count("*").alias("n"), F.first("length").alias("length"))
    return found.withColumn("file_id", F.coalesce(F.floor(F.col("page_id") / file_ids), F.lit(-1)).cast("long"))


def file_parts(leaves: DataFrame, file_ids: int) -> DataFrame:
    """(file_id, parts) of the files with more distinct records than PART_FILL times the ids of a file: repeated ids, or null ones."""
    return leaves.groupBy("file_id").agg(F.count("*").alias("m")).where(F.col("m") > PART_FILL * file_ids).select("file_id", F.ceil(F.col("m") / (PART_FILL * file_ids)).cast("int").alias("parts"))


def records(leaves: DataFrame, parts: DataFrame) -> DataFrame:
    """(page_id, file_id, part, n, length, hash, idx, offset): distinct records with the place of their first copy.

    A file holds the records of successive ids, ordered by id and hash, a null id lies in file -1; a file in ``parts`` is
    several archives, to which the records are dealt by hash, so that no task orders an unbounded file.
    """
    dealt = leaves.join(parts, "file_id", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("hash"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    before = Window.partitionBy(*FILE).orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("idx", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("offset", F.coalesce(F.sum(F.col("n") * F.col("length")).over(before), F.lit(0)))


def copies(rows: DataFrame, columns: list[str], first: Column, last: Column) -> DataFrame:
    """A row for each copy from ``first`` up to ``last``, with its number ``k``; many copies of one record go to many tasks."""
    chunk = F.explode(F.sequence(F.floor(first / COPIES).cast("long"), F.floor((last - 1) / COPIES).cast("long")))
    some = rows.where(last > first).select(*columns, first.alias("__a"), last.alias("__b"), chunk.alias("__c"))
    spread = some.where("__b <= 1").union(some.where("__b > 1").repartition(F.col("__c"), F.col("hash")))
    inside = F.sequence(F.greatest("__a", F.col("__c") * COPIES), F.least("__b", (F.col("__c") + 1) * COPIES) - 1)
    return spread.select(*columns, F.explode(inside).alias("k"))


def parents(nodes: DataFrame, fan: int, keys: list[str]) -> DataFrame:
    """One level up: each node hashes the hashes of its ordered children."""
    up = nodes.groupBy(*keys, F.floor(F.col("idx") / fan).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("children"))
    return up.select(*keys, F.col("up").alias("idx"), F.sha2(F.array_join(F.transform("children", lambda c: c["hash"]), ""), 256).alias("hash"))


def tree(leaves: DataFrame, keys: list[str], fan: int, span: int | None = None) -> list[DataFrame]:
    """The levels of the hash trees, leaves first, up to one that covers ``span`` leaves (all, if None) in a node."""
    levels = [leaves.select(*keys, "idx", "hash")]
    most = span - 1 if span else leaves.agg(F.max("idx")).first()[0] or 0
    while most > 0:
        levels.append(materialize(parents(levels[-1], fan, keys), "tree"))
        most //= fan
    return levels


def descend(ours: list[DataFrame], theirs: list[DataFrame], keys: list[str], fan: int, within: DataFrame | None) -> DataFrame:
    """(keys, idx, ours, theirs) of the leaves that differ, found from the roots of ``within`` (all, if None) down."""
    suspect = within
    for level in range(max(len(ours), len(theirs)) - 1, -1, -1):
        a = lifted(ours, level).select(*keys, "idx", F.col("hash").alias("ours"))
        b = lifted(theirs, level).select(*keys, "idx", F.col("hash").alias("theirs"))
        if suspect is not None:
            on = [*keys, "up"] if "up" in suspect.columns else keys
            a, b = (x.withColumn("up", F.floor(F.col("idx") / fan).cast("long")).join(suspect, on, "left_semi").drop("up") for x in (a, b))
        differ = a.join(b, [*keys, "idx"], "full").where(~F.col("ours").eqNullSafe(F.col("theirs")))
        suspect = materialize(differ.select(*keys, F.col("idx").alias("up")), "suspect") if level else differ
    return suspect


def lifted(levels: list[DataFrame], level: int) -> DataFrame:
    """A level of a tree; a tree that ends below has its root there."""
    return levels[min(level, len(levels) - 1)]


def audit(pages: DataFrame, replica: DataFrame, file_ids: int = FILE_IDS, fan: int = FAN) -> DataFrame:
    """Every record of the primary and every surplus one of the replica, with its place and state.

    state: ``intact``, ``corrupt`` (the replica has other bytes for it), ``missing`` (the replica
    has no record for it) or ``surplus`` (only the replica has it, its place is null). A record
    that is lost or added moves those behind it in its file, so records are matched by id: of the records of an id, those
    of equal bytes match first; what is then left of the primary's, in the order of hashes, is corrupt as long as the
    replica has any left, then missing; what is left of the replica's is surplus. ``file_root`` is the root of the primary's
    file. Null ids, repeated ids and repeated records are audited alike, those of one file in several archives (``file_part``)
    where they are many. A null url or html counts as empty; empty tables give no rows; other columns don't matter.
    """
    mine, other = (materialize(leaves_of(x, file_ids), "leaves") for x in (pages, replica))
    parts = materialize(file_parts(mine.select("file_id", "hash", "page_id").union(other.select("file_id", "hash", "page_id")).distinct(), file_ids), "parts")
    mine, other = (materialize(records(x, parts).withColumn("slot", F.coalesce(F.col("page_id") - F.col("file_id") * file_ids, F.lit(0))), "records") for x in (mine, other))
    # Trees are over slots that a loss doesn't shift: the id's place in its file's range.
    told = F.transform(F.array_sort(F.collect_list(F.struct("hash", "n"))), lambda c: F.when(c["n"] == 1, c["hash"]).otherwise(F.concat(c["hash"], F.lit("*"), c["n"].cast("string"))))
    keyed = [x.groupBy(*FILE, F.col("slot").alias("idx")).agg(F.sha2(F.array_join(told, ","), 256).alias("hash")) for x in (mine, other)]
    ours, theirs = (tree(x, FILE, fan, file_ids) for x in keyed)
    tops = [lifted(x, len(x) - 1) for x in (ours, theirs)]
    roots = tops[0].select(*FILE, F.col("hash").alias("file_root"))
    files = [tree(t.select("part", F.col("file_id").alias("idx"), "hash"), ["part"], fan) for t in tops]
    bad_files = descend(files[0], files[1], ["part"], fan, None).select(F.col("idx").alias("file_id"), "part")
    bad = descend(ours, theirs, FILE, fan, bad_files).select("file_id", F.col("idx").alias("slot")).distinct()
    # In the slots that differ: what matches, and what is left on either side.
    a = mine.join(bad.withColumn("bad", F.lit(True)), ["file_id", "slot"], "left")
    b = other.join(bad, ["file_id", "slot"], "left_semi").select("page_id", "hash", F.col("n").alias("m"), "file_id", "part", "slot", "length")
    matched = a.join(b.select("file_id", "slot", "hash", "m"), ["file_id", "slot", "hash"], "left")
    matched = materialize(matched.withColumn("good", F.when(F.col("bad").isNull(), F.col("n")).otherwise(F.least("n", F.coalesce("m", F.lit(0))))), "matched")
    spare = b.join(mine.join(bad, ["file_id", "slot"], "left_semi").select("file_id", "slot", "hash", "n"), ["file_id", "slot", "hash"], "left").withColumn("more", F.col("m") - F.least("m", F.coalesce("n", F.lit(0)))).where("more > 0")
    lost = matched.where("bad AND n > good").withColumn("gone", F.col("n") - F.col("good"))
    before = Window.partitionBy("file_id", "slot").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    have = spare.groupBy("file_id", "slot").agg(F.sum("more").alias("have"))
    want = lost.groupBy("file_id", "slot").agg(F.sum("gone").alias("want"))
    lost = lost.withColumn("at", F.coalesce(F.sum("gone").over(before), F.lit(0))).join(have, ["file_id", "slot"], "left")
    altered = lost.select(*FILE, "slot", "hash", F.least("gone", F.greatest(F.lit(0), F.coalesce("have", F.lit(0)) - F.col("at"))).alias("altered"))
    spare = spare.withColumn("at", F.coalesce(F.sum("more").over(before), F.lit(0))).join(want, ["file_id", "slot"], "left")
    spare = spare.withColumn("used", F.least("more", F.greatest(F.lit(0), F.coalesce("want", F.lit(0)) - F.col("at"))))
    placed = matched.join(altered, [*FILE, "slot", "hash"], "left")
    known = copies(placed, ["page_id", *FILE, "idx", "offset", "length", "hash", "good", "altered"], F.lit(0).cast("long"), F.col("n"))
    state = F.when(F.col("k") < F.col("good"), "intact").when(F.col("k") < F.col("good") + F.coalesce("altered", F.lit(0)), "corrupt").otherwise("missing")
    known = known.select("page_id", *FILE, (F.col("idx") + F.col("k")).alias("idx"), (F.col("offset") + F.col("k") * F.col("length")).alias("offset"), "length", "hash", state.alias("state"))
    none = F.lit(None).cast("long")
    extra = copies(spare, ["page_id", *FILE, "hash"], F.col("used"), F.col("more")).select("page_id", *FILE, none.alias("idx"), none.alias("offset"), none.alias("length"), "hash", F.lit("surplus").alias("state"))
    return known.union(extra).join(roots, FILE, "left").select(
        "page_id", "file_id", F.col("part").alias("file_part"), F.col("idx").alias("record_index"), F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("hash").alias("record_sha256"), "file_root", "state"
    )
