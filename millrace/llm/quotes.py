"""Quotation linking: messages' quoted passages are joined to the messages they come from.

Quote levels are parsed from leading ">" marks; consecutive lines of one level are a passage. A passage's normalised words,
in hashed windows, are joined to the windows of the messages of its conversation: each window counts for the latest earlier
message that says it in its own words, and the passage comes from the message that most of its windows, at least half of
them, count for. Replies make threads; the messages' own words, without quotes and attributions, numbered within their thread,
are the reply-ordered conversations. All of it is DataFrame work; messages without quotes pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.llm.common import discard, materialize

#: The marks before a quoted line, and a line that names whom the lines below it quote.
MARKS = r"^[ \t]*(?:>[ \t]?)+"
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|.*\b(?:wrote|schrieb|a écrit|escribió))\s*:\s*$"
WHITE = r"[\x20\x09-\x0D]+"
ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Messages in one row of an assembled thread.
CHUNK = 1000


def words_of(text: Column) -> Column:
    """A text's words, A-Z lower-cased; an array without elements for a blank text."""
    return F.filter(F.split(F.translate(text, ASCII, ASCII.lower()), WHITE), lambda w: w != "")


def windows_of(words: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` words, each once; of all words where there are fewer."""
    last = F.greatest(F.size(words) - width + 1, F.lit(1))
    keys = F.transform(F.sequence(F.lit(1), last), lambda k: F.md5(F.array_join(F.slice(words, k, F.lit(width)), " ")))
    return F.when(F.size(words) > 0, F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def lines_of(messages: DataFrame) -> DataFrame:
    """(row, conv_id, turn, at, line, depth, body, run, attribution) of every line of the messages."""
    lines = messages.select("row", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    lines = lines.withColumn("depth", F.length(F.regexp_replace(marks, "[^>]", ""))).withColumn("body", F.expr("substring(line, length(regexp_extract(line, '" + MARKS.replace("\\", "\\\\") + "', 0)) + 1)"))
    inside = Window.partitionBy("row").orderBy("at")
    fresh = F.coalesce((F.col("depth") != F.lag("depth").over(inside)).cast("int"), F.lit(0))
    lines = lines.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(inside))
    said = F.when((F.col("depth") > 0) | F.col("line").rlike(r"[^\x20\x09-\x0D]"), F.col("depth"))
    following = F.first(said, ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing))
    named = (F.col("depth") == 0) & F.col("line").rlike(ATTRIBUTION) & F.coalesce(following > 0, F.lit(False))
    return lines.withColumn("attribution", named).drop("fresh")


def in_order(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("at", column))), lambda x: x[column])


def threads(replies: DataFrame) -> DataFrame:
    """(row, head, reply_depth) of the messages that reply (row, parent).

    Every round doubles how far up a message looks, so a chain of n replies takes log n rounds.
    """
    state = materialize(replies.select("row", F.col("parent").alias("head"), F.lit(1).cast("long").alias("reply_depth")), "threads")
    while True:
        up = state.select(F.col("row").alias("head"), F.col("head").alias("higher"), F.col("reply_depth").alias("more"))
        new = materialize(state.join(up, "head", "left").select("row", F.coalesce("higher", "head").alias("head"), (F.col("reply_depth") + F.coalesce("more", F.lit(0))).alias("reply_depth"), F.col("higher").isNotNull().alias("moved")), "threads")
        done = not new.where("moved").limit(1).count()
        discard(state)
        state = new.drop("moved")
        if done:
            return state


def link_quotes(messages: DataFrame, width: int = 5) -> DataFrame:
    """Every message with its own words and its place in its conversation.

    (conv_id, turn, role, text, n_quoted, n_linked, quote_depth, reply_to, thread, reply_depth, position). text: the message
    without quoted lines and the attributions above them; a null text is empty. n_quoted: passages, n_linked: those that an
    earlier message's own words hold; a passage of fewer than ``width`` words must be one of its lines or all it says, a
    longer one may be wrapped anew or begin and end inside a line. reply_to: the turn that most windows of the passages of
    level 1 come from, the latest among equals; null without any. thread: the turn at the head of the replies, its own where
    it replies to none; position: the message's number, from 0, among those of its thread in order of turns, so that a
    reply comes after what it replies to. A message of a null conversation or turn links with nothing. Each row is a message, rows
    of a repeated turn too. An empty table gives no rows; other columns don't matter; a message of any length is read whole.
    """
    source = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = materialize(source.withColumn("row", F.monotonically_increasing_id()).withColumn("quotes", F.col("text").rlike("(?m)" + MARKS)), "messages")
    named = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    asking = named.where("quotes").select("conv_id").distinct()
    lines = materialize(lines_of(named.join(asking, "conv_id", "left_semi")), "quoted")
    passages = lines.where("depth > 0").groupBy("row", "conv_id", "turn", "run", "depth").agg(F.array_join(in_order("body"), " ").alias("body"))
    passages = materialize(passages.withColumn("keys", windows_of(words_of(F.col("body")), width)).where("size(keys) > 0").drop("body"), "passages")
    own = lines.where("depth = 0 AND NOT attribution")
    whole = own.groupBy("row", "conv_id", "turn").agg(F.array_join(in_order("line"), " ").alias("line"))
    short = own.select("row", "conv_id", "turn", "line").where(F.size(words_of(F.col("line"))) < width)
    said = whole.union(short).select("row", "conv_id", "turn", F.explode(windows_of(words_of(F.col("line")), width)).alias("key")).distinct()
    # Each window of a passage meets the latest earlier message that says it: one carried value, no pairs.
    asked = passages.select("conv_id", "turn", "row", "run", "depth", F.explode("keys").alias("key"))
    none = F.lit(None)
    both = asked.select("conv_id", "key", "turn", F.lit(0).alias("side"), "row", "run", "depth", none.cast("long").alias("from_turn")).union(
        said.select("conv_id", "key", "turn", F.lit(1).alias("side"), "row", none.cast("long").alias("run"), none.cast("int").alias("depth"), F.col("turn").alias("from_turn"))
    )
    before = Window.partitionBy("conv_id", "key").orderBy("turn", "side", "row").rowsBetween(Window.unboundedPreceding, 0)
    origin = F.last(F.when(F.col("side") == 1, F.struct(F.col("from_turn").alias("turn"), F.col("row").alias("row"))), ignorenulls=True).over(before)
    met = both.withColumn("origin", origin).where("side = 0 AND origin IS NOT NULL")
    votes = met.groupBy("row", "run", "depth", "origin").agg(F.count("*").alias("windows"))
    best = votes.groupBy("row", "run", "depth").agg(F.max(F.struct("windows", "origin")).alias("best"))
    linked = best.join(passages.select("row", "run", F.size("keys").alias("n")), ["row", "run"]).where("2 * best.windows >= n")
    linked = materialize(linked.select("row", "depth", F.col("best.windows").alias("windows"), F.col("best.origin").alias("origin")), "linked")
    direct = linked.where("depth = 1").groupBy("row", "origin").agg(F.sum("windows").alias("windows"))
    replies = materialize(direct.groupBy("row").agg(F.max(F.struct("windows", "origin")).alias("best")).select("row", F.col("best.origin.row").alias("parent"), F.col("best.origin.turn").alias("reply_to")), "replies")
    up = threads(replies)
    heads = up.select(F.col("head").alias("row")).distinct().select("row", F.col("row").alias("head"), F.lit(0).cast("long").alias("reply_depth"))
    members = up.select("row", "head", "reply_depth").union(heads).join(rows.select("row", "turn"), "row")
    order = Window.partitionBy("head").orderBy("turn", "row")
    placed = members.select("row", "reply_depth", F.first("turn").over(order).alias("thread"), (F.row_number().over(order) - 1).cast("long").alias("position"))
    cleaned = own.join(rows.where("quotes").select("row"), "row", "left_semi").groupBy("row").agg(F.regexp_replace(F.array_join(in_order("line"), "\n"), r"^\n+|\n+$", "").alias("own"))
    counted = passages.groupBy("row").agg(F.count("*").alias("n_quoted"), F.max("depth").alias("quote_depth"))
    found = linked.groupBy("row").agg(F.count("*").alias("n_linked"))
    joined = rows.join(cleaned, "row", "left").join(counted, "row", "left").join(found, "row", "left").join(replies.select("row", "reply_to"), "row", "left").join(placed, "row", "left")
    zero = F.lit(0)
    told = F.when(F.col("quotes") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.coalesce("own", F.lit(""))).otherwise(F.col("text"))
    return joined.select(
        "conv_id", "turn", "role", told.alias("text"), F.coalesce("n_quoted", zero).cast("long").alias("n_quoted"), F.coalesce("n_linked", zero).cast("long").alias("n_linked"),
        F.coalesce("quote_depth", zero).cast("long").alias("quote_depth"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("reply_depth", zero).cast("long").alias("reply_depth"),
        F.coalesce("position", zero).cast("long").alias("position"),
    )


def assembled(found: DataFrame) -> DataFrame:
    """(conv_id, thread, part, messages): the threads' messages in order, as arrays of (position, turn, role, text).

    A thread of more than CHUNK messages is several parts, so that no task gathers an unbounded one.
    """
    said = F.struct("position", "turn", "role", "text")
    return found.groupBy("conv_id", "thread", F.floor(F.col("position") / CHUNK).alias("part")).agg(F.array_sort(F.collect_list(said)).alias("messages"))
