"""Log templates mined from messages (after the published Brain method), by grouping and joining only.

Masked messages are split into words; a message's template is fixed by its largest set of words that occur equally
often at their places. Elsewhere a place with many different words is variable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.shape import col

#: What is masked, in this order, and by what; and characters that are dropped.
MASKS = [
    (r"(/|)([0-9]+\.){3}[0-9]+(:[0-9]+|)(:|)", "<*IP*>"),
    (r"(\d{4}-\d{2}-\d{2})[T ]?(\d{2}:\d{2}:\d{2})(\.\d{3})?(Z|([+-]\d{2}:?\d{2}))?", "<*DATETIME*>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<*UUID*>"),
    (r"((0x|0X)[0-9a-fA-F]+)|[a-zA-Z]+\d+|([+-]?(?!\d{3}$)\d{4,}(\.\d*)?|\.\d+)", "<*>"),
    (r"(?<=[^A-Za-z0-9 ])(-?\+?\d+)(?=[^A-Za-z0-9])", "<*>"),
]
DROPPED = "[,+]"
#: Least share of the greatest frequency, and most words at a place that isn't variable.
LEAST_SHARE, MOST_WORDS = 0.3, 5


def masked(message: Column) -> Column:
    for pattern, mark in MASKS:
        message = F.regexp_replace(message, pattern, mark)
    return F.regexp_replace(message, DROPPED, "")


def templates(df: DataFrame, name: str, by: Sequence[str] = (), most_words: int = MOST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(by, masked, n, template): the template, and the rows, of every distinct masked message of each group.

    Distinct messages are counted first, so that repeated ones cost no more. A null message counts as empty.
    """
    keys = list(by)
    own = [col(k) for k in keys]
    message = df.select(*own, masked(F.coalesce(col(name), F.lit(""))).alias("masked")).groupBy(*keys, "masked").agg(F.count("*").alias("n"))
    words = message.select(*keys, "masked", "n", F.posexplode(F.split("masked", " ")).alias("at", "word"))
    often = words.groupBy(*keys, "at", "word").agg(F.sum("n").alias("often"))
    placed = words.join(often, [*keys, "at", "word"])
    row = placed.groupBy(*keys, "masked").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "word", "often"))).alias("words"))
    least = F.array_max(F.transform("words", lambda w: w["often"])) * least_share
    levels = F.transform(F.array_distinct(F.transform("words", lambda w: w["often"])), lambda f: F.struct(F.size(F.filter("words", lambda w: w["often"] == f)).alias("size"), f.alias("often")))
    best = F.array_max(F.filter(levels, lambda x: x["often"] >= least))["often"]
    row = row.withColumn("best", best)
    fixed = F.array_join(F.transform(F.filter("words", lambda w: w["often"] == F.col("best")), lambda w: F.concat_ws("\u0001", w["at"].cast("string"), w["word"])), "\u0002")
    row = row.withColumn("kind", F.sha2(F.concat_ws("\u0003", F.size("words").cast("string"), fixed), 256))
    part = row.select(*keys, "masked", "n", "kind", "best", F.explode("words").alias("w")).select(*keys, "masked", "n", "kind", (F.col("w.often") == F.col("best")).alias("fixed"), F.col("w.at").alias("at"), F.col("w.word").alias("word"))
    varied = part.where("NOT fixed").select(*keys, "kind", "at", "word").distinct().groupBy(*keys, "kind", "at").agg((F.count("*") > most_words).alias("variable"))
    shown = part.join(varied, [*keys, "kind", "at"], "left").withColumn("word", F.when(~F.col("fixed") & F.col("variable"), F.lit("<*>")).otherwise(F.col("word")))
    return shown.groupBy(*keys, "masked").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x")).select(*keys, "masked", "n", F.array_join(F.transform("x", lambda e: e["word"]), " ").alias("template"))


#: A masked message of so many rows is frequent: N rows have N / FREQUENT of them at most, which are broadcast.
FREQUENT = 10_000


def named(rows: DataFrame, found: DataFrame, by: Sequence[str], place: str) -> DataFrame:
    """``rows`` with the template in ``found`` of their masked message in ``place``, as __t."""
    found = found.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col("masked").alias("__masked"), F.col("template").alias("__t"))
    cond = F.col(place) == F.col("__masked")
    for i, k in enumerate(by):
        cond = cond & col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(F.broadcast(found) if place == "__m" else found, cond, "left").drop("__masked", *[f"__k{i}" for i in range(len(by))])


def label(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Every row with the template of its message as ``patterns_field``.

    Frequent messages take theirs from a broadcast table and are spread by number, so that no task gets all rows of one message.
    """
    found = templates(df, name, by)
    keyed = named(df.withColumn("__m", masked(F.coalesce(col(name), F.lit("")))), found.where(F.col("n") >= FREQUENT), by, "__m").withColumnRenamed("__t", "__often")
    spread = F.when(F.col("__often").isNull(), F.col("__m")).otherwise(F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string")))
    both = named(keyed.withColumn("__at", spread), found.where(F.col("n") < FREQUENT), by, "__at")
    return both.withColumn("patterns_field", F.coalesce("__often", "__t")).drop("__m", "__at", "__often", "__t")


def counted(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, patterns_field, pattern_count, sample_log).

    Rows are counted by masked message before templates are joined to them.
    """
    own = [col(k) for k in by]
    each = df.groupBy(*own, masked(F.coalesce(col(name), F.lit(""))).alias("__at")).agg(F.count("*").alias("__n"), F.min(col(name)).alias("__s"))
    return named(each, templates(df, name, by), by, "__at").groupBy(*own, F.col("__t").alias("patterns_field")).agg(F.sum("__n").alias("pattern_count"), F.min("__s").alias("sample_log"))
