"""A training corpus from raw documents: five stages, each written and read again by the next.

toxicity: documents that the network rejects go.
near_duplicates: of each component of near-duplicate rows one with the least doc_id stays.
repeated_passages: passages of 50 bytes and more that stand in an earlier document are cut out.
decontamination: documents with a window of a benchmark item go.
packing: the rest becomes sequences of 4096 tokens.

The filtering stages return whole rows of ``documents``. repeated_passages changes text and n_chars; where a cut splits a
character, its remaining bytes go too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, pack, suffix_dedup, toxicity
from millrace.llm.common import carried, materialize, shared_dir
from millrace.llm.queries import vocabulary_path
from millrace.session import scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the network scores 0.5 or more go; repeated rows go or stay together, a null text is scored like an empty one.

    All rows stay where the labels are too few, or of one kind, to learn from.
    """
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    if model.constant is not None:
        return docs
    return toxicity.scored(docs, model, keep=tuple(docs.columns)).where("predicted = 0").select(*carried(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays, of the least doc_id (null last); rows without words stay.

    Rows, not ids, are told apart, by their file and place in it, so ``docs`` must be read from Parquet.
    """
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    files = spark.createDataFrame(list(enumerate(paths)), "__file long, __path string")
    placed = docs.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
    keyed = placed.join(F.broadcast(files), "__path").withColumn("__row", F.col("__file") * (1 << 40) + F.col("__at"))  # a row for each file
    found = jaccard.near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text"))
    found = materialize(found.where("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id"), "near")
    several = found.where("component_id <> __row").select("component_id").distinct()
    members = materialize(found.join(several, "component_id").join(keyed.select("__row", "doc_id"), "__row"), "members")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")).alias("best")).select("best.__row")
    gone = members.select("__row").join(best, "__row", "left_anti")
    return keyed.join(gone, "__row", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that lose nothing keep their text as it was, null too; emptied documents stay, empty."""
    found = suffix_dedup.without_repeats(docs, as_text=True, keep=tuple(docs.columns))
    cut = F.size("spans") > 0
    changed = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(cut, F.char_length("kept")).otherwise(F.col("rest.n_chars")).cast("long")}
    return found.select(*[changed[c].alias(c) if c in changed else F.col("rest")[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of a benchmark item go; a null or empty text has none and stays; an empty benchmark drops nothing."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns)).where("size(spans) = 0").select(*carried(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a row's text: every row has one at least, an empty or null text the one id that ends a document."""
    return pack.digest(pack.pack(docs, vocabulary_path()))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No SQL: the network and the tokenizer can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again.

    What a stage wrote for itself goes when it has ended. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/millrace-pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
