"""Reading tables and writing results."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.combine import union
from millrace.session import table


def source(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """One or several tables as one, by name."""
    return table(spark, sf_dir, names[0]) if len(names) == 1 else union(*[table(spark, sf_dir, n) for n in names])


def describe(df: DataFrame) -> DataFrame:
    """Columns with their types and places."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, k + 1) for k, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "column_name string, type_name string, nullable boolean, ordinal_position int")


def makeresults(spark: SparkSession, count: int = 1, data: str | None = None, form: str = "json") -> DataFrame:
    """Rows made up: ``count`` times the present time, or what ``data`` spells out as JSON rows or as CSV with a header."""
    if data is not None:
        lines = [x for x in data.strip().splitlines() if x.strip()]
        if form == "csv":
            found = list(csv.reader(lines))
            return spark.createDataFrame([[x if x != "" else None for x in r] for r in found[1:]], T.StructType([T.StructField(n, T.StringType()) for n in found[0]]))
        rows = json.loads(data) if data.lstrip().startswith("[") else [json.loads(x) for x in lines]
        return spark.createDataFrame(rows)
    if count > 5000:
        raise ValueError("at most 5000 rows")
    return spark.range(max(0, count)).select(F.current_timestamp().alias("@timestamp"))


def show_tables(spark: SparkSession, like: str = "%") -> DataFrame:
    """The session's tables and views whose names are LIKE a pattern."""
    return spark.sql("SHOW TABLES").where(F.col("tableName").like(like)).select(F.col("tableName").alias("TABLE_NAME"), F.when(F.col("isTemporary"), "VIEW").otherwise("BASE TABLE").alias("TABLE_TYPE"))


def describe_tables(spark: SparkSession, like: str = "%", columns: str = "%") -> DataFrame:
    """The columns LIKE a pattern of the session's tables LIKE a pattern."""
    names = [r[0] for r in show_tables(spark, like).select("TABLE_NAME").collect()]
    rows = [(n, f.name, f.dataType.simpleString(), k + 1) for n in names for k, f in enumerate(spark.table(n).schema)]
    return spark.createDataFrame(rows, "TABLE_NAME string, COLUMN_NAME string, TYPE_NAME string, ORDINAL_POSITION int").where(F.col("COLUMN_NAME").like(columns))


def nearest(df: DataFrame, vector: Sequence[float], k: int, name: str = "embedding", metric: str = "l2") -> DataFrame:
    """The k rows nearest to a vector by exact distance, best ``_score`` first."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    own = F.transform(F.col(name), lambda x: x.cast("double"))
    if metric == "l2":
        score = 1 / (1 + F.aggregate(F.zip_with(own, query, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    else:
        dot = F.aggregate(F.zip_with(own, query, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x * x)) * F.lit(sum(x * x for x in vector) ** 0.5)
        score = (1 + dot / norm) / 2
    return df.withColumn("_score", score).orderBy(F.col("_score").desc()).limit(k)


def pages_of(df: DataFrame, size: int) -> Iterator[list]:
    """A result in pages, fetched part by part."""
    page: list = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def formatted(df: DataFrame, kind: str = "jdbc", most: int = 10_000) -> str:
    """The first ``most`` rows as text: jdbc (schema and rows in JSON), csv, raw (pipes) or json.

    jdbc tells the size of what it holds, and ``total``, the rows of the whole result, counted where there are more.
    """
    rows = df.limit(most + 1).collect()
    total, rows = (df.count() if len(rows) > most else len(rows)), rows[:most]
    if kind == "jdbc":
        schema = [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]
        return json.dumps({"schema": schema, "datarows": [list(r) for r in rows], "total": total, "size": len(rows)}, default=str)
    if kind == "json":
        return "\n".join(json.dumps(r.asDict(True), default=str) for r in rows)
    out = io.StringIO()
    w = csv.writer(out, delimiter="|" if kind == "raw" else ",", lineterminator="\n")
    w.writerow(df.columns)
    w.writerows(["" if x is None else x for x in r] for r in rows)
    return out.getvalue()
