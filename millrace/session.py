"""Session helper and code shipping shared by all parts of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


#: Sizes of the batches that Python tasks read: rows may hold long texts, and a batch lies in the JVM's and the worker's memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for: UTC, AQE on, local shuffle width."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **BATCHES,
        "spark.ui.enabled": "false",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (file or folder) of a data directory, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application.

    Workers may start with another path than the driver, so the functions that tasks
    import by name travel as a zip through Spark's own file server. Batches for Python tasks shrink to BATCHES,
    unless the session has set sizes of its own.
    """
    for key, value in BATCHES.items():
        if spark.conf.get(key) in ("10000", "67108864b"):  # Spark's defaults
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    fd, path = tempfile.mkstemp(prefix="millrace-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, f"{ROOT.name}/{p.relative_to(ROOT)}")
    sc.addPyFile(path)
    sc._millrace_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary one on a local master; on a cluster, whose executors don't see
    the driver's disk, an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = tempfile.mkdtemp(prefix="millrace-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that ``materialize`` has written, newest last.
_MADE: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/millrace-" in folder:
            removed(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, all that ``materialize`` wrote in it: for results that were written or counted in it."""
    first = len(_MADE)
    try:
        yield
    finally:
        for folder in _MADE[first:]:
            removed(spark, folder)
        del _MADE[first:]
