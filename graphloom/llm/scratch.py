"""Shared scratch space, written where every executor can read it, and columns by their exact names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own setting to drop a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting of the bytes that go to or come from Python at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is made only where the setting is absent."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stash(df: DataFrame, label: str, *partition_by: str, batch_bytes: int | None = None, gather: bool = False) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and return a reader of it.

    This cuts lineage: a lost executor costs a re-read, never a recomputation.  The shuffle files of the write go when
    it has ended, since nothing reads them again.

    ``batch_bytes`` bounds the batches between the JVM and Python, which are held several times outside the heap.
    ``gather`` writes narrow rows that lie thin over many tasks in as few files as their size asks for.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if gather else df
    held = {CLEANUP: "true"} | ({BATCH: f"{batch_bytes}b"} if batch_bytes else {})
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = {key: spark.conf.get(key, None) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        writer.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def exact(name: str) -> Column:
    """The column of this very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def other_columns(df: DataFrame, *results: str) -> Sequence[str]:
    """The names of ``df``'s columns but those that, in any letter case, are names of results."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]


def numbered(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, called c0, c1, ...; Arrow functions take no names that need quoting."""
    return df.select(*[exact(c).alias(f"c{i}") for i, c in enumerate(names)])
