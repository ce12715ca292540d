"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Spark's own setting to drop a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Graphs, kinds and the beginnings of IRIs repeat, so rows of derived tables take some fifty times the room of their files:
#: sizes are estimated, and scans divided, by what the rows take.
PACKED = 50
SPLIT_BYTES = 4 << 20
#: What a task reads of a shuffle, about: its rows take some twenty times that in memory.  Of a hub's partition, beyond the
#: second number, several tasks read a part each.
SHARE_BYTES, HUB_BYTES = 4 << 20, 16 << 20
#: Rows of a file: a task reads at least one whole, whatever made it.
FILE_ROWS = 200_000
#: Up to this many best rows of a group, every task cuts its own rows before they meet.
GROUP_LIMIT = 20_000
#: Rows of the source tables for each partition of a shuffle; Spark joins small partitions again while it runs.
DEALT_ROWS = 200_000
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_VIEWS: dict[tuple[str, str], tuple[str, StructType]] = {}
#: The setting before the first of the current writers, then an entry for each of them.
_WRITERS: list[str | None] = []
_LOCK = Lock()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; a local folder serves only where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/graphloom/{label}-{uuid.uuid4().hex}"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when their query has ended; the setting is put back when the last of several writers is done."""
    with _LOCK:
        if not _WRITERS:
            _WRITERS.append(spark.conf.get(CLEANUP, None))
            spark.conf.set(CLEANUP, "true")
        _WRITERS.append(None)
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS.pop()
            if len(_WRITERS) == 1:
                before = _WRITERS.pop()
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _write(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write a table; nothing reads the shuffle files of the write again."""
    with _cleaning(df.sparkSession):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*partition_by).parquet(path)


def reckon(spark: SparkSession) -> None:
    """Spark's own settings, so that no table is broadcast for the smallness of its files, and a task reads rows that it can hold.

    A join with a table that is small in truth is still made a broadcast one while it runs.
    """
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < PACKED:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", PACKED)
    if _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) > SPLIT_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)
    for setting, most in (("advisoryPartitionSizeInBytes", SHARE_BYTES), ("skewJoin.skewedPartitionThresholdInBytes", HUB_BYTES)):
        if _bytes(spark.conf.get(f"spark.sql.adaptive.{setting}")) > most:
            spark.conf.set(f"spark.sql.adaptive.{setting}", most)
    if int(spark.conf.get("spark.sql.window.group.limit.threshold", "1000")) < GROUP_LIMIT:
        spark.conf.set("spark.sql.window.group.limit.threshold", GROUP_LIMIT)


def deal(spark: SparkSession, rows: int) -> None:
    """Shuffles begin with partitions in proportion to the rows of the source tables, so that what a task holds does not grow."""
    now = int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if rows // DEALT_ROWS > now:
        spark.conf.set(INITIAL, rows // DEALT_ROWS)


def _bytes(text: str) -> int:
    """A size as Spark writes it: a number, with or without a unit."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    reckon(spark)
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write and read again: later steps start from files that survive a lost executor."""
    path = shared_path(df.sparkSession, label)
    _write(df, path)
    return _read(df.sparkSession, path, df.schema)


def view(spark: SparkSession, key: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
    """A derived table that an application writes once and then reads: the library's triples and what follows from them.

    The tables of a folder are taken as unchanging while an application runs; ``forget`` makes it look again.
    """
    name = (spark.sparkContext.applicationId, key)
    if name in _VIEWS:
        try:
            path, schema = _VIEWS[name]
            return _read(spark, path, schema)
        except AnalysisException:  # the files are gone: write them anew
            pass
    path = shared_path(spark, "view")
    reckon(spark)
    built = build()
    _write(built, path, *partition_by)
    _VIEWS[name] = path, built.schema
    return _read(spark, path, built.schema)


def has_view(spark: SparkSession, key: str) -> bool:
    """Whether this application has written the table."""
    return (spark.sparkContext.applicationId, key) in _VIEWS


def forget() -> None:
    """Derived tables are written anew when next asked for, for folders whose tables have been rewritten."""
    _VIEWS.clear()
