"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution does the run-time sizing: it merges small shuffle
#: partitions, splits hot join partitions and broadcasts sides it has measured.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench.

    On a cluster the session comes from outside; nothing here is needed then.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quarterline")
    settings = {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions), **extra}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: rows of a batch that Python workers get, at most
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_ROWS`` rows for the session's Python workers, so that rows with whole texts or sets need little
    memory in the workers and in the executors' buffers; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    """Partition count for a placement that adaptive execution must not shrink.

    It sizes partitions by the bytes shuffled, which says little where each shuffled
    row unfolds into many.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staging_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that all executors share.

    ``spark.checkpoint.dir`` where the session names one, otherwise a folder in the warehouse. A warehouse on the
    machine's own disk serves a master on the same machine only; elsewhere it raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    own_disk = re.match(r"file:|/", warehouse) or ":" not in warehouse
    if own_disk and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_staged"


def _session_folder(spark: SparkSession) -> str:
    return f"{staging_folder(spark)}/quarterline-{spark.sparkContext.applicationId}"


def _at_exit(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def landing_place(spark: SparkSession) -> str:
    """A fresh path in the shared folder.

    What is written there goes when the session's JVM ends; ``release`` removes it earlier.
    """
    path = f"{_session_folder(spark)}/{uuid.uuid4().hex}"
    _at_exit(spark, path)
    return path


def land(df: DataFrame) -> str:
    """Write a table once to the shared folder as Parquet; its path (see ``landing_place``)."""
    path = landing_place(df.sparkSession)
    df.write.parquet(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table once to the shared folder and read it back.

    For tables that several later branches read: what lies before is computed one time,
    and a lost executor costs a re-read instead of a re-run. Parquet keeps reads
    narrow and tells the planner the real size.
    """
    return df.sparkSession.read.schema(df.schema).parquet(land(df))


#: catalog names of bucketed tables; the rest of the name is random
_BUCKETED = "quarterline_staged_"


def stage_bucketed(df: DataFrame, buckets: int, column: str, sort: Sequence[str] = ()) -> DataFrame:
    """``stage``, with rows of one ``column`` value in one bucket: what groups by it later needs no shuffle.

    Where rows already lie by that column, every task writes a bucket of its own. The table is in the session's catalog
    until ``release``; its files go with the others.
    """
    spark = df.sparkSession
    name = _BUCKETED + uuid.uuid4().hex
    path = landing_place(spark)
    writer = df.write.format("parquet").option("path", path).bucketBy(buckets, column)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Remove every table staged so far; only once no result that reads one is needed."""
    for table in spark.catalog.listTables(pattern=_BUCKETED + "*"):
        spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
