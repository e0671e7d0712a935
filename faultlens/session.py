"""Session set-up and the two places where a plan is cut: the shared folder and small tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows counts as small. Tables above it are never broadcast by hint.
SMALL_ROWS = 10_000

_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Wide feature rows compress well but cost much to compute: do not merge them into few tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Bytes of rows that are handed to a task's Python process at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
}

#: For the chains over rows of many columns. The JVM compiles no method of more than 8,000 bytes, so a longer generated loop would be
#: interpreted; such a plan is split into small functions instead. Partitions are small and there are enough of them, as the rows
#: unpack to many times their size in the shuffle; AQE joins those that turn out smaller.
_WIDE = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
}

#: Folders that ``stage`` wrote in this process and ``unstage`` has not removed, oldest first.
_staged: list[str] = []


def build_session(app: str = "faultlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on. A cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Without call sites in error messages, building a wide plan takes a fraction of the time.
    for key, value in {**_REQUIRED, "spark.python.sql.dataFrameDebugging.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession, wide: bool = False) -> SparkSession:
    """Put a running session into the state that the operators expect; ``wide`` adds the settings for rows of many columns.

    Times are UTC wall clock in all results, so the time zone is always set; other settings stay where the session has them.
    """
    given = spark.conf.getAll
    for key, value in (_REQUIRED | _WIDE if wide else _REQUIRED).items():
        if key == "spark.sql.session.timeZone" or key not in given:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach, from ``spark.checkpoint.dir``.

    Where the setting is absent, a session on one machine makes a new folder once and keeps it; on a cluster, whose
    machines would each write to their own disk, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master!r} reach")
        folder = tempfile.mkdtemp(prefix="faultlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate table to the shared folder and go on from its files.

    Used where the same rows feed several passes: later passes read only the columns they need instead of
    repeating the joins before them, and a lost executor costs only its own tasks.
    """
    path = new_folder(df.sparkSession, name)
    _staged.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def staged() -> list[str]:
    """Folders of the staged tables that still exist, oldest first."""
    return list(_staged)


def unstage(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Remove staged tables, given as what ``stage`` returned or by folder, once nothing reads them any more."""
    for table in tables:
        path = table if isinstance(table, str) else table.staged_at
        if path in _staged:
            _staged.remove(path)
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def attach(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left", limit: int = SMALL_ROWS) -> DataFrame:
    """Join a table that is expected to be small.

    The table is evaluated once, up to ``limit`` rows. If it ends there, its rows are broadcast; if it is
    longer, a shuffle join is planned instead, whose hot keys adaptive execution splits.
    """
    head = dim.limit(limit + 1).toArrow()
    if head.num_rows > limit:
        return df.join(dim, on, how)
    return df.join(F.broadcast(df.sparkSession.createDataFrame(head, schema=dim.schema)), on, how)


def spread(df: DataFrame) -> DataFrame:
    """Share out rows of few large unsplittable inputs before costly parsing; many inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
