"""Session settings shared by tests, bench and batch jobs."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any scale. Partition counts are left to the cluster and to AQE, which
# coalesces small shuffle partitions and splits the skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Settings every plan relies on, applied to whatever session runs it. HotSpot never compiles a method
# over 8000 bytes, so a fused stage larger than that runs in the bytecode interpreter; past this limit
# Spark emits one compiled projection per operator instead.
PER_QUERY = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

#: Whether the shuffle files of a query are deleted when it ends; nothing reads those of a written table again.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "gridloom", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session clock to UTC; every stamp in the engine is UTC unless named local."""
    for key, value in PER_QUERY.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``; without it a cluster session is refused, since a folder
    of one machine's own would hold only part of a table. A session on one machine (tests, a laptop) may leave
    it unset: a folder of its own is then taken, recorded in the session and removed when Python ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.abspath(f"spark-warehouse/.gridloom-{uuid.uuid4().hex}")
        os.makedirs(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(frame: DataFrame, by: str | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts lineage like a checkpoint, but computes the frame once, keeps it columnar with statistics,
    and survives lost executors. With ``by`` the table is bucketed by that column, one bucket a shuffle partition,
    so joins on the column leave its rows where they are. ``clear_materialised`` deletes what a session has
    written; a session that is still alive when Python ends does so by itself. Shuffle files of the write go with
    its end, not when the JVM next collects them.
    """
    spark, name = frame.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark)}/tables/{name}"
    keep_until_end(path)
    if by is None:
        before = spark.conf.get(SHUFFLE_CLEANUP, "false")
        spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            frame.write.parquet(path)
        finally:
            spark.conf.set(SHUFFLE_CLEANUP, before)
        table = spark.read.schema(frame.schema).parquet(path)
        table._written = path
        return table
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.repartition(n, by).write.bucketBy(n, by).option("path", path).saveAsTable(f"written_{name}")
    return spark.table(f"written_{name}")


def keep_until_end(path: str) -> None:
    """Let a folder be deleted with the written tables."""
    if not _WRITTEN:
        atexit.register(_clear_at_exit)
    _WRITTEN.append(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more; other frames are left alone."""
    path = getattr(table, "_written", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_WRITTEN: list[str] = []


def clear_materialised(spark: SparkSession) -> int:
    """Delete the tables written so far; frames that read them end with it. Returns how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return n


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clear_materialised(spark)
