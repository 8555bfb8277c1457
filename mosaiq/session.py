"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What was written in each application's folder.
_FOLDERS: dict[str, list[str]] = {}


def build_session(app: str = "mosaiq", master: str | None = None, partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A session with the settings the engine is planned for (AQE, UTC, Arrow). shared: a folder that all executors see,
    for what is written on the way; a cluster needs one unless its own configuration names it."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application that all executors share, under spark.checkpoint.dir; it goes when the application
    ends. Where that is unset a local session gets a temporary one; on a cluster, whose machines would each have a
    folder of their own, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mosaiq-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    own = f"{folder.rstrip('/')}/mosaiq-{spark.sparkContext.applicationId}"
    if own not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS[own] = []
    return own


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again.

    The copy outlives executors, and its size on disk is what later joins plan with.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _FOLDERS[folder].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """written(df), after which all that was written before it is deleted: for steps of which nothing earlier is read again."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    out = written(df)
    old, _FOLDERS[folder] = _FOLDERS[folder][:-1], _FOLDERS[folder][-1:]
    for x in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def spread(table: DataFrame) -> DataFrame:
    """A table that is read from files, in as many partitions as there are cores where its files give fewer, so that work
    on rows that is heavy on the processor is spread. Of a table with splits enough nothing is moved."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table._jdf.queryExecution().toRdd().getNumPartitions() >= cores else table.repartition(cores)
