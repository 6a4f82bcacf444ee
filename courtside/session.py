"""Session settings and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """A local session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("courtside")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", os.environ.get("COURTSIDE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_table(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A local relation: Spark knows its size, so joins with it are planned as broadcasts."""
    def text(v, kind):
        cast = kind.simpleString()
        if v is None:
            return f"CAST(NULL AS {cast})"
        quoted = str(v).replace("\\", "\\\\").replace("'", "\\'")
        return f"CAST('{quoted}' AS {cast})"
    kinds = [f.dataType for f in schema.fields]
    values = ", ".join("(" + ", ".join(text(v, k) for v, k in zip(row, kinds)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(f'`{n}`' for n in schema.names)})")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, set here only when unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="courtside-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a frame once to the shared folder and go on from the written table.

    Later stages no longer depend on the lineage (a lost executor rereads files), the table is
    columnar, its size is known to the planner, and ``partition_by`` columns are pruned on reading.
    What the write shuffled is removed with its end; else it stays until the driver's memory is next cleared.
    """
    path = scratch_path(df.sparkSession, "table")
    before = df.sparkSession.conf.get(_CLEANUP, "false")
    df.sparkSession.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        df.sparkSession.conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = path
    return out


_WRITTEN: dict[int, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def forget(df: DataFrame) -> None:
    """Remove the files of a frame made by ``cut`` that no later step reads; does nothing for any other frame."""
    path = _WRITTEN.pop(id(df), None)
    if path:
        remove(df.sparkSession, path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    target, system = _file_system(spark, path)
    system.delete(target, True)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the tasks' own file system has it; None if the folder is not mounted there."""
    target, system = _file_system(spark, path)
    return target.toUri().getPath() if system.getScheme() == "file" else None


def slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time and wait for each other; 0 if executors come and go."""
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())
