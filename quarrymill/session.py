"""Session, table and lineage helpers shared by every layer."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "12g", app: str = "quarrymill") -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def tables(spark: SparkSession, directory: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, directory, n) for n in names)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name in the cluster's shared folder (``spark.checkpoint.dir``). Only where that is unset and the
    master is local (tests, notebooks) a folder of this machine is taken; a cluster without the setting is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "quarrymill")
    return f"{shared.rstrip('/')}/{name}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back; the files survive the loss of any executor.

    Spark deletes them with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; ``release``
    deletes them at once."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark, "checkpoint"))
    return df.checkpoint(eager)


def release(df: DataFrame) -> None:
    """Deletes the files of a frame made by ``cut_lineage`` that nothing reads any more."""
    jvm, plan = df.sparkSession._jvm, df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
