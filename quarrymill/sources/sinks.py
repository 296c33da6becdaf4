"""Writers. Spark's committer makes each write whole or absent; counts are taken while the rows are written."""

from __future__ import annotations

import io
import tarfile
import uuid

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def write_split(df: DataFrame, path: str, *, mode: str = "error") -> dict[str, int]:
    """Writes rows with a conversation as JSON lines; gives rows written, rows left out and messages skipped, counted
    in the same pass."""
    seen = Observation()
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counted = df.observe(seen, n(F.col("conversations").isNotNull()).alias("written"), n(F.col("conversations").isNull()).alias("left_out"), F.coalesce(F.sum(F.col("skipped").cast("long")), F.lit(0)).alias("skipped"))
    counted.where("conversations IS NOT NULL").drop("skipped").write.mode(mode).json(path)
    return dict(seen.get)


def write_train_test(df: DataFrame, path: str, *, overwrite: bool = False) -> str:
    """Writes rows by ``split`` below ``path``; an existing train part is kept and named unless ``overwrite``."""
    train = f"{path}/split=train"
    if _exists(df.sparkSession, train) and not overwrite:
        return train
    df.write.mode("overwrite").partitionBy("split").json(path)
    return train


def write_routes(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """Writes rows by ``sink`` (success, error, skipped, rejected) in one pass."""
    df.write.mode(mode).partitionBy("sink").json(path)


def write_buckets(df: DataFrame, path: str, index: str, size: int) -> None:
    """Writes rows in folders of ``size`` consecutive index values."""
    df.withColumn("bucket", F.floor(F.col(index) / F.lit(size)) * size).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_configs(df: DataFrame, path: str, config: str) -> None:
    """Writes one folder a configuration and leaves those of others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(config).parquet(path)


def finished_configs(spark: SparkSession, path: str, config: str, wanted: DataFrame) -> DataFrame:
    """Configurations whose written rows are as many as ``wanted(config, n)`` says."""
    if not _exists(spark, path):
        return wanted.limit(0)
    have = spark.read.parquet(path).groupBy(config).agg(F.count("*").alias("n"))
    return wanted.join(have, [config, "n"], "left_semi")


def missing_images(records: DataFrame, image: str, files: DataFrame) -> DataFrame:
    """(folder, n): pictures named by records that aren't among ``files(path)``, by folder."""
    named = records.where(F.col(image).isNotNull()).select(F.col(image).alias("path"))
    lost = named.join(files.select("path").distinct(), "path", "left_anti")
    return lost.groupBy(F.regexp_replace("path", r"/?[^/]*$", "").alias("folder")).agg(F.count("*").alias("n"))


def generation_dump(questions: DataFrame, stats: DataFrame, entropy: DataFrame, key: str | list[str], entropy_key: str | list[str] | None = None) -> DataFrame:
    """Questions with their request statistics and entropy, where there are any."""
    return questions.join(stats, key, "left").join(entropy, entropy_key or key, "left")


def metric_rows(run: str, step: Column, metrics: Column) -> list[Column]:
    """Columns (run, step, name, value) of a map of scalars, for a Parquet metrics sink."""
    return [F.lit(run).alias("run"), step.alias("step"), F.explode(metrics).alias("name", "value")]


def prompt_artifact(df: DataFrame, full: str, prompt: str) -> DataFrame:
    """Adds ``target``: what follows the prompt in the full text; fails where the text doesn't begin with it."""
    ok = F.col(full).startswith(F.col(prompt))
    return df.withColumn("target", F.when(ok, F.substring(F.col(full), F.length(prompt) + 1, F.lit(1 << 30))).otherwise(F.raise_error(F.lit("text doesn't begin with its prompt"))))


def write_archives(df: DataFrame, path: str, group: str, name: str, content: str) -> DataFrame:
    """Writes one tar archive ``<group>.tar`` a value of a bounded group, under another name first and moved when it is
    whole; gives (archive, n)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        system, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        system.create_dir(inner, recursive=True)
        part, whole = f"{inner}/.{key[0]}-{uuid.uuid4().hex}.part", f"{inner}/{key[0]}.tar"
        with system.open_output_stream(part) as raw, tarfile.open(fileobj=raw, mode="w|") as archive:
            for n, data in sorted(zip(rows[name], rows[content])):
                member = tarfile.TarInfo(n)
                member.size = len(data)
                archive.addfile(member, io.BytesIO(data))
        system.move(part, whole)
        return pd.DataFrame({"archive": [f"{key[0]}.tar"], "n": [len(rows)]})

    return df.groupBy(group).applyInPandas(run, "archive STRING, n BIGINT")


def latest_version(spark: SparkSession, path: str) -> str:
    """The folder of a table's last version."""
    n = 0
    while _exists(spark, f"{path}/v={n + 1}"):
        n += 1
    return f"{path}/v={n}"


def rewrite_paths(spark: SparkSession, path: str, column: str, old: str, new: str) -> str:
    """A table's next version with paths moved from one folder to another; the version before stays as the backup."""
    df = spark.read.parquet(latest_version(spark, path))
    moved = F.when(F.col(column).startswith(old.rstrip("/") + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(F.col(column), len(old.rstrip("/")) + 1, 1 << 30))).otherwise(F.col(column))
    return new_version(df.withColumn(column, moved), path)


def new_version(df: DataFrame, path: str) -> str:
    """Writes ``df`` as the next version ``v=<n>`` of a table and gives its folder; earlier versions stay."""
    spark = df.sparkSession
    n = 0
    while _exists(spark, f"{path}/v={n}"):
        n += 1
    df.write.parquet(f"{path}/v={n}")
    return f"{path}/v={n}"
