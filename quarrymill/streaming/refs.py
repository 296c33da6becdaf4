"""Reference streams: channels, deduplication, a durable ledger, windowed dispatch and back-pressure.

A channel is a folder of JSON-line files; the file sink and the checkpoint make a publisher's batches whole. The
ledger is a folder of Parquet parts by batch id: a batch that is run again overwrites its own part, so commits and
acknowledgements are idempotent. State lives in Spark's state store, bounded by a watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrymill.session import shared_folder

REF = "sample_id STRING, run_id STRING, strategy STRING, schema_version INT, num_tokens INT, estimated_bytes BIGINT, published_at TIMESTAMP"


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's checkpoint and output below the cluster's shared folder (a local one in tests)."""
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


def publish(df: DataFrame, channel: str) -> None:
    """Appends references to a channel."""
    df.write.mode("append").json(channel)


def channel(spark: SparkSession, path: str, *, files_per_batch: int = 100) -> DataFrame:
    """References of a channel as a stream; complete files only."""
    return spark.readStream.schema(REF).option("maxFilesPerTrigger", files_per_batch).json(path)


def table_stream(spark: SparkSession, path: str, *, files_per_batch: int = 100) -> DataFrame:
    """A Parquet table (a file or a folder of files) as a stream of its present rows."""
    schema = spark.read.parquet(path).schema
    parent, name = path.rstrip("/").rsplit("/", 1)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", name).parquet(parent)


def once(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key once; keys are remembered for ``late`` of event time behind the latest seen."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, folder: str, *, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and gives what it wrote."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed_counts(events: DataFrame, at: str, kind: str, width: str, late: str) -> DataFrame:
    """(start, kind, n, total) in tumbling windows; rows behind the watermark are late and left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


class Ledger:
    """Committed and acknowledged ids in ``folder/committed`` and ``folder/acked``, one part a batch.

    A commit appends its batch and looks at no other: which delivery of an id counts is decided when the ledger is read
    (the one of the first batch), so a batch costs its own rows however long the stream has run."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _write(self, df: DataFrame, kind: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch_id}")

    def read(self, kind: str) -> DataFrame:
        """Each id once, as its first batch has it."""
        schema = REF if kind == "committed" else "sample_id STRING"
        try:
            rows = self.spark.read.schema(schema + ", batch INT").parquet(f"{self.folder}/{kind}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise
        if kind == "acked":
            return rows.select("sample_id").distinct()
        rest = [c for c in rows.columns if c not in ("sample_id", "batch")]
        return rows.groupBy("sample_id").agg(F.min_by(F.struct(*rest), "batch").alias("r")).select("sample_id", "r.*")

    def commit(self, refs: DataFrame, batch_id: int) -> None:
        """Records a batch of references, each once; the same batch gives the same part when it runs again."""
        self._write(refs.where("sample_id IS NOT NULL").dropDuplicates(["sample_id"]), "committed", batch_id)

    def acknowledge(self, acks: DataFrame, batch_id: int) -> None:
        self._write(acks.where("sample_id IS NOT NULL").select("sample_id").distinct(), "acked", batch_id)

    def outcomes(self) -> DataFrame:
        """After a restart: acknowledged references are released, the rest is queued again."""
        from quarrymill.operators.ledger import reconcile

        c = self.read("committed")
        return reconcile(c, self.read("acked"))


class ForgetfulLedger(Ledger):
    """Keeps nothing: everything is fresh on every start."""

    def _write(self, df: DataFrame, kind: str, batch_id: int) -> None:
        pass


class SessionLedger(Ledger):
    """Keeps its batches in views of the session: for tests and runs that needn't survive."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark, folder)
        self.held: dict[tuple[str, int], DataFrame] = {}

    def _write(self, df: DataFrame, kind: str, batch_id: int) -> None:
        self.held[kind, batch_id] = df.withColumn("batch", F.lit(batch_id))

    def read(self, kind: str) -> DataFrame:
        parts = [df for (k, _), df in sorted(self.held.items(), key=lambda x: x[0]) if k == kind]
        if not parts:
            return self.spark.createDataFrame([], REF if kind == "committed" else "sample_id STRING")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rest = [c for c in rows.columns if c not in ("sample_id", "batch")]
        return rows.groupBy("sample_id").agg(F.min_by(F.struct(*rest), "batch").alias("r")).select("sample_id", "r.*") if rest else rows.select("sample_id").distinct()


def run_ledger(refs: DataFrame, ledger: Ledger, checkpoint: str) -> StreamingQuery:
    """Commits a stream of references to a ledger, batch by batch."""
    return refs.writeStream.foreachBatch(ledger.commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_prefix(batches: list[DataFrame], channel: str, drop: Callable[[DataFrame], None]) -> int:
    """Publishes batches in order; at the first that fails, it and all behind it are handed to ``drop`` (their features
    have no reader) and the number that was published is given back."""
    for i, b in enumerate(batches):
        try:
            publish(b, channel)
        except Exception:
            for rest in batches[i:]:
                drop(rest)
            return i
    return len(batches)


def fixed_once(spark: SparkSession, path: str, value: int) -> int:
    """A setting that the first caller fixes: later callers (a resumed run) must ask for the same value, else it fails."""
    spark.range(1).select(F.lit(value).alias("value")).write.mode("ignore").parquet(path)
    there = spark.read.parquet(path).first().value
    if there != value:
        raise ValueError(f"{path} was fixed at {there}, not {value}")
    return there


LATCH = "run_id STRING, refs BIGINT, bytes BIGINT, paused BOOLEAN"


def pause_latch(events: DataFrame, *, high: int, low: int, high_bytes: int, low_bytes: int) -> DataFrame:
    """(run_id, refs, bytes, paused) after each batch of (run_id, at, refs, bytes) changes: paused at a high mark,
    resumed only when both depths are at or below their low marks. The state is three numbers a run, so it grows with
    the runs that ever were (a processing-time timeout would keep a drain from ending). Rows are summed by columns."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, b, paused = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        refs, size = n + rows["refs"].cumsum(), b + rows["bytes"].cumsum()
        up, down = (refs >= high) | (size >= high_bytes), (refs <= low) & (size <= low_bytes)
        crossed = up[up | down]
        paused = bool(crossed.iloc[-1]) if len(crossed) else bool(paused)
        n, b = int(refs.iloc[-1]), int(size.iloc[-1])
        state.update((n, b, paused))
        yield pd.DataFrame({"run_id": [key[0]], "refs": [n], "bytes": [b], "paused": [paused]})

    return events.groupBy("run_id").applyInPandasWithState(step, LATCH, "refs BIGINT, bytes BIGINT, paused BOOLEAN", "update", GroupStateTimeout.NoTimeout)


def enrich(df: DataFrame, client, schema: str, *, parallel: int) -> DataFrame:
    """Rows sent to a service by ``parallel`` tasks. ``client()`` gives a function of a pandas frame to a pandas frame
    of ``schema``; a row that it fails on comes back with its error, others go on."""

    columns = [f.split()[0] for f in schema.split(", ")]

    def plain(out: pd.DataFrame) -> pd.DataFrame:
        out = out.reindex(columns=columns).astype(object)
        return out.where(out.notna(), None)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for p in parts:
            try:
                yield plain(call(p))
            except Exception:
                for i in range(len(p)):
                    row = p.iloc[i : i + 1]
                    try:
                        yield plain(call(row))
                    except Exception as e:
                        yield plain(pd.DataFrame({"id": row["id"], "error": [f"{type(e).__name__}: {e}"]}))

    return df.repartition(parallel).mapInPandas(run, schema)
