"""Queries that run a stream over the present rows of a table; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.streaming import refs as R


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Published references, each once, counted by strategy. Keys are remembered for 120 days of event time behind the
    latest seen, which is longer than references are published again; the state holds no older key."""
    s = R.table_stream(spark, f"{d}/sample_refs.parquet").where("sample_id IS NOT NULL").select("sample_id", "strategy", "published_at")
    out = R.drain(R.once(s, "sample_id", "published_at", "120 days"), R.work_folder(spark, "dedup"))
    return out.groupBy("strategy").agg(F.count("*").alias("n"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of six hours by kind, aggregated by event time in the stream: an extension. A window is appended
    once the watermark has passed its end, so those that are open at the end of the drain aren't there yet."""
    instant = F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)")  # the table's times are UTC
    e = R.table_stream(spark, f"{d}/events.parquet").select(instant.alias("ts"), "event_type", "value")
    out = R.drain(R.windowed_counts(e, "ts", "event_type", "6 hours", "1 hour"), R.work_folder(spark, "windows"))
    return out.withColumn("start", F.expr("convert_timezone(current_timezone(), 'UTC', cast(start as timestamp_ntz))"))


def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """References committed by a stream to a ledger, acknowledged from the table, and reconciled."""
    folder = R.work_folder(spark, "ledger")
    ledger = R.Ledger(spark, folder)
    s = R.table_stream(spark, f"{d}/sample_refs.parquet").select("sample_id", "run_id", "strategy", "schema_version", "num_tokens", "estimated_bytes", "published_at")
    R.run_ledger(s, ledger, f"{folder}/state").awaitTermination()
    ledger.acknowledge(spark.read.parquet(f"{d}/acked.parquet"), 0)
    return ledger.outcomes().groupBy("outcome").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_dedup, stream_windows, stream_ledger)}

SQL = {
    "stream_dedup": "SELECT strategy, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY published_at) AS rn FROM sample_refs WHERE sample_id IS NOT NULL) WHERE rn = 1 GROUP BY strategy",
    "stream_windows": "WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2",
    "stream_ledger": "WITH r AS (SELECT DISTINCT sample_id FROM sample_refs WHERE sample_id IS NOT NULL), a AS (SELECT DISTINCT sample_id FROM acked WHERE sample_id IS NOT NULL) SELECT CASE WHEN r.sample_id IS NULL THEN 'unknown' WHEN a.sample_id IS NULL THEN 'requeued' ELSE 'released' END AS outcome, count(*) AS n FROM r FULL JOIN a ON r.sample_id = a.sample_id GROUP BY 1",
}
