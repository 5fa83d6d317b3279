"""Streaming queries run to the end of their input, and the SQL of the same over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.session import shared_dir, table
from palaver.streaming import pipeline


PARTS, FILES = 4, 4
#: Repeated phrases come within five days of the first.
WITHIN = "7 days"


def _replayed(spark: SparkSession, d: str, name: str, ts: str) -> DataFrame:
    """A table as a stream in the order of a time: written in parts that follow each other, each of as many files as one batch takes. Rows without the time come first."""
    t = table(spark, d, name)
    low, high = t.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))), F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
    step = max(1, ((high or 0) - (low or 0)) // PARTS + 1)
    part = F.coalesce(F.least(F.lit(PARTS - 1), F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(low or 0)) / step)), F.lit(0))
    to = shared_dir(spark)
    for i in range(PARTS):
        t.where(part == i).repartition(FILES).write.mode("append").parquet(to)
    return pipeline.parquet_stream(spark, to, FILES)


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts per event type, as updates; the last update of a window is its result."""
    s = pipeline.windowed_counts(_replayed(spark, d, "events", "ts"), "ts", "event_type", "value", late="1 hour")
    got = pipeline.run_once(s, "update").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return got.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", F.col("r.n").alias("n"), F.round("r.total", 4).alias("total"))


def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of a meeting's stream, each once."""
    p = _replayed(spark, d, "phrases", "arrivedAt").select("meeting_id", "pos", "text", "arrivedAt")
    return pipeline.run_once(pipeline.deduplicated(p, ["meeting_id", "pos"], "arrivedAt", WITHIN).select("meeting_id", "pos", "text"))


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last known status of every meeting."""
    m = pipeline.parquet_stream(spark, f"{d}/meetings.parquet").select("id", "updatedAt", "status")
    got = pipeline.run_once(pipeline.latest_status(m, "id", "updatedAt", "status"), "update")
    return got.groupBy("id").agg(F.max_by("status", "batch").alias("status"))


def stale_results(spark: SparkSession, d: str) -> DataFrame:
    """Saves of meetings that a later save has overtaken."""
    m = table(spark, d, "meetings").select("id", F.col("updatedAt").cast("string").alias("generation"), "updatedAt").distinct()
    return pipeline.current_results(m.select("id", "generation"), m.withColumnRenamed("updatedAt", "requestedAt")).select("id", "generation", "stale")


QUERIES = {"stream_windows": stream_windows, "stream_deduplicated": stream_deduplicated, "stream_latest": stream_latest, "stale_results": stale_results}
SQL = {
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2",
    "stream_deduplicated": "SELECT meeting_id, pos, min(text) AS text FROM phrases GROUP BY 1, 2",
    "stream_latest": "SELECT id, arg_max(status, updatedAt) status FROM meetings GROUP BY 1",
    "stale_results": "SELECT id, CAST(updatedAt AS VARCHAR) generation, updatedAt <> max(updatedAt) OVER (PARTITION BY id) stale FROM (SELECT DISTINCT id, updatedAt FROM meetings)",
}
