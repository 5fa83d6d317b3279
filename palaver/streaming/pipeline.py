"""Streams of events, phrases and job messages: windows, sessions, deduplication, latest state, stale results, timeouts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palaver.session import shared_dir


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the parquet files of a folder, or over a single file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it put out, as a table in the shared folder.

    Appended rows are written by the file sink. Updates go through foreachBatch, each batch into a folder of its number, so that a batch that is repeated after a
    failure replaces itself; the result then holds every update with its batch."""
    spark = stream.sparkSession
    out, checkpoint = shared_dir(spark), shared_dir(spark)
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per event-time window and key; rows later than the watermark are dropped."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def event_sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key by event time: start, end and number of events."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(messages: DataFrame, keys: list[str], ts: str, within: str = "1 day") -> DataFrame:
    """Each key once, although messages come at least once; state is kept as long as the watermark asks."""
    return messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def latest_status(messages: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The latest value of every key so far (update mode)."""
    return messages.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def current_results(results: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """results with stale: whether their generation is not the last one requested for their key.

    results: key, generation, ...; requests: key, generation, requestedAt. A result of a key without a request is stale."""
    last = requests.groupBy(key).agg(F.max_by("generation", "requestedAt").alias("_g"))
    return results.join(last, key, "left").withColumn("stale", F.coalesce(F.col("_g") != F.col("generation"), F.lit(True))).drop("_g")


def with_timeouts(messages: DataFrame, key: str, ts: str, stage: str, done: str, limit_ms: int) -> DataFrame:
    """key, status, at: `done` when a key's closing stage arrives, `timeout` when event time passes limit_ms after its first message without it.

    messages carry a watermark on ts. Per key only its first time and outcome are kept; a key is reported once."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, over = state.get
            state.remove()
            if not over:
                yield pd.DataFrame([(k[0], "timeout", first + limit_ms)], columns=["key", "status", "at"])
            return
        first, over = state.get if state.exists else (None, False)
        for b in batches:
            at = (b[ts].astype("int64") // (10**6 if str(b[ts].dtype).endswith("[ns]") else 10**3)).astype("int64")
            for t, s in sorted(zip(at, b[stage], strict=True)):
                first = int(t) if first is None else min(first, int(t))
                if s == done and not over:
                    over = True
                    yield pd.DataFrame([(k[0], "done", int(t))], columns=["key", "status", "at"])
        state.update((first, over))
        state.setTimeoutTimestamp(max(first + limit_ms, state.getCurrentWatermarkMs() + 1))

    return messages.groupBy(key).applyInPandasWithState(step, "key string, status string, at long", "first long, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def routed(messages: DataFrame, good: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) messages by a condition; null counts as bad."""
    ok = F.coalesce(F.expr(good), F.lit(False))
    return messages.where(ok), messages.where(~ok)


def in_chunks(work: DataFrame, key: list[str], done: DataFrame) -> DataFrame:
    """The chunks of a job that aren't done yet: a run that was cut off goes on where it was, as every chunk's row is written by its key."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def for_each_batch(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each micro-batch to an idempotent sink, keyed by the batch number, until all that is there is done."""
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
