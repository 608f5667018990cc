"""Job state, timers, progress, log tails and request volumes as streams with batch twins."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versemill.plans.ordered import top_rows
from versemill.session import ensure_checkpoint_dir


def read_event_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Files of one table in a folder as a stream, with the schema of the stored table."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def drain(stream: DataFrame, mode: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Run a stream over all available input into the shared folder and read the result back.

    Every micro-batch is written under its batch number, so a batch that is
    run again after a failure replaces its own output. For ``update`` mode the
    latest row per key is returned.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    result = spark.read.schema(schema).parquet(out)
    if keys is None:
        return result.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return (
        result.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col("batch")).alias("__r"))
        .select(*keys, "__r.*")
    )


def latest_status(events: DataFrame, job: str, status: str, order: Sequence[str]) -> DataFrame:
    """Latest status per job; works on a table and, in update mode, on a stream."""
    return events.groupBy(job).agg(F.max_by(F.col(status), F.struct(*order)).alias(status))


def after_restart(states: DataFrame, status: str, running: Sequence[str]) -> DataFrame:
    """Jobs found running after a restart were interrupted."""
    return states.withColumn(status, F.when(F.col(status).isin(*running), "error").otherwise(F.col(status)))


def status_counts(states: DataFrame, status: str) -> DataFrame:
    return states.groupBy(status).agg(F.count("*").alias("n"))


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Sessions by last use: a session expires ``gap`` after its last event."""
    return events.groupBy(F.session_window(F.col(ts), gap).alias("w"), F.col(key)).agg(
        F.count("*").alias("n_events")
    ).select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("expires"), "n_events")


def stage_progress(running: DataFrame, factors: DataFrame, by: Sequence[str], real: Column, elapsed: Column, score: Column) -> DataFrame:
    """Percent done: the reported one, else elapsed over estimate, at most 99.

    ``factors`` (by, factor) is static; ``running`` may be a stream.
    """
    estimate = score * F.coalesce(F.col("factor"), F.lit(1.0))
    guess = F.least(F.lit(99.0), F.lit(100.0) * elapsed / estimate)
    return running.join(factors, list(by), "left").withColumn(
        "percent", F.coalesce(real, F.when(estimate > 0, guess).otherwise(F.lit(0.0)))
    )


def log_tail(log: DataFrame, job: str, newest: Sequence[Column], lines: int = 200) -> DataFrame:
    """Last lines of each job."""
    return top_rows(log, [job], newest, lines)


def request_volume(events: DataFrame, ts: str, width: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """Requests per tumbling window and key; on a stream ``late`` sets the watermark."""
    source = events.withWatermark(ts, late) if late else events
    return source.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), *keys, "n"
    )


def suppress_duplicates(events: DataFrame, ts: str, keys: Sequence[str], horizon: str) -> DataFrame:
    """First request per key within the horizon (stream only)."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(list(keys))
