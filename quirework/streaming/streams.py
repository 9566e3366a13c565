"""Structured Streaming forms of the time-based operators.

Each takes and gives a streaming frame; started with ``availableNow`` over a
finite folder it gives the rows of the batch operator.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirework.operators.steps import BAD, COOLDOWN
from quirework.sources.files import log_status


def log_lines(spark: SparkSession, folder: str, required: dict[str, str]) -> DataFrame:
    """Lines of log files as they arrive: ``(value, status)``."""
    return spark.readStream.text(folder).withColumn("status", log_status(F.col("value"), required))


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def error_windows(steps: DataFrame, length: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Failures per sliding window and step; rows later than ``late`` are dropped."""
    bad = steps.where(F.col("status").isin(*BAD)).withWatermark("ts", late)
    out = bad.groupBy(F.window("ts", length, slide).alias("w"), "step_name").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "step_name", "n")


def trend_buckets(steps: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Failures per tumbling bucket; buckets start at multiples of their length since 1970."""
    return error_windows(steps, length, length, late)


def distinct_facts(steps: DataFrame, late: str = "1 hour") -> DataFrame:
    """Repeated rows that arrive within ``late`` of each other count once."""
    return steps.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "seq", "step_name", "status"])


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after ``gap`` without an event (an extension)."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def matched(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of ``left(key, ts, ...)`` with those of ``right(key, other_ts, ...)`` of the same key at most ``within`` later (an extension).

    Both sides have a watermark, so state older than ``within`` and ``late``
    together is dropped.  The names of other columns must differ; null keys and
    times match nothing.
    """
    a = left.withWatermark("ts", late)
    b = right.withColumnRenamed(key, "__key").withWatermark("other_ts", late)
    near = (F.col("other_ts") >= F.col("ts")) & (F.col("other_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col("__key")) & near).drop("__key")


def threshold_alerts(metrics: DataFrame, value: Column, warning: float, critical: float) -> DataFrame:
    """Rows at or above a threshold, with ``severity`` and the channels that severity is sent to."""
    severity = F.when(value >= critical, "critical").when(value >= warning, "warning")
    channels = F.when(F.col("severity") == "critical", F.array(F.lit("email"), F.lit("webhook"))).otherwise(F.array(F.lit("webhook")))
    return metrics.withColumn("severity", severity).where("severity is not null").withColumn("channels", channels)


def cooled(alerts: DataFrame, cooldown: int = COOLDOWN, late: str = "1 hour") -> DataFrame:
    """``(key, seconds, message)`` of the alerts that are sent.

    The state of a key is the time of its last sent alert, one number; within a
    micro-batch its alerts are taken in order of time.  The state goes once the watermark,
    ``late`` behind the newest alert, has passed the cooldown; alerts older than
    the watermark are dropped.
    """

    def send(key, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["seconds", "message"])
        last = state.get[0] if state.exists else None
        kept = []
        for i, t in enumerate(rows["seconds"]):
            if last is None or t - last >= cooldown:
                kept.append(i)
                last = int(t)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + cooldown) * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[kept][["key", "seconds", "message"]]

    rows = alerts.select("key", "seconds", "message", F.timestamp_seconds("seconds").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(
        send, "key string, seconds long, message string", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there and stops; a rerun with the same checkpoint goes on where this ended."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
