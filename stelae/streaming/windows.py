"""Event-time windows with watermarks, deduplication with a lifetime, resumable runs; each has a batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's zone is taken (UTC)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(df: DataFrame, keys: list[str], width: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """(keys, window_start, n): the rate of each key in windows that do not overlap. ``late`` is the watermark of a stream;
    what comes later is dropped, and a window is emitted once the watermark has passed it (append mode)."""
    src = df.withWatermark(ts, late) if late and df.isStreaming else df
    out = src.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("window.start").alias("window_start"), "n")


def sliding_counts(df: DataFrame, keys: list[str], width: str, slide: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    src = df.withWatermark(ts, late) if late and df.isStreaming else df
    out = src.groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("window.start").alias("window_start"), "n")


def sessions(df: DataFrame, keys: list[str], gap: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """(keys, session_start, session_end, n): a session ends after ``gap`` without events."""
    src = df.withWatermark(ts, late) if late and df.isStreaming else df
    out = src.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def over_limit(counts: DataFrame, most: int) -> DataFrame:
    """Windows that a rate limit of ``most`` would refuse."""
    return counts.where(F.col("n") > most)


def first_in_lifetime(df: DataFrame, keys: list[str], lifetime: str, ts: str = "ts") -> DataFrame:
    """A stream without repeats of a key within the lifetime; state older than the watermark is forgotten."""
    return df.withWatermark(ts, lifetime).dropDuplicatesWithinWatermark(keys)


def first_per_key(df: DataFrame, keys: list[str], id_col: str, ts: str = "ts") -> DataFrame:
    """The batch twin: the first event of each key; ties by id."""
    first = df.groupBy(*keys).agg(F.min_by(id_col, F.struct(ts, id_col)).alias(id_col))
    return first.select(id_col, *keys)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; the checkpoint remembers it, so a later run goes on from there."""
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to its own folder, so that a replayed batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
