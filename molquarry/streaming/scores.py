"""Streams: scored and appended once whatever is replayed, and windowed counts under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from molquarry.operators.scoring import Scorer, score_table
from molquarry.sources.sinks import append_new


def score_stream(stream: DataFrame, key: str, col: str, scorers: dict[str, Scorer], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is scored and appended to a parquet table; keys that are stored already are left out, so a
    batch that is replayed after a failure adds nothing twice."""

    def store(batch: DataFrame, _: int) -> None:
        append_new(score_table(batch.dropDuplicates([key]), col, scorers, keep=[key]), out, key)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(df: DataFrame, time: str, kind: str, length: str = "1 day", late: str = "7 days") -> DataFrame:
    """window_start, kind, n, mean: works on tables and, under a watermark, on streams."""
    own = df.withWatermark(time, late) if df.isStreaming else df
    got = own.groupBy(F.window(time, length), kind).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return got.select(F.col("window.start").alias("window_start"), kind, "n", "mean")


def sliding_counts(df: DataFrame, time: str, kind: str, value: str, length: str = "2 days", step: str = "1 day", late: str = "7 days") -> DataFrame:
    """window_start, kind, n, mean of windows of a length that begin every step; tables, or streams under a watermark."""
    own = df.withWatermark(time, late) if df.isStreaming else df
    got = own.groupBy(F.window(time, length, step), kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return got.select(F.col("window.start").alias("window_start"), kind, "n", "mean")


def sessions(df: DataFrame, time: str, key: str, gap: str = "1 hour", late: str = "7 days") -> DataFrame:
    """key, session_start, session_end, n: rows of a key that follow each other within the gap; the end is the last time plus the gap."""
    own = df.withWatermark(time, late) if df.isStreaming else df
    got = own.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def late_rows(df: DataFrame, time: str, arrival: str, late: str = "7 days") -> DataFrame:
    """Rows that arrived so long after the fact that a watermark of `late` may leave them out: to be counted, or added by a batch."""
    return df.filter(F.col(arrival) > F.col(time) + F.expr(f"interval {late}"))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
