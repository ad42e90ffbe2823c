"""Incremental refresh and event-time windows with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.diffing import stale
from ..sources.tables import has_rows, write_by


def refresh(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str], version: str, by: str, order: str | None = None) -> StreamingQuery:
    """Take in what is new under ``source`` and stop: rows of a version that the target has already are skipped.

    A new version replaces all rows that the target has of its key, as an overlay of a pull request is written anew when
    its head moves. Where a batch brings several versions of a key, the one with the greatest ``order`` (or ``version``)
    counts. Each folder of the target that new rows belong to is written anew with its other rows, so a batch that is run
    again after a failure changes nothing.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        there = spark.read.schema(batch.schema).parquet(target) if has_rows(spark, target) else batch.limit(0)
        last = batch.groupBy(*key).agg(F.max_by(version, F.struct(order or version, version)).alias(version))
        fresh = stale(batch.join(last, [*key, version]).distinct().select(*batch.columns), there, [*key, version]).select(*batch.columns)
        kept = there.join(fresh.select(by).distinct(), by, "left_semi").join(fresh.select(*key).distinct(), key, "left_anti").select(*batch.columns)
        # the target can't be read and overwritten in one plan, so the folders' new content is written beside it first
        write_by(kept.unionByName(fresh), f"{target}.next", by)
        write_by(spark.read.schema(batch.schema).parquet(f"{target}.next").join(fresh.select(by).distinct(), by, "left_semi").select(*batch.columns), target, by)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, group: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event-time window and group; rows later than ``late`` are left out once their window is closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a key: windows that end after a gap without events."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
