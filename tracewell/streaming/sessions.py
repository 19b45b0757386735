"""Incremental ingest and event streams on Structured Streaming, with their batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of text that a run's log keeps.
MAX_TEXT = 4 << 20


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, session and events of each session; late: the watermark, for streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("events"))


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def follow(log: DataFrame, cursor: int) -> DataFrame:
    """Entries of a run's log (run_id, seq, kind, data) from the cursor on, up to the text cap, then one notice."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.sum(F.length(F.coalesce("data", F.lit("")))).over(w)
    rows = log.withColumn("_seen", seen).withColumn("_before", F.col("_seen") - F.length(F.coalesce("data", F.lit(""))))
    kept = rows.where((F.col("_seen") <= MAX_TEXT) | (F.col("_before") <= MAX_TEXT))
    over = F.col("_seen") > MAX_TEXT
    return kept.where(F.col("seq") >= cursor).select("run_id", "seq", F.when(over, "notice").otherwise(F.col("kind")).alias("kind"), F.when(over, "text cap reached").otherwise(F.col("data")).alias("data"))


def backlog(documents: DataFrame) -> DataFrame:
    """Documents that are still to be processed, those that a crash left included."""
    return documents.where(F.col("status").isin("queued", "processing"))


def ingest(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame], None], seen: Callable[[], DataFrame] | None = None):
    """Handle each micro-batch once; files whose content is known are left out before."""

    def each(batch: DataFrame, _: int) -> None:
        fresh = batch.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
        handle(fresh.join(seen().select("sha256"), "sha256", "left_anti") if seen else fresh)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
