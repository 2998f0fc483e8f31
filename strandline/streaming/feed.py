"""Change feed: new relation facts and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import upsert


def facts_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def apply_feed(stream: DataFrame, store: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch; a batch that is delivered again after a
    failure changes nothing, since the upsert is idempotent."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            upsert(df.sparkSession, store, df.dropDuplicates(key), key)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Events per window and type; later than the watermark is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def refresh_mode(consecutive: int, change_ratio: float, days_since: float, days_since_full: float) -> str:
    """Gate of the scheduler: many incremental runs in a row, a large change
    or old results force a rebuild."""
    return "full" if consecutive >= 10 or change_ratio > 0.05 or days_since > 7 or days_since_full > 14 else "incremental"
