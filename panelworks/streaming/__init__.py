"""Ledger ingestion as a stream: new pick files are upserted by date, late days resolve with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelworks.operators.books import write_ledger


def picks_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert_stream(picks: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Works off all files there are, each micro-batch replacing its dates in the ledger."""
    return picks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: write_ledger(batch, ledger)).start()


def daily_counts(events: DataFrame, delay: str = "6 days") -> DataFrame:
    """Events a day and type, closed once the watermark has passed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
