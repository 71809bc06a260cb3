"""Reads as a stream: deliveries once each, late data, and running counts per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deliveries(spark: SparkSession, path: str) -> DataFrame:
    """A directory of read_buf parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def once(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Each rid once; state is kept for as long as deliveries may be late. Rows without a time are left out."""
    return stream.where("sequenced_at is not null").withWatermark("sequenced_at", late).dropDuplicatesWithinWatermark(["rid"])


def run_counts(stream: DataFrame, late: str = "7 days", window: str = "1 hour") -> DataFrame:
    """Reads and bases per run and hour."""
    x = stream.where("sequenced_at is not null").withWatermark("sequenced_at", late)
    return x.groupBy(F.window("sequenced_at", window), "run_id").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.coalesce(F.length("seq"), F.lit(0))).alias("n_bases"))
