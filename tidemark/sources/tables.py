"""Tables of the test data, and the bars, ticks and deals that are built from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """The files of a table as a stream; a pattern, as a stream takes no path of one file."""
    shape = schema or table(spark, sf_dir, name).schema
    return spark.readStream.schema(shape).parquet(f"{sf_dir}/{name}.parquet*")


def clock_bars(events: DataFrame, width: str = "15 minutes") -> DataFrame:
    """symbol, ts, open, high, low, close, volume: bars of a fixed clock width, stamped with their start.

    The first and last values go by ts and then event_id. Partial aggregates leave the map side, so a
    symbol with most of the rows costs no more than its bars.
    """
    order = F.struct("ts", "event_id")
    return (
        events.groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def ticks(events: DataFrame, spread: float = 0.02) -> DataFrame:
    """symbol, ts, ord, bid, ask, last, volume: the events as quotes with a fixed spread."""
    return events.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("ord"),
        F.col("value").alias("bid"),
        (F.col("value") + spread).alias("ask"),
        F.lit(0.0).alias("last"),
        F.lit(1.0).alias("volume"),
    )


def deals(events: DataFrame, par: float = 100.0) -> DataFrame:
    """ticket, account, symbol, ts, profit: a deal for each event; odd tickets are long, even ones short."""
    move = F.col("value") - par
    return events.select(
        F.col("event_id").alias("ticket"),
        F.col("user_id").alias("account"),
        F.col("event_type").alias("symbol"),
        "ts",
        F.when(F.col("event_id") % 2 == 1, move).otherwise(-move).alias("profit"),
    )
