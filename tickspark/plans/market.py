"""The tick view of the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions.quantize import price_half_even, scale_qty, side_of_maker
from tickspark.operators.sequence import with_seq
from tickspark.sources.scratch import stored

TICK_SIZE = 0.01


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trades: price is the event's value, quantity and maker flag come from its properties."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", "user_id", "event_type", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("value").alias("price"), ((k + 1) / 100).alias("qty"), (k % 2 == 1).alias("is_buyer_maker"))


def plain_ticks(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """Ticks in the order of (ts, event_id), not yet numbered; one symbol for the whole table, or one for each user."""
    t = trades(spark, sf_dir)
    symbol = F.concat(F.lit("u"), F.col("user_id")) if by_user else F.lit("all")
    return t.select(
        symbol.alias("symbol"), "event_id", "event_type", "ts", F.col("timestamp").alias("ts_ms"), "price", price_half_even(F.col("price"), TICK_SIZE).alias("price_tick"), "qty", scale_qty(F.col("qty")).alias("qty_scaled"), side_of_maker(F.col("is_buyer_maker")).alias("side")
    )


def ticks(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """Numbered ticks, stored once: the engine reads them several times, and numbering a table takes a sort of it."""
    rows = with_seq(plain_ticks(spark, sf_dir, by_user), ["ts", "event_id"], ["symbol"] if by_user else None)
    return stored(rows, "ticks") if by_user else rows  # numbers of a whole table are stored as they are made
