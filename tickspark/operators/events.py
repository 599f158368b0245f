"""Trades and bars as one stream of events, with counters of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

TRADE = "struct<ts_ms:bigint,price_tick:bigint,qty_scaled:bigint,side:string>"
BAR = "struct<ts_open:bigint,ts_close:bigint,open_tick:bigint,high_tick:bigint,low_tick:bigint,close_tick:bigint,volume_scaled:bigint,trade_count:bigint>"


def trade_events(ticks: DataFrame) -> DataFrame:
    trade = F.struct(F.col("ts_ms").cast("long").alias("ts_ms"), F.col("price_tick").cast("long").alias("price_tick"), F.col("qty_scaled").cast("long").alias("qty_scaled"), F.col("side").cast("string").alias("side"))
    return ticks.select(F.lit("trade").alias("kind"), F.col("ts_ms").alias("ts"), trade.cast(TRADE).alias("trade"), F.lit(None).cast(BAR).alias("bar"))


def bar_events(candles: DataFrame) -> DataFrame:
    names = [x.split(":")[0] for x in BAR[7:-1].split(",")]
    return candles.select(F.lit("bar").alias("kind"), F.col("ts_open").alias("ts"), F.lit(None).cast(TRADE).alias("trade"), F.struct(*[F.col(n).cast("long").alias(n) for n in names]).cast(BAR).alias("bar"))


def union(ticks: DataFrame, candles: DataFrame) -> DataFrame:
    return trade_events(ticks).unionByName(bar_events(candles))


def timestamp() -> Column:
    return F.coalesce(F.col("trade.ts_ms"), F.col("bar.ts_open"))


def is_trade() -> Column:
    return F.col("kind") == "trade"


def is_bar() -> Column:
    return F.col("kind") == "bar"


def ingestion(rows: DataFrame) -> DataFrame:
    """Counters of rows with an ``error_kind``: candles_rejected stays 0, as invalid candles count as parse errors; the
    split is given beside it."""
    bad = F.col("error_kind").isNotNull()
    return rows.agg(
        F.count_if(~bad).alias("candles_processed"),
        F.lit(0).cast("long").alias("candles_rejected"),
        F.count_if(bad).alias("parse_errors"),
        F.count_if(F.coalesce(F.col("error_kind") == "InvalidCandle", F.lit(False))).alias("invalid_candles"),
    )


def observed(rows: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """rows unchanged, and counters that are filled while they are read."""
    o = Observation(name)
    bad = F.col("error_kind").isNotNull()
    return rows.observe(o, F.count_if(~bad).alias("candles_processed"), F.count_if(bad).alias("parse_errors")), o
