"""Candles in prices and in ticks: conversion and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantize import check_tick_size, descale, price_half_away, scale_volume

PRICES = ("open", "high", "low", "close")


def _shape(o: Column, h: Column, low: Column, c: Column) -> Column:
    return (low <= h) & (o >= low) & (o <= h) & (c >= low) & (c <= h)


def _times(volume: Column) -> Column:
    ts = (F.col("ts_open") > 0) & (F.col("ts_close") > 0) & (F.col("ts_close") >= F.col("ts_open"))
    return ts & (volume >= 0) & (F.col("trade_count") >= 0)


def valid_ticks() -> Column:
    """Validity of a candle in ticks; null columns make it invalid."""
    return F.coalesce(_times(F.col("volume_scaled")) & _shape(*[F.col(f"{p}_tick") for p in PRICES]), F.lit(False))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid_prices() -> Column:
    """Validity of a candle in prices: as in ticks, and every number finite."""
    ok = _times(F.col("volume")) & _shape(*[F.col(p) for p in PRICES])
    for p in (*PRICES, "volume"):
        ok = ok & finite(F.col(p))
    return F.coalesce(ok, F.lit(False))


def to_ticks(df: DataFrame, tick_size: float) -> DataFrame:
    """Prices to ticks and volume to millionths; other columns stay."""
    ts = check_tick_size(tick_size)
    new = {f"{p}_tick": price_half_away(F.col(p), ts) for p in PRICES} | {"volume_scaled": scale_volume(F.col("volume"))}
    return df.withColumns(new).drop(*PRICES, "volume")


def to_prices(df: DataFrame, tick_size: float) -> DataFrame:
    ts = check_tick_size(tick_size)
    new = {p: F.col(f"{p}_tick") * F.lit(ts) for p in PRICES} | {"volume": descale(F.col("volume_scaled"))}
    return df.withColumns(new).drop(*[f"{p}_tick" for p in PRICES], "volume_scaled")


def from_ticks(ticks: DataFrame, width_ms: int, by: tuple[str, ...] = (), order: str | Column = "seq") -> DataFrame:
    """Candles of ticks (ts_ms, price_tick, qty_scaled): first, highest, lowest and last price of each bucket, in this order."""
    start = F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(width_ms))
    return (
        ticks.groupBy(*by, start.alias("ts_open"))
        .agg(
            F.min_by("price_tick", order).alias("open_tick"),
            F.max("price_tick").alias("high_tick"),
            F.min("price_tick").alias("low_tick"),
            F.max_by("price_tick", order).alias("close_tick"),
            F.sum("qty_scaled").alias("volume_scaled"),
            F.count("*").alias("trade_count"),
        )
        .withColumn("ts_close", F.col("ts_open") + F.lit(width_ms))
    )
