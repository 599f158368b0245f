"""Ticks gathered into (time bucket, price level, side) volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.functions.quantize import QTY_SCALE, bucket_start


def aggregate_ticks(ticks: DataFrame, bucket_ms: int, by: tuple[str, ...] = (), ordered: bool = True) -> DataFrame:
    """ts_ms, price_tick, side and the summed qty, sorted by the keys.

    Quantities are summed as millionths, so the sum does not depend on the order of the rows, and hot keys combine
    before the shuffle.
    """
    keys = [*by, "ts_ms", "price_tick", "side"]
    rows = ticks.select(*by, bucket_start(F.col("ts_ms"), bucket_ms).alias("ts_ms"), "price_tick", "side", F.round(F.col("qty") * QTY_SCALE).cast("long").alias("q"))
    out = rows.groupBy(*keys).agg((F.sum("q") / F.lit(QTY_SCALE)).alias("qty"))
    return out.orderBy(*keys) if ordered else out


def side_rollup(ticks: DataFrame, bucket_ms: int) -> DataFrame:
    """Volumes of each bucket and side with the subtotals of buckets and the total (null keys)."""
    rows = ticks.select(bucket_start(F.col("ts_ms"), bucket_ms).alias("ts_ms"), "side", "qty_scaled")
    return rows.rollup("ts_ms", "side").agg(F.sum("qty_scaled").alias("qty_scaled"), F.count("*").alias("n"))
