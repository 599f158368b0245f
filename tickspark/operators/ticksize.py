"""A tick size that divides a typical range into about as many steps as asked for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.quantize import NICE, nice_step

LAST_ROWS = 100
PRICE_SHARE = 0.002


def typical_range(candles: DataFrame, order: str = "ts_open", by: tuple[str, ...] = ()) -> DataFrame:
    """Median of high - low over the last hundred rows; where that is not positive, the range of all rows."""
    missing = {"high", "low"} - set(candles.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    spread = F.col("high") - F.col("low")
    number = F.when(~F.isnan(spread), spread)
    if by:
        last = candles.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_n") <= LAST_ROWS)
    else:
        last = candles.orderBy(F.desc(order)).limit(LAST_ROWS)
    solid = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    whole = candles.groupBy(*by).agg((F.max(solid("high")) - F.min(solid("low"))).alias("whole"))
    median = last.groupBy(*by).agg(F.median(number).alias("median"))
    both = whole.join(median, list(by)) if by else whole.join(median, F.lit(True))
    return both.select(*by, F.when(F.col("median") > 0, F.col("median")).otherwise(F.col("whole")).alias("range"))


def from_candles(candles: DataFrame, target_ticks: int = 20, order: str = "ts_open", by: tuple[str, ...] = ()) -> DataFrame:
    """tick_size of each group; null where the range is not positive."""
    if target_ticks <= 0:
        raise ValueError("target_ticks must be positive")
    return typical_range(candles, order, by).withColumn("tick_size", nice_step(F.col("range") / F.lit(float(target_ticks))))


def nice(value: float) -> float:
    """The same step for one number on the driver."""
    if not value > 0:
        raise ValueError("value must be positive")
    power = 10.0 ** math.floor(math.log10(value))
    for bound, step in NICE:
        if value / power <= bound:
            return step * power
    return 10.0 * power


def calculate_auto_ticksize(data: DataFrame | float, timeframe: str = "1h", target_ticks: int = 20) -> float:
    """From candles or from one price; timeframe is accepted and has no effect."""
    if target_ticks <= 0:
        raise ValueError("target_ticks must be positive")
    if isinstance(data, DataFrame):
        order = next((c for c in ("ts_open", "timestamp", "seq") if c in data.columns), data.columns[0])
        row = typical_range(data, order).first()
        if row is None or row[0] is None or not row[0] > 0:
            raise ValueError("the range must be positive")
        return nice(row[0] / target_ticks)
    if isinstance(data, bool) or not isinstance(data, (int, float)):
        raise TypeError(f"candles or a price are needed, not {type(data).__name__}")
    if not data > 0:
        raise ValueError("the price must be positive")
    return nice(data * PRICE_SHARE / target_ticks)
