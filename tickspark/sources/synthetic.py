"""Generated trades, for benchmarks and demonstrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def agg_trades(spark: SparkSession, rows: int, seed: int = 42, start_ms: int = 1_704_067_200_000, step_ms: int = 50, start_price: float = 42_000.0, volatility: float = 10.0) -> DataFrame:
    """Evenly spaced trades on a normal random walk, with exponential quantities and fair sides.

    The walk is a running sum within blocks plus the sums of the blocks before.
    """
    t = spark.range(rows).select("id", F.floor(F.col("id") / BLOCK).alias("b"), (F.randn(seed) * volatility).alias("d"), (-F.log1p(-F.rand(seed + 1)) * 0.05).alias("qty"), (F.rand(seed + 2) < 0.5).alias("is_buyer_maker"))
    sums = t.groupBy("b").agg(F.sum("d").alias("s"))
    base = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))
    walk = F.sum("d").over(Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    out = t.join(base, "b").withColumn("price", F.greatest(F.lit(start_price) + F.col("base") + walk, F.lit(0.01)))
    return out.select((F.lit(start_ms) + F.col("id") * step_ms).alias("timestamp"), "price", "qty", "is_buyer_maker")
