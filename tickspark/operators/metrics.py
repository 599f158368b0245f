"""Drawdown, returns and the metrics of a run.

Running windows are computed in blocks of seq: the highest and last equity of each block first, their running values over
the blocks (a few rows a run), then the rows of each block on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
#: Profit factor without losses; fixed value.
NO_LOSS = 999.99


#: Names a value may have, the first that is there counts; fixed values.
EQUITY, PNL = ("equity", "value"), ("pnl", "profit")


def pick(df: DataFrame, names: tuple[str, ...]) -> str:
    """The first of these columns that df has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of the columns {', '.join(names)}")


def curve(snapshots: DataFrame, by: tuple[str, ...] = ("run_id", "symbol"), equity: str = "equity", order: str = "seq") -> DataFrame:
    """snapshots with the running peak of the equity, the drawdown from it, and the return on the row before."""
    rows = snapshots.withColumn("_block", F.floor(F.col(order) / BLOCK).cast("long"))
    per = rows.groupBy(*by, "_block").agg(F.max(equity).alias("_top"), F.max_by(equity, order).alias("_end"))
    w = Window.partitionBy(*by).orderBy("_block")
    per = per.select(*by, "_block", F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_peak_before"), F.lag("_end").over(w).alias("_last_before"))
    rows = rows.join(per, [*by, "_block"])
    inside = Window.partitionBy(*by, "_block").orderBy(order)
    peak = F.greatest(F.max(equity).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_peak_before"))
    before = F.coalesce(F.lag(equity).over(inside), F.col("_last_before"))
    rows = rows.withColumn("peak", peak).withColumn("_prev", before)
    return rows.withColumn("drawdown", F.try_divide(F.col(equity) - F.col("peak"), F.col("peak"))).withColumn("ret", F.try_divide(F.col(equity) - F.col("_prev"), F.col("_prev"))).drop("_block", "_peak_before", "_last_before", "_prev")


def performance(curved: DataFrame, by: tuple[str, ...] = ("run_id", "symbol"), equity: str = "equity", order: str = "seq") -> DataFrame:
    """Total return, largest drawdown and Sharpe ratio (population deviation, 252 periods), unrounded."""
    first = F.min_by(equity, order)
    initial = F.when(first == 0, F.lit(10_000.0)).otherwise(first)
    mean, dev = F.avg("ret"), F.stddev_pop("ret")
    return curved.groupBy(*by).agg(
        F.count("*").alias("n_snapshots"),
        initial.alias("initial_equity"),
        F.when(initial > 0, (F.max_by(equity, order) - initial) / initial).otherwise(F.lit(0.0)).alias("total_return"),
        F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.when(dev > 0, mean / dev * F.sqrt(F.lit(252.0))), F.lit(0.0)).alias("sharpe_ratio"),
    )


def trade_metrics(trades: DataFrame, by: tuple[str, ...] = ("run_id", "symbol"), pnl: str = "pnl") -> DataFrame:
    """Number of trades, share of winners, mean profit, and profit factor (999.99 without losses, 0 without either)."""
    p: Column = F.col(pnl)
    won, lost = F.sum(F.when(p > 0, p).otherwise(0.0)), F.abs(F.sum(F.when(p < 0, p).otherwise(0.0)))
    factor = F.when(lost > 0, won / F.nullif(lost, F.lit(0.0))).when(won > 0, F.lit(NO_LOSS)).otherwise(F.lit(0.0))
    return trades.groupBy(*by).agg(F.count("*").alias("total_trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(p).alias("mean_pnl"), factor.alias("profit_factor"))


def summary(curved: DataFrame, trades: DataFrame, by: tuple[str, ...] = ("run_id", "symbol"), equity: str | None = None) -> DataFrame:
    """All metrics of each run; those of trades are 0 where there are none."""
    m = performance(curved, by, equity or pick(curved, EQUITY)).join(trade_metrics(trades, by, pick(trades, PNL)), list(by), "left")
    m = m.fillna(0, ["total_trades"]).fillna(0.0, ["win_rate", "mean_pnl", "profit_factor"])
    return m.withColumn("avg_trade", F.when(F.col("initial_equity") > 0, F.col("mean_pnl") / F.col("initial_equity")).otherwise(F.lit(0.0)))


#: Decimals of each metric where it is shown.
DECIMALS = {"total_return": 4, "max_drawdown": 4, "sharpe_ratio": 2, "win_rate": 4, "total_trades": 0, "avg_trade": 6, "profit_factor": 2}


def rounded(m: DataFrame) -> DataFrame:
    return m.withColumns({c: F.bround(c, d) for c, d in DECIMALS.items() if d})
