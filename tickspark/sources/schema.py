"""Schemas of trades, ticks, candles, orders and run configurations, and the codes they use."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE_BUY, SIDE_SELL = 0, 1
ORDER_LIMIT, ORDER_MARKET = 0, 1
SIDES, ORDER_TYPES = ("BUY", "SELL"), ("LIMIT", "MARKET")

AGG_TRADES = "timestamp bigint, price double, qty double, is_buyer_maker boolean"
TRADES = "timestamp bigint, price double, qty double, side tinyint"
TICKS = "symbol string, seq bigint, ts_ms bigint, price_tick bigint, qty double, side string"
CANDLES = "ts_open bigint, ts_close bigint, open_tick bigint, high_tick bigint, low_tick bigint, close_tick bigint, volume_scaled bigint, trade_count bigint"
FLOAT_CANDLES = "ts_open bigint, ts_close bigint, open double, high double, low double, close double, volume double, trade_count bigint"
ORDERS = "run_id string, symbol string, order_seq bigint, placed_after_seq bigint, order_type string, side string, qty_scaled bigint, limit_tick bigint"
CONFIGS = "run_id string, initial_cash double, maker_bps double, taker_bps double, spread_bps double, tick_size double"


@dataclass(frozen=True)
class RunConfig:
    """Costs and scale of a run. Fees are fractions; the maker fee is kept but never charged, as every fill takes."""

    run_id: str = "run"
    initial_cash: float = 100_000.0
    maker_fee: float = 0.0001
    taker_fee: float = 0.0002
    spread_bps: float = 2.0
    tick_size: float = 0.01

    def __post_init__(self) -> None:
        if not self.tick_size > 0:
            raise ValueError(f"tick_size must be positive, not {self.tick_size}")

    def row(self) -> tuple:
        return self.run_id, float(self.initial_cash), self.maker_fee * 10_000, self.taker_fee * 10_000, float(self.spread_bps), float(self.tick_size)

    def as_dict(self) -> dict:
        return asdict(self)


def configs(spark: SparkSession, runs: list[RunConfig]) -> DataFrame:
    """One row for each run."""
    names = [c.split()[0] for c in CONFIGS.split(", ")]
    values = {f"{n}_{i}": x for i, r in enumerate(runs) for n, x in zip(names, r.row(), strict=True)}
    rows = ", ".join(f"({', '.join(f':{n}_{i}' for n in names)})" for i in range(len(runs)))
    return spark.sql(f"select * from values {rows} as t({', '.join(names)})", values) if runs else spark.createDataFrame([], CONFIGS)


#: Bytes, by the optimizer's estimate, and rows up to which a table is broadcast.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 100_000


def bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small by its plan's estimate, or else by a count of a few of its rows; a larger
    one is joined as the optimizer sees fit."""
    small = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= BROADCAST_BYTES
    return F.broadcast(df) if small or df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
