"""A run as one object: ticks and orders in, snapshots, fills and metrics out. Fills are stored when they are first asked for; the rest are plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.operators import fills as fills_of
from tickspark.operators import ledger
from tickspark.operators.orders import accepted, apply_cancels, from_rows
from tickspark.sources.schema import RunConfig, configs
from tickspark.sources.scratch import stored
from tickspark.sources.sinks import BacktestResult


@dataclass
class Backtest:
    """ticks: symbol, seq (dense), ts_ms, price_tick. orders: see ``operators.orders``. weighted=False reproduces the
    averaging of the kernel when a short is added to."""

    spark: SparkSession
    ticks: DataFrame
    orders: DataFrame
    runs: list[RunConfig] = field(default_factory=lambda: [RunConfig()])
    cancels: DataFrame | None = None
    weighted: bool = True
    _fills: DataFrame | None = field(default=None, init=False, repr=False)

    @property
    def configs(self) -> DataFrame:
        return configs(self.spark, self.runs)

    def fills(self) -> DataFrame:
        """Fills of the orders that the kernel would take and that are not cancelled before."""
        if self._fills is None:
            every = stored(fills_of.fills(self.orders, self.ticks, self.configs), "fills")
            out = accepted(every, self.orders, self.cancels)
            self._fills = stored(apply_cancels(out, self.cancels) if self.cancels is not None else out, "taken")
        return self._fills

    def trades(self) -> DataFrame:
        """Fills with the profit that each realized."""
        return ledger.states(self.fills(), self.configs, self.weighted)

    def snapshot(self) -> DataFrame:
        """The last state of each run and symbol; position in units, average entry in ticks."""
        s = ledger.final_snapshot(self.fills(), self.ticks, self.configs, self.weighted)
        return s.select("run_id", "symbol", "ts_ms", "n_fills", "cash", (F.col("position") / 1e6).alias("position"), F.col("average").alias("avg_entry_price"), F.col("realized").alias("realized_pnl"), F.col("unrealized").alias("unrealized_pnl"), "equity", "equity_mtm")

    def history(self) -> DataFrame:
        return ledger.history(self.fills(), self.ticks, self.configs, self.weighted)

    def reset(self) -> Backtest:
        """The same run anew: plans hold no state, so this is a copy."""
        return replace(self)

    def result(self, equity: str = "equity") -> BacktestResult:
        return BacktestResult(stored(self.history(), "history"), stored(self.trades(), "trades"), {"runs": [r.as_dict() for r in self.runs]}, equity)


def backtest_events(spark: SparkSession, events: list[tuple], config: RunConfig, weighted: bool = True) -> Backtest:
    """A run from a short script: ("tick", ts_ms, price_tick), ("order", type, side, qty, price or None), ("cancel", nth order).

    Orders and cancels follow the tick before them.
    """
    ticks, orders, cancels, seq = [], [], [], 0
    for e in events:
        if e[0] == "tick":
            seq += 1
            ticks.append(("all", seq, int(e[1]), int(e[2]), 0.0, "BUY"))
        elif e[0] == "order":
            orders.append((config.run_id, "all", len(orders), seq, *e[1:3], float(e[3]), None if e[4] is None else float(e[4])))
        else:
            cancels.append((config.run_id, "all", int(e[1]), seq))
    t = spark.createDataFrame(ticks, "symbol string, seq long, ts_ms long, price_tick long, qty double, side string")
    c = spark.createDataFrame(cancels, "run_id string, symbol string, order_seq long, cancel_after_seq long") if cancels else None
    return Backtest(spark, t, from_rows(spark, orders, config.tick_size), [config], c, weighted)
