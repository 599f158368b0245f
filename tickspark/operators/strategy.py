"""Strategies whose orders depend on the state of their account: one fold for each run and symbol."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.sources.schema import bounded
from tickspark.sources.scratch import scratch

from . import waves
from .kernel import MAX_OPEN, Engine

HISTORY = "run_id string, symbol string, seq bigint, ts_ms bigint, cash double, position double, avg_entry_price double, realized_pnl double, unrealized_pnl double, equity double, equity_mtm double, n_fills bigint, n_refused bigint"
#: on_tick(engine, tick) is called after a tick's fills and places or cancels orders; it returns how many were refused. What it
#: has to remember it must read from the engine: an account goes on in another process after each wave of ticks.
OnTick = Callable[[Engine, object], int | None]


class _Run:
    def __init__(self, key: tuple, costs: tuple, weighted: bool, max_open: int | None, on_tick: OnTick, every_tick: bool) -> None:
        self.key, self.costs, self.on_tick, self.every_tick = key, costs, on_tick, every_tick
        self.engine = Engine(*costs, weighted, max_open)
        self.seq, self.n, self.refused, self.refused_before = 0, 0, 0, 0

    def apply(self, r: object) -> tuple | None:
        self.seq, self.refused_before = int(r.seq), self.refused
        self.n = self.engine.step(int(r.ts_ms), int(r.price_tick))
        out = self.last() if self.every_tick else None
        self.refused += self.on_tick(self.engine, r) or 0
        self.engine.fills.clear()
        return out

    def last(self) -> tuple:
        return (*self.key, self.seq, *self.engine.snapshot().values(), self.n, self.refused_before)

    def save(self) -> str:
        return json.dumps([self.costs, self.seq, self.n, self.refused, self.refused_before, self.engine.state()])

    def load(self, saved: str) -> None:
        _, self.seq, self.n, self.refused, self.refused_before, state = json.loads(saved)
        self.engine.restore(state)


def run(ticks: DataFrame, configs: DataFrame, on_tick: OnTick, weighted: bool = True, every_tick: bool = True, extra: tuple[str, ...] = (), max_open: int | None = MAX_OPEN) -> DataFrame:
    """Snapshots after every tick, or only the last of each run and symbol; extra names columns that on_tick reads.

    Ticks are folded in waves of bounded size (``waves.py``), so a task sorts the ticks of a wave and holds an account and its
    open orders, never a run's ticks.
    """
    spark, path = ticks.sparkSession, scratch(ticks.sparkSession, "history")

    def start(r: object, saved: str | None) -> _Run:
        costs = (r.initial_cash, r.taker_bps, r.spread_bps, r.tick_size) if saved is None else json.loads(saved)[0]
        x = _Run((r.run_id, r.symbol), costs, weighted, max_open, on_tick, every_tick)
        if saved is not None:
            x.load(saved)
        return x

    runs = bounded(configs)
    rows = ticks.select("symbol", "seq", "ts_ms", "price_tick", "side", *extra)
    size = max(1, waves.WAVE // max(1, configs.count()))
    last = waves.chained(rows, ["seq"], start, HISTORY, path, widen=lambda part: part.join(runs, F.lit(True)), size=size)
    if every_tick:
        return waves.outputs(spark, path, HISTORY)
    return waves.accounts(spark, f"{path}/wave={last}", HISTORY).drop("saved")
