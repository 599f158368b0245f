"""The engine over a stream of ticks, orders and cancels: one account for each run and symbol."""

from __future__ import annotations

import json
import os
import pickle
import tempfile
from collections import namedtuple
from collections.abc import Iterator
from heapq import merge

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from tickspark.operators import waves
from tickspark.operators.kernel import Engine, Order
from tickspark.sources.scratch import remove, scratch

#: Rows of the stream. kind is tick, order or cancel; on one seq the tick comes first. Columns of other kinds are null.
EVENTS = "run_id string, symbol string, kind string, seq bigint, ts_ms bigint, price_tick bigint, order_seq bigint, order_type string, side string, qty_scaled bigint, limit_tick bigint"
OUTPUT = "run_id string, symbol string, seq bigint, ts_ms bigint, cash double, position double, avg_entry_price double, realized_pnl double, unrealized_pnl double, equity double, equity_mtm double, n_fills bigint"
RANK = {"tick": 0, "order": 1, "cancel": 2}
#: Rows that a worker sorts at once, and those of each sorted run that it reads back at once.
SORTED_ROWS, READ_ROWS = 1 << 18, 512


def _apply(engine: Engine, key: tuple, r: object) -> tuple | None:
    """A snapshot, if the row is a tick."""
    if r.kind == "tick":
        n = engine.step(int(r.ts_ms), int(r.price_tick))
        engine.fills.clear()
        return (*key, int(r.seq), *engine.snapshot().values(), n)
    if r.kind == "order":
        engine.place(Order(int(r.order_seq), r.order_type, r.side, int(r.qty_scaled), None if pd.isna(r.limit_tick) else int(r.limit_tick)))
    else:
        engine.cancel(int(r.order_seq))
    return None


def _place(r: object) -> tuple:
    return r.seq, r.rank, float("inf") if pd.isna(r.order_seq) else r.order_seq


def _sorted(batches: Iterator[pd.DataFrame]) -> Iterator[object]:
    """Rows of any number of batches by seq, kind and order_seq. Beyond SORTED_ROWS, sorted runs wait in a file of the worker."""
    runs, held, n = [], [], 0

    def run() -> Iterator[object]:
        rows = pd.concat(held)
        rows = rows.assign(rank=rows["kind"].map(RANK)).sort_values(["seq", "rank", "order_seq"], kind="stable")
        return rows.itertuples(index=False, name="Row")

    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:

        def put() -> None:
            places, block = [], []
            for r in run():
                block.append(tuple(r))
                if len(block) == READ_ROWS:
                    places.append(file.tell())
                    pickle.dump(block, file)
                    block = []
            if block:
                places.append(file.tell())
                pickle.dump(block, file)
            runs.append(places)

        def get(places: list[int]) -> Iterator[object]:
            for at in places:
                file.seek(at)
                yield from map(row._make, pickle.load(file))

        for b in batches:
            held.append(b)
            n += len(b)
            if n >= SORTED_ROWS:
                put()
                held, n = [], 0
        if not runs:
            yield from run()
            return
        if held:
            put()
            held = []
        row = namedtuple("Row", [*b.columns, "rank"])
        yield from merge(*map(get, runs), key=_place)


def run(stream: DataFrame, initial_cash: float, taker_bps: float, spread_bps: float, tick_size: float, weighted: bool = True) -> DataFrame:
    """A snapshot after every tick, from accounts in the state store. Rows of a micro-batch are applied in order of seq; one with
    a seq below what has been applied is late and is applied when it comes, so a source that can be disordered across batches
    should be ordered first. Spark sorts all rows of a micro-batch and key in one task: large ones are for ``snapshot_tables``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine = Engine(initial_cash, taker_bps, spread_bps, tick_size, weighted)
        if state.exists:
            engine.restore(json.loads(state.get[0]))
        out, names = [], waves.fields(OUTPUT)
        for r in _sorted(batches):
            x = _apply(engine, key, r)
            if x is not None:
                out.append(x)
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        state.update((json.dumps(engine.state()),))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy("run_id", "symbol").applyInPandasWithState(step, OUTPUT, "engine string", "append", "NoTimeout")


class _Replay:
    def __init__(self, key: tuple, engine: Engine) -> None:
        self.key, self.engine, self.given = key, engine, None

    def apply(self, r: object) -> tuple | None:
        x = _apply(self.engine, self.key, r)
        self.given = x or self.given
        return x

    def last(self) -> tuple | None:
        return self.given

    def save(self) -> str:
        return json.dumps(self.engine.state())


def snapshot_tables(stream: DataFrame, table: str, checkpoint: str, initial_cash: float, taker_bps: float, spread_bps: float, tick_size: float, weighted: bool = True, available_now: bool = True) -> StreamingQuery:
    """The snapshots of ``run`` in a table that ``read_snapshots`` reads, for micro-batches of any size.

    A micro-batch is folded in waves of bounded size, in order of seq; the accounts after it are kept in the checkpoint
    for the next. A batch that is run again goes on from the accounts of the one before and replaces what it wrote.
    """
    spark = stream.sparkSession
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("kind")]

    def start(r: object, saved: str | None) -> _Replay:
        engine = Engine(initial_cash, taker_bps, spread_bps, tick_size, weighted)
        if saved is not None:
            engine.restore(json.loads(saved))
        return _Replay((r.run_id, r.symbol), engine)

    def put(batch: DataFrame, number: int) -> None:
        kept, at = f"{checkpoint}/accounts", scratch(spark, "events")
        before = waves.accounts(spark, f"{kept}/batch={number - 1}", OUTPUT) if number else None
        remove(spark, f"{table}/batch={number}")
        batch.write.parquet(at)  # a batch's plan runs as a whole for each action on it
        rows = spark.read.schema(EVENTS).parquet(at)
        last = waves.chained(rows, ["seq", rank, "order_seq"], start, OUTPUT, f"{table}/batch={number}", before)
        waves.accounts(spark, f"{table}/batch={number}/wave={last}", OUTPUT).write.mode("overwrite").parquet(f"{kept}/batch={number}")
        remove(spark, at)
        remove(spark, f"{kept}/batch={number - 2}")

    writer = stream.select(*waves.fields(EVENTS)).writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint}/query")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_snapshots(spark: SparkSession, table: str) -> DataFrame:
    """The snapshots of a table that ``snapshot_tables`` wrote."""
    return waves.outputs(spark, table, OUTPUT)
