"""Long runs in waves of bounded size."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tickspark.operators import strategy, waves
from tickspark.operators.kernel import Engine, Order
from tickspark.plans import queries
from tickspark.sources.schema import RunConfig, configs
from tickspark.streaming import engine

from .test_engine import kernel_config, random_run
from .test_queries import rows

CONFIG = RunConfig(initial_cash=10_000.0, spread_bps=3.0)


@pytest.fixture
def folded(monkeypatch):
    """Waves of 256 rows, and what was written by each call."""
    seen, real = [], waves.chained

    def chained(rows, order, start, schema, path, *args, **kw):
        last = real(rows, order, start, schema, path, *args, **kw)
        seen.append((path, last))
        return last

    monkeypatch.setattr(waves, "WAVE", 256)
    monkeypatch.setattr(waves, "chained", chained)
    return seen


def equals_sql(df, name, data):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{data}/events.parquet'")

    class Frame:
        def toPandas(self):
            return c.execute(queries.ORACLE_SQL[name]).df()

    return rows(df) == rows(Frame())


def test_streaming_engine_folds_a_large_batch_in_waves(spark, sf, folded):
    assert equals_sql(queries.streaming_engine(spark, sf), "streaming_engine", sf)
    (path, last), n = folded[0], spark.read.parquet(f"{sf}/events.parquet").count()
    sizes = [waves.outputs(spark, f"{path}/wave={w}", engine.OUTPUT).count() for w in range(last + 1)]
    assert sum(sizes) == n and len(sizes) >= n // 256 and max(sizes) <= 2 * 256


def test_stateful_strategy_folds_a_run_in_waves(spark, sf, folded):
    assert equals_sql(queries.stateful_strategy(spark, sf), "stateful_strategy", sf)
    assert folded[0][1] >= spark.read.parquet(f"{sf}/events.parquet").count() // 256 - 1


def test_stateful_strategy_of_more_open_orders_than_the_kernel_tracks(spark, tmp_path):
    """1,500 limit sells that no later price reaches; the SQL has no cap on open orders."""
    rng = random.Random(1)
    e = [(i, 1_700_000_000 + i, i % 7, "view", 200.0 - i / 100, '{"k": 1}') for i in range(1500)]
    e += [(1500 + i, 1_700_002_000 + i, i % 7, rng.choice(["purchase", "click", "signup", "view"]), round(rng.uniform(0, 190), 2), '{"k": 2}') for i in range(500)]
    spark.createDataFrame(e, "event_id long, s long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s").write.parquet(str(tmp_path / "raw"))
    duckdb.sql(f"copy (select event_id, ts, user_id, event_type, value, props from '{tmp_path}/raw/*.parquet' order by event_id) to '{tmp_path}/events.parquet' (format parquet)")
    assert equals_sql(queries.stateful_strategy(spark, str(tmp_path)), "stateful_strategy", tmp_path)


def trade(engine, tick):
    """Depends on its account and on open orders; cancels some."""
    if tick.seq % 5 == 0 and engine.orders:
        engine.cancel(next(iter(engine.orders.values())).order_seq)
    if engine.account.position > 3_000_000:
        return engine.place(Order(tick.seq, "MARKET", "SELL", 2_000_000)) != 0
    return engine.place(Order(tick.seq, "LIMIT", "BUY" if tick.seq % 3 else "SELL", 700_000, tick.price_tick + (-20 if tick.seq % 3 else 90))) != 0


@pytest.mark.parametrize("every_tick", [True, False])
def test_accounts_go_on_from_wave_to_wave(spark, folded, every_tick):
    rng = random.Random(7)
    runs = [CONFIG, RunConfig("b", spread_bps=0.0)]
    ticks, want = [], {}
    for s, n in (("long", 900), ("short", 40), ("late", 300)):
        start = 600 if s == "late" else 0
        ticks += [(s, start + i, i * 10, 10_000 + rng.randint(-100, 100), "BUY") for i in range(1, n + 1)]
    for c in runs:
        for s in ("long", "short", "late"):
            e, refused = Engine(**kernel_config(c), max_open=8), 0
            for _, seq, ts, tick, _ in (t for t in ticks if t[0] == s):
                n = e.step(ts, tick)
                want[c.run_id, s, seq] = (*e.snapshot().values(), n, refused)
                refused += trade(e, type("T", (), {"seq": seq, "price_tick": tick}))
    assert any(x[-1] for x in want.values())
    if not every_tick:
        want = {k: v for k, v in want.items() if k[2] == {"long": 900, "short": 40, "late": 900}[k[1]]}
    t = spark.createDataFrame(ticks, "symbol string, seq long, ts_ms long, price_tick long, side string")
    got = strategy.run(t, configs(spark, runs), trade, every_tick=every_tick, max_open=8).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert folded[0][1] >= 2


def test_snapshot_tables_equal_the_kernel_over_batches_and_waves(spark, tmp_path, folded):
    feed, want = [], {}
    for s in range(3):
        e, seq, n = Engine(**kernel_config(CONFIG)), 0, 0
        for x in random_run(s, 300, 120):
            if x[0] == "tick":
                seq += 1
                feed.append(("run", f"s{s}", "tick", seq, x[1], x[2], None, None, None, None, None))
                e.step(x[1], x[2])
                want[f"s{s}", seq] = tuple(e.snapshot().values())
            else:
                limit = None if x[4] is None else int(x[4] * 100 + 0.5)
                e.place(Order(n, x[1], x[2], int(x[3] * 1e6), limit))
                feed.append(("run", f"s{s}", "order", seq, 0, 0, n, x[1], x[2], int(x[3] * 1e6), limit))
                n += 1
    feed.sort(key=lambda r: (r[3], r[2] == "order", r[1], r[6] or 0))
    cuts = [0, 700, 705, len(feed)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(feed[a:b], engine.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    s = spark.readStream.schema(engine.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    costs = (CONFIG.initial_cash, CONFIG.taker_fee * 10_000, CONFIG.spread_bps, CONFIG.tick_size)
    engine.snapshot_tables(s, str(tmp_path / "table"), str(tmp_path / "c"), *costs).awaitTermination()
    got = engine.read_snapshots(spark, str(tmp_path / "table")).collect()
    assert {(r["symbol"], r["seq"]): tuple(r)[3:-1] for r in got} == want and len(got) == len(want)
    assert [last for _, last in folded][1] == 0 and folded[0][1] > 0


def test_sorted_rows_of_a_micro_batch_are_merged_from_runs(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(engine, "SORTED_ROWS", 100)
    monkeypatch.setattr(engine, "READ_ROWS", 7)
    rng = random.Random(2)
    feed = [(("tick", i, None) if k == 0 else ("order", i, i * 4 + k) if k < 3 else ("cancel", i, i * 4 + 1)) for i in range(300) for k in range(4)]
    rng.shuffle(feed)
    made, real = [], pd.concat
    monkeypatch.setattr(engine.pd, "concat", lambda x: made.append(sum(map(len, x))) or real(x))
    got = [(r.kind, r.seq, None if pd.isna(r.order_seq) else r.order_seq) for r in engine._sorted(pd.DataFrame(feed[k : k + 30], columns=["kind", "seq", "order_seq"]) for k in range(0, len(feed), 30))]
    assert got == sorted(feed, key=lambda x: (x[1], engine.RANK[x[0]], x[2] or 0)) and max(made) < 130
