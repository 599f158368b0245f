import math
import random

import pytest
from pyspark.sql import functions as F

from tickspark.engine import Backtest, backtest_events
from tickspark.operators import fills, ledger, strategy
from tickspark.operators.kernel import Engine, Order
from tickspark.operators.orders import apply_cancels, first_buy_strategy, from_rows, open_peak, refused
from tickspark.sources.schema import RunConfig, configs


def script(text):
    """t10000 is a tick, MB1.5 a market buy, LS1@99 a limit sell; - stands for no price."""
    out, ts = [], 0
    for w in text.split():
        if w[0] == "t":
            ts += 1000
            out.append(("tick", ts, int(w[1:])))
        else:
            qty, _, price = w[2:].partition("@")
            out.append(("order", {"M": "MARKET", "L": "LIMIT"}[w[0]], {"B": "BUY", "S": "SELL"}[w[1]], float(qty), float(price) if price else None))
    return out


PLAIN = {"initial_cash": 10_000.0, "spread_bps": 0.0}
#: script, config, corrected averaging, cash, position, average, realized, unrealized, equity
GOLDEN = [
    ("t10000 MB1.5 t10000", PLAIN, True, 9849.97, 1.5, 10000, 0, 0, 9849.97),
    ("t10000 MB2 t10000 t10500", PLAIN, True, 9799.96, 2, 10000, 0, 10, 9809.96),
    ("t10000 MB1.5 t10000 t10100 MS0.5 t10100", PLAIN, True, 9900.4599, 1, 10000, 0.5, 1, 9901.4599),
    ("t10000 MB0.123456 t10000", PLAIN, True, 9987.65193088, 0.123456, 10000, 0, 0, 9987.65193088),
    ("t10000 MB1000 t10000", PLAIN | {"initial_cash": 1e6}, True, 899980, 1000, 10000, 0, 0, 899980),
    ("t10000 MB1 t10000 t10100 MS2 t10100", PLAIN, True, 10101.9396, -1, 10100, 1, 0, 10101.9396),
    ("t10000 MS1 t10000 t9900 MB2 t9900", PLAIN, True, 9901.9404, 1, 9900, 1, 0, 9901.9404),
    ("t10000 MB1.5 t10000 t10100 MS1.5 t10100", PLAIN, True, 10001.4397, 0, 0, 1.5, 0, 10001.4397),
    ("t10000 MB0.5 MB1.0 MB0.3 t10000", PLAIN, True, 9819.964, 1.8, 10000, 0, 0, 9819.964),
    ("LB1@99 t10000 t9900 t9850", PLAIN, True, 9900.9802, 1, 9900, 0, -0.5, 9900.4802),
    ("MB2.5 t10000 t10000", PLAIN, True, 9749.95, 2.5, 10000, 0, 0, 9749.95),
    ("t10000", PLAIN, True, 10000, 0, 0, 0, 0, 10000),
    ("t10000 MB1 t10000 t11000 MS1 t11000", PLAIN, True, 10009.958, 0, 0, 10.0, 0, 10009.958),
    ("t10000 MB1 t10000 t10000 MS1 t10000 " * 10, PLAIN, True, 9999.6, 0, 0, 0, 0, 9999.6),
    ("t10000 MB1.234567 t10000", PLAIN, True, 9876.51860866, 1.234567, 10000, 0, 0, 9876.51860866),
    ("t1000000 MB0.123456789 t1000000", PLAIN | {"taker_fee": 0.0, "tick_size": 1e-6}, True, 9999.876544, 0.123456, 1000000, 0, 0, 9999.876544),
    ("t9900 LB1@99 t9900", PLAIN | {"spread_bps": 10.0}, True, 9900.88018, 1, 9910, 0, -0.1, 9900.78018),
    ("t10000 MS1 t10000 MS1 t10000", PLAIN, False, 10199.96, -2, 0, 0, -200, 9999.96),
    ("t10000 MS1 t10000 MS1 t10000", PLAIN, True, 10199.96, -2, 10000, 0, 0, 10199.96),
    ("t10000 MS1 t10000 MS1 t10000 MB2 t10000", PLAIN, False, 9999.92, 0, 0, -200, 0, 9999.92),
    ("t10000 MS1 t10000 MS1 t11000", PLAIN, False, 10209.958, -2, -500, 0, -230, 9979.958),
    ("t10000 MS1 t10000 MS1 t11000", PLAIN, True, 10209.958, -2, 10500, 0, -10, 10199.958),
    ("t10000 MS1 t10000 MS1 t11000 MB2 t10500", PLAIN, True, 9999.916, 0, 0, 0, 0, 9999.916),
    ("t4200000 MB0.5 t4200000 t4250000 MS0.3 t4250000 t4230000 MB0.8 t4230000 t4260000 MS1.0 t4260000", {"initial_cash": 50_000.0}, True, 50465.9240204, 0, 0, 487.962, 0, 50465.9240204),
    ("t4200000 MB0.5 t4200000 t4250000 MS0.3 t4250000 t4230000 MB0.8 t4230000", {"initial_cash": 50_000.0}, True, 7882.9623164, 1.0, 4224844.8, 144.93, 51.552, 7934.5143164),
]


@pytest.mark.parametrize("weighted", [True, False])
def test_golden_vectors_in_one_plan(spark, weighted):
    cases = [(i, g) for i, g in enumerate(GOLDEN) if g[2] == weighted]
    for i, (text, config, _, *want) in cases:
        e = Engine(**kernel_config(RunConfig(**config)), weighted=weighted)
        replay(e, script(text), RunConfig(**config).tick_size)
        s = e.snapshot()
        assert [s[k] for k in ("cash", "position", "avg_entry_price", "realized_pnl", "unrealized_pnl", "equity")] == [pytest.approx(w, abs=1e-8) for w in want], i
    # The same through the declarative plan: one symbol for each script of the commonest configuration.
    same = [(i, g) for i, g in cases if g[1] == PLAIN]
    ticks, orders = [], []
    for i, g in same:
        seq = 0
        for e in script(g[0]):
            if e[0] == "tick":
                seq += 1
                ticks.append((f"s{i}", seq, e[1], e[2]))
            else:
                orders.append(("run", f"s{i}", len(orders), seq, e[1], e[2], e[3], e[4]))
    t = spark.createDataFrame(ticks, "symbol string, seq long, ts_ms long, price_tick long")
    b = Backtest(spark, t, from_rows(spark, orders, 0.01), [RunConfig(**PLAIN)], None, weighted)
    got = {r["symbol"]: r for r in b.snapshot().collect()}
    last = {}
    for r in b.history().orderBy("seq").collect():
        last[r["symbol"]] = r
    for i, g in same:
        r = got[f"s{i}"]
        assert [r[k] for k in ("cash", "position", "avg_entry_price", "realized_pnl", "unrealized_pnl", "equity")] == [pytest.approx(w, abs=1e-8) for w in g[3:]], g[0]
        assert last[f"s{i}"]["equity"] == pytest.approx(g[-1], abs=1e-8)


def kernel_config(c):
    return {"initial_cash": c.initial_cash, "taker_bps": c.taker_fee * 10_000, "spread_bps": c.spread_bps, "tick_size": c.tick_size}


def replay(engine, events, tick_size):
    n = 0
    for e in events:
        if e[0] == "tick":
            engine.step(e[1], e[2])
        else:
            limit = None if e[4] is None else math.floor(e[4] / tick_size + 0.5)
            engine.place(Order(n, e[1], e[2], int(e[3] * 1e6), limit))
            n += 1


def random_run(seed, ticks=150, orders=40):
    rng = random.Random(seed)
    price, seq, out = 10_000, 0, []
    for _ in range(ticks):
        price = max(1, price + rng.randint(-60, 60))
        seq += 1
        out.append(("tick", seq * 10, price))
        if rng.random() < orders / ticks:
            kind = rng.choice(["MARKET", "LIMIT"])
            out.append(("order", kind, rng.choice(["BUY", "SELL"]), rng.randint(1, 3_000_000) / 1e6, (price + rng.randint(-150, 150)) / 100 if kind == "LIMIT" else None))
    return out


@pytest.mark.parametrize("fan", [2, 64])
def test_plan_equals_kernel_on_random_runs(spark, monkeypatch, fan):
    monkeypatch.setattr(fills, "FAN", fan)
    monkeypatch.setattr(ledger, "BLOCK", 32)
    config = RunConfig(initial_cash=10_000.0, spread_bps=3.0)
    ticks, orders, want, states = [], [], {}, {}
    for s in range(12):
        seq, e = 0, Engine(**kernel_config(config))
        for x in random_run(s):
            if x[0] == "tick":
                seq += 1
                ticks.append((f"s{s}", seq, x[1], x[2]))
                e.step(x[1], x[2])
                states[f"s{s}", seq] = e.snapshot()
            else:
                limit = None if x[4] is None else math.floor(x[4] / 0.01 + 0.5)
                e.place(Order(len(orders), x[1], x[2], int(x[3] * 1e6), limit))
                orders.append(("run", f"s{s}", len(orders), seq, x[1], x[2], x[3], x[4]))
        want[f"s{s}"] = sorted((f[0], f[1], f[4]) for f in e.fills)
        flat = e.account
        if flat.position == 0:
            fees = sum(f[3] / 1e6 * f[4] * 0.01 * config.taker_fee for f in e.fills)
            assert flat.cash - config.initial_cash == pytest.approx(flat.realized - fees, abs=1e-6)
    t = spark.createDataFrame(ticks, "symbol string, seq long, ts_ms long, price_tick long")
    b = Backtest(spark, t, from_rows(spark, orders, 0.01), [config])
    got = {}
    for r in b.fills().collect():
        got.setdefault(r["symbol"], []).append((r["order_seq"], r["ts_ms"], r["fill_tick"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    for r in b.history().collect():
        s = states[r["symbol"], r["seq"]]
        assert (r["cash"], r["position"] / 1e6, r["average"], r["realized"], r["equity"], r["equity_mtm"]) == tuple(pytest.approx(s[k], abs=1e-6) for k in ("cash", "position", "avg_entry_price", "realized_pnl", "equity", "equity_mtm"))
    prefix = ledger.prefix_sums(b.fills(), b.configs).groupBy("symbol").agg(F.max_by("position_scaled", F.struct("fill_seq", "order_seq")).alias("p")).collect()
    final = {r["symbol"]: r["position"] for r in b.snapshot().collect()}
    assert all(r["p"] / 1e6 == final[r["symbol"]] for r in prefix)


def test_cancel_and_cap(spark):
    events = [("tick", 1, 10_000), ("order", "LIMIT", "BUY", 1.0, 99.0), ("tick", 2, 9950), ("cancel", 0), ("tick", 3, 9900)]
    assert backtest_events(spark, events, RunConfig(**PLAIN)).fills().count() == 0
    assert backtest_events(spark, [*events[:2], events[4], ("cancel", 0), events[2]], RunConfig(**PLAIN)).fills().count() == 1
    e = Engine(**kernel_config(RunConfig()))
    assert [e.place(Order(i, "LIMIT", "BUY", 1, 1)) for i in range(1025)] == [0] * 1024 + [-2]
    assert e.cancel(5) == 0 and e.cancel(5) == -1 and e.place(Order(9999, "LIMIT", "BUY", 1, 1)) == -2
    e.step(1, 100)
    assert e.place(Order(9999, "LIMIT", "BUY", 1, 1)) == 0
    t = spark.createDataFrame([("all", i, i, 100) for i in range(1, 4)], "symbol string, seq long, ts_ms long, price_tick long")
    o = from_rows(spark, [("run", "all", i, 1, "LIMIT", "BUY", 1.0, 0.5) for i in range(1030)], 0.01)
    r = open_peak(o, fills.fills(o, t, configs(spark, [RunConfig()]))).first()
    assert r["peak_open"] == 1030 and r["over_cap"]
    assert apply_cancels(fills.fills(o, t, configs(spark, [RunConfig()])), spark.createDataFrame([], "run_id string, symbol string, order_seq long, cancel_after_seq long")).count() == 0


def test_bad_orders_are_refused(spark):
    for row in [("run", "all", 0, 1, "LIMIT", "BUY", 1.0, None), ("run", "all", 0, 1, "STOP", "BUY", 1.0, 1.0), ("run", "all", 0, 1, "MARKET", "UP", 1.0, None)]:
        with pytest.raises(Exception, match="LIMIT order needs|invalid"):
            from_rows(spark, [row], 0.01).collect()
    with pytest.raises(ValueError):
        RunConfig(tick_size=0.0)


def test_strategies(spark):
    t = spark.createDataFrame([("all", i, i * 10, 10_000 + i, "SELL" if i < 3 else "BUY") for i in range(1, 8)], "symbol string, seq long, ts_ms long, price_tick long, side string")
    assert first_buy_strategy(t).first()["placed_after_seq"] == 3

    def hold(engine, tick):
        if engine.account.position == 0 and not engine.orders:
            return engine.place(Order(int(tick.seq), "MARKET", "BUY", 1_000_000)) != 0
        return 0

    h = strategy.run(t, configs(spark, [RunConfig("a"), RunConfig("b", spread_bps=0.0)]), hold).collect()
    assert len(h) == 14 and {r["position"] for r in h if r["seq"] >= 2} == {1.0}
    last = strategy.run(t, configs(spark, [RunConfig("a"), RunConfig("b", spread_bps=0.0)]), hold, every_tick=False).collect()
    assert {(r["run_id"], r["seq"]) for r in last} == {("a", 7), ("b", 7)}


@pytest.mark.parametrize("weighted", [True, False])
def test_blocks_and_tree_of_any_size_give_the_same(spark, monkeypatch, weighted):
    config = RunConfig(initial_cash=10_000.0, spread_bps=3.0)
    events = random_run(5, 150, 120)
    whole = backtest_events(spark, events, config, weighted)
    want = [tuple(r) for r in whole.history().select("seq", "cash", "position", "average", "realized").orderBy("seq").collect()]
    trades = [tuple(r) for r in whole.trades().select("order_seq", "position", "pnl").orderBy("order_seq").collect()]
    monkeypatch.setattr(ledger, "BLOCK", 7)
    monkeypatch.setattr(fills, "FAN", 4)
    monkeypatch.setattr(fills, "SMALL_LEVEL", 10)
    parts = backtest_events(spark, events, config, weighted)
    got = [tuple(r) for r in parts.history().select("seq", "cash", "position", "average", "realized").orderBy("seq").collect()]
    assert got == [pytest.approx(w, rel=1e-9, abs=1e-7) for w in want]
    got = [tuple(r) for r in parts.trades().select("order_seq", "position", "pnl").orderBy("order_seq").collect()]
    assert got == [pytest.approx(w, rel=1e-9, abs=1e-7) for w in trades]


def test_many_orders_of_one_symbol_meet_in_no_large_task(spark):
    n = 20_000
    t = spark.range(1, n + 1).select(F.lit("s").alias("symbol"), F.col("id").alias("seq"), F.col("id").alias("ts_ms"), (F.lit(1000) + F.pmod(F.col("id") * 7919, F.lit(997))).alias("price_tick"))
    o = t.select(F.lit("run").alias("run_id"), "symbol", F.col("seq").alias("order_seq"), F.col("seq").alias("placed_after_seq"), F.lit("LIMIT").alias("order_type"), F.when(F.col("seq") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.lit(1).alias("qty_scaled"), F.when(F.col("seq") % 2 == 0, 1002).otherwise(1990).cast("long").alias("limit_tick"))
    price = [1000 + i * 7919 % 997 for i in range(n + 1)]
    want, low, high = {}, None, None
    for i in range(n, 0, -1):
        first = low if i % 2 == 0 else high
        if first:
            want[i] = first
        low, high = i if price[i] <= 1002 else low, i if price[i] >= 1990 else high
    got = fills.first_crossing(o, t)
    assert {r["order_seq"]: r["fill_seq"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and plan.count("Join LeftOuter") >= 3


def test_cap_on_open_orders(spark):
    rng = random.Random(3)
    e, events, ticks, orders, cancels, refused_ = Engine(1e6, 2.0, 0.0, 0.01), [], [], [], [], set()
    for seq in range(1, 200):
        tick = 10_000 + rng.randint(-30, 30)
        ticks.append(("s", seq, seq, tick))
        e.step(seq, tick)
        for _ in range(rng.randint(0, 3)):
            k = len(orders)
            limit = 100 + rng.randint(-60, 60) / 100
            side = rng.choice(["BUY", "SELL"])
            orders.append(("run", "s", k, seq, "LIMIT", side, 1.0, limit))
            if len(e.orders) >= 12:
                refused_.add(k)
            else:
                e.place(Order(k, "LIMIT", side, 10**6, int(limit * 100 + 0.5)))
        if orders and rng.random() < 0.3:
            k = rng.randrange(len(orders))
            if e.cancel(k) == 0:
                cancels.append(("run", "s", k, seq))
    t = spark.createDataFrame(ticks, "symbol string, seq long, ts_ms long, price_tick long")
    o = from_rows(spark, orders, 0.01)
    c = spark.createDataFrame(cancels, "run_id string, symbol string, order_seq long, cancel_after_seq long")
    f = fills.fills(o, t, configs(spark, [RunConfig(spread_bps=0.0)]))
    assert refused_ and {r["order_seq"] for r in refused(o, f, c, most=12).collect()} == refused_
    assert refused(o, f, c, most=10_000).count() == 0
