import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.operators import metrics as m
from tickspark.operators import ticksize
from tickspark.operators.bucket import aggregate_ticks, side_rollup
from tickspark.operators.sequence import with_seq
from tickspark.sources.sinks import BacktestResult, tearsheet


def snapshots(spark, equity):
    return spark.createDataFrame([("r", "s", i + 1, i * 1000, 10_000, float(x), 1_000_000, float(x), 0.0, 0.0) for i, x in enumerate(equity)], "run_id string, symbol string, seq long, ts_ms long, price_tick long, cash double, position long, equity double, realized double, unrealized double")


def trades(spark, pnl):
    return spark.createDataFrame([("r", "s", i, i * 1000, "BUY", 100, float(x)) for i, x in enumerate(pnl)], "run_id string, symbol string, order_seq long, ts_ms long, side string, fill_tick long, pnl double")


def brute(eq):
    eq = np.array(eq, float)
    peak = np.maximum.accumulate(eq)
    ret = np.diff(eq) / eq[:-1]
    sharpe = ret.mean() / ret.std() * np.sqrt(252) if len(ret) and ret.std() > 0 else 0.0
    return (eq[-1] - eq[0]) / eq[0], ((eq - peak) / peak).min(), sharpe


@pytest.mark.parametrize("block", [4, 65_536])
def test_performance_equals_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rng = np.random.default_rng(1)
    eq = 10_000 * np.exp(np.cumsum(rng.normal(0, 0.01, 50)))
    r = m.performance(m.curve(snapshots(spark, eq))).first()
    assert (r["total_return"], r["max_drawdown"], r["sharpe_ratio"]) == tuple(pytest.approx(x) for x in brute(eq))


def test_flat_and_single(spark):
    for eq in ([100.0], [100.0, 100.0, 100.0]):
        r = m.performance(m.curve(snapshots(spark, eq))).first()
        assert (r["total_return"], r["max_drawdown"], r["sharpe_ratio"]) == (0, 0, 0)


def test_trade_metrics(spark):
    r = m.trade_metrics(trades(spark, [10, -4, 0, 6])).first()
    assert (r["total_trades"], r["win_rate"], r["mean_pnl"], r["profit_factor"]) == (4, 0.5, 3.0, 4.0)
    assert m.trade_metrics(trades(spark, [1, 2])).first()["profit_factor"] == 999.99
    assert m.trade_metrics(trades(spark, [0])).first()["profit_factor"] == 0


def test_result_sinks(spark, tmp_path):
    eq = [10_000.0, 10_100.0, 9_999.0, 10_200.0]
    r = BacktestResult(snapshots(spark, eq), trades(spark, [5, -1]))
    got = r.metrics()
    assert got["total_return"] == 0.02 and got["max_drawdown"] == -0.01 and got["total_trades"] == 2 and got["avg_trade"] == 0.0002 and got["profit_factor"] == 5
    r.to_json(str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == got
    r.to_csv(str(tmp_path / "eq"), files=1)
    back = spark.read.option("header", True).csv(str(tmp_path / "eq"))
    assert back.columns == ["timestamp", "equity", "cash", "position", "realized_pnl", "unrealized_pnl"] and back.count() == 4
    assert r.summary() == "Backtest Results:\n-----------------\nTotal Return: 2.00%\nMax Drawdown: -1.00%\nSharpe Ratio: 8.50\nWin Rate: 50.00%\nTotal Trades: 2\nAvg Trade: 0.0002"
    other = BacktestResult(r.snapshots.withColumnRenamed("equity", "value"), r.trades.withColumnRenamed("pnl", "profit"))
    assert other.metrics() == got
    out = tearsheet(r, str(tmp_path / "sheet"))
    assert spark.read.option("header", True).csv(f"{out}/equity.csv").columns == ["timestamp", "equity", "drawdown"]
    none = BacktestResult(snapshots(spark, [1.0]).limit(0), trades(spark, [1]).limit(0))
    assert set(none.metrics().values()) == {0}


def test_buckets(spark):
    t = spark.createDataFrame([(1000, 100, 1.5, "BUY"), (1100, 100, 2.0, "BUY"), (1200, 101, 1.0, "SELL")], "ts_ms long, price_tick long, qty double, side string")
    assert [tuple(r) for r in aggregate_ticks(t, 1000).collect()] == [(1000, 100, "BUY", 3.5), (1000, 101, "SELL", 1.0)]
    assert side_rollup(t.withColumn("qty_scaled", F.lit(1)), 1000).count() == 4


def test_auto_tick_size(spark):
    assert [ticksize.calculate_auto_ticksize(x) for x in (42150, 100000.0, 4000)] == [5.0, 10.0, pytest.approx(0.5)]
    ohlc = spark.createDataFrame([(1, 100500.0, 100000.0), (2, 100800.0, 100200.0)], "ts_open long, high double, low double")
    assert ticksize.calculate_auto_ticksize(ohlc) == 20.0
    assert ticksize.from_candles(ohlc).first()["tick_size"] == 20.0
    flat = spark.createDataFrame([(i, 5.0 + (i == 0), 5.0) for i in range(300)], "ts_open long, high double, low double")
    assert ticksize.typical_range(flat).first()["range"] == 1.0
    for bad, error in (("x", TypeError), (0, ValueError), (-1.0, ValueError), (ohlc.limit(0), ValueError), (ohlc.drop("low"), ValueError)):
        with pytest.raises(error):
            ticksize.calculate_auto_ticksize(bad)
    with pytest.raises(ValueError):
        ticksize.calculate_auto_ticksize(1.0, target_ticks=0)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_global_sequence_is_dense_and_ordered(spark, wide, coalesce):
    n = 200_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), "id", *[F.repeat(F.lit("x"), 40 + i).alias(f"c{i}") for i in range(8 * wide)]).repartition(7)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, (coalesce, "64k", "37"), strict=True):
        spark.conf.set(k, v)
    try:
        rows = with_seq(df, ["k"])
        assert rows.columns == [*df.columns, "seq"]
        got = rows.select("k", "seq").toPandas().sort_values("k")
        assert got["seq"].tolist() == list(range(1, n + 1))
        # Narrower reads of the same table see the same numbers.
        assert rows.agg(F.sum("seq"), F.count_if(F.col("seq").isNull())).first() == (n * (n + 1) // 2, 0)
        assert rows.join(rows.select(F.col("seq").alias("t"), F.col("id").alias("j")), F.col("seq") == F.col("t")).where("id <> j").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert with_seq(df.limit(0), ["k"]).count() == 0
