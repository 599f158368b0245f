"""Command line: trades in, a tear sheet out."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tickspark.engine import Backtest
from tickspark.operators.bucket import aggregate_ticks
from tickspark.operators.orders import first_buy_strategy
from tickspark.operators.sequence import with_seq
from tickspark.operators.ticksize import calculate_auto_ticksize
from tickspark.sources.schema import RunConfig
from tickspark.sources.sinks import tearsheet
from tickspark.sources.trades import agg_trades_feed, batch_ticks, convert_to_parquet, load_dataset, read_agg_trades_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickspark", description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--mode", choices=["aggtrades", "ohlc", "ticks"], default="aggtrades")
    p.add_argument("--auto-ticksize", action="store_true")
    p.add_argument("--tick-size", type=float)
    p.add_argument("--bucket-ms", type=int, default=50)
    p.add_argument("--output", default="outputs/")
    p.add_argument("--initial-cash", type=float, default=100_000.0)
    p.add_argument("--timeframe", default="1h")
    p.add_argument("--target-ticks", type=int, default=20)
    p.add_argument("--keep-csv", action="store_true", help="the input is always kept; accepted for old scripts")
    p.add_argument("--force-csv", action="store_true", help="bucket the CSV's ticks instead of going through Parquet")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tickspark").getOrCreate()
    is_csv = a.input.lower().endswith(".csv")
    if is_csv and not a.force_csv:
        trades = load_dataset(spark, convert_to_parquet(spark, a.input, a.input[:-4] + ".parquet"))
    else:
        trades = read_agg_trades_csv(spark, a.input) if is_csv else load_dataset(spark, a.input)
    tick_size = a.tick_size or 1.0
    if a.auto_ticksize:
        tick_size = calculate_auto_ticksize(float(trades.orderBy("timestamp").first()["price"]), a.timeframe, a.target_ticks)
    if is_csv and a.force_csv:
        bucketed = aggregate_ticks(agg_trades_feed(spark, a.input, tick_size), a.bucket_ms, ("symbol",), ordered=False)
        ticks = with_seq(bucketed, ["ts_ms", "price_tick", "side"])
    else:
        ticks = batch_ticks(trades, tick_size)
    config = RunConfig(initial_cash=a.initial_cash, tick_size=tick_size)
    out = tearsheet(Backtest(spark, ticks, first_buy_strategy(ticks), [config]).result(), a.output)
    print(out)
    return out


if __name__ == "__main__":
    main()
