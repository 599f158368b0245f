"""The registered queries of the back-testing operators, and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions import candles as candle
from tickspark.functions.quantize import descale, price_half_away, price_half_even, price_truncate, scale_qty, side_code, side_of_maker
from tickspark.operators import events, fills, ledger, metrics, strategy, ticksize
from tickspark.operators.bucket import aggregate_ticks, side_rollup
from tickspark.operators.kernel import Order
from tickspark.operators.orders import apply_cancels, first_buy_strategy, from_signals, open_peak, sweep
from tickspark.sources.candle_files import read_candles
from tickspark.sources.schema import RunConfig, configs
from tickspark.sources.scratch import scratch, stored
from tickspark.sources.trades import first_price, load_dataset
from tickspark.streaming import bucket as stream_bucket
from tickspark.streaming import engine as stream_engine

from .market import TICK_SIZE, plain_ticks, ticks, trades

BUCKET_MS = 60_000
BAR_MS = 3_600_000
RUN = RunConfig("run", 100_000.0, 0.0001, 0.0002, 2.0, TICK_SIZE)
SWEEP = [RunConfig("a", 100_000.0, 0.0001, 0.0002, 0.0, TICK_SIZE), RunConfig("b", 100_000.0, 0.0001, 0.0002, 2.0, TICK_SIZE), RunConfig("c", 50_000.0, 0.0, 0.001, 10.0, TICK_SIZE)]


def rules() -> list[tuple]:
    """A market order after a dear purchase or click, a limit order after a dear signup or view."""
    kind, price = F.col("event_type"), F.col("price")
    return [
        ((kind == "purchase") & (price > 150), "MARKET", "BUY", F.lit(1.5), None),
        ((kind == "click") & (price > 150), "MARKET", "SELL", F.lit(0.75), None),
        ((kind == "signup") & (price > 120), "LIMIT", "BUY", F.lit(1.25), price * 0.05),
        ((kind == "view") & (price > 120), "LIMIT", "SELL", F.lit(1.0), price * 1.5),
    ]


def orders(t: DataFrame, kind: str | None = None) -> DataFrame:
    o = from_signals(t, rules(), TICK_SIZE)
    return o.where(F.col("order_type") == kind) if kind else o


def money(c: str, digits: int = 6) -> F.Column:
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


def agg_trades_normalize(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf)
    q = scale_qty(F.col("qty"))
    return t.select("event_id", "timestamp", "price", q.alias("qty_scaled"), descale(q).alias("qty"), side_of_maker(F.col("is_buyer_maker")).alias("side"), side_code(F.col("is_buyer_maker")).cast("int").alias("side_code"))


def price_quantize_modes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("price")
    return trades(spark, sf).select("event_id", price_half_even(p, 0.5).alias("half_even"), price_half_away(p, 0.5).alias("half_away"), price_truncate(p, 0.5).alias("truncated"))


def tick_bucket_volume(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate_ticks(plain_ticks(spark, sf), BUCKET_MS)


def tick_side_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return side_rollup(plain_ticks(spark, sf), 86_400_000).select(F.coalesce("ts_ms", F.lit(-1)).alias("ts_ms"), F.coalesce("side", F.lit("both")).alias("side"), "qty_scaled", "n")


def candles(spark: SparkSession, sf: str, by_user: bool = False) -> DataFrame:
    return candle.from_ticks(plain_ticks(spark, sf, by_user), BAR_MS, ("symbol",) if by_user else (), F.struct("ts", "event_id"))


def candles_from_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return candles(spark, sf, True).select("symbol", "ts_open", "ts_close", "open_tick", "high_tick", "low_tick", "close_tick", "volume_scaled", "trade_count")


def odd_candles(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly candles in prices, some of which are spoilt by their own values."""
    c = candle.to_prices(candles(spark, sf), TICK_SIZE)
    n = F.col("trade_count")
    return c.withColumns({"high": F.when(n <= 5, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(n == 8, F.lit(float("nan"))).otherwise(F.col("volume")), "ts_close": F.when(n == 10, F.lit(0).cast("long")).otherwise(F.col("ts_close"))})


def candle_validity_split(spark: SparkSession, sf: str) -> DataFrame:
    ok = candle.valid_prices()
    return odd_candles(spark, sf).groupBy(ok.alias("is_valid")).agg(F.count("*").alias("n"), F.sum("trade_count").alias("trades"))


def ingestion_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = odd_candles(spark, sf).withColumn("error_kind", F.when(~candle.valid_prices(), "InvalidCandle"))
    return events.ingestion(rows)


def candle_roundtrip_float(spark: SparkSession, sf: str) -> DataFrame:
    c = candles(spark, sf)
    back = candle.to_ticks(candle.to_prices(c, 0.25), 0.25)
    return back.select("ts_open", "open_tick", "high_tick", "low_tick", "close_tick", "volume_scaled")


def candle_files_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Candles written as NDJSON and CSV under other names, and read again."""
    c = candle.to_prices(candles(spark, sf), TICK_SIZE).select(F.col("ts_open").alias("ts"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("vol"), F.col("trade_count").alias("trades"))
    path = scratch(spark, "candles")
    c.write.json(f"{path}/a.ndjson")
    c.write.option("header", True).csv(f"{path}/b.csv")
    out = None
    for name in ("a.ndjson", "b.csv"):
        good, _ = read_candles(spark, f"{path}/{name}", TICK_SIZE)
        out = good.withColumn("file", F.lit(name)) if out is None else out.unionByName(good.withColumn("file", F.lit(name)))
    return out


def market_event_union(spark: SparkSession, sf: str) -> DataFrame:
    e = events.union(plain_ticks(spark, sf), candles(spark, sf))
    return e.groupBy("kind", events.is_trade().alias("is_trade"), events.is_bar().alias("is_bar")).agg(F.count("*").alias("n"), F.min(events.timestamp()).alias("first_ts"), F.max(events.timestamp()).alias("last_ts"))


def _fills(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    t = ticks(spark, sf)
    return stored(fills.fills(orders(t, kind), t, configs(spark, [RUN])), "fills")


def _shown(f: DataFrame) -> DataFrame:
    return f.select("order_seq", "fill_seq", "ts_ms", "order_type", "side", "qty_scaled", "fill_tick", money("notional"), money("fee", 8))


def market_order_fills(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_fills(spark, sf, "MARKET"))


def limit_order_fills(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_fills(spark, sf, "LIMIT"))


def demo_strategy_fills(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf, True)
    return fills.fills(first_buy_strategy(t), t, configs(spark, [RUN])).select("symbol", "fill_seq", "ts_ms", "side", "qty_scaled", "fill_tick", money("notional"), money("fee", 8))


def cancelled_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Limit orders are cancelled forty ticks after their placement."""
    t = ticks(spark, sf)
    o = orders(t, "LIMIT")
    cancels = o.select("run_id", "symbol", "order_seq", (F.col("placed_after_seq") + 40).alias("cancel_after_seq"))
    return _shown(apply_cancels(fills.fills(o, t, configs(spark, [RUN])), cancels))


def open_order_peak(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    o = orders(t)
    return open_peak(o, stored(fills.fills(o, t, configs(spark, [RUN])), "fills")).select("run_id", "peak_open", "over_cap")


def position_cash_prefix(spark: SparkSession, sf: str) -> DataFrame:
    p = ledger.prefix_sums(_fills(spark, sf), configs(spark, [RUN]))
    return p.select("order_seq", "fill_seq", "position_scaled", money("cash", 3))


def _final(s: DataFrame) -> DataFrame:
    return s.select("run_id", "n_fills", F.col("position").alias("position_scaled"), money("cash"), money("average"), money("realized"), money("unrealized"), money("equity"), money("equity_mtm"))


def ledger_fold_final(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    return _final(ledger.final_snapshot(stored(fills.fills(orders(t), t, configs(spark, [RUN])), "fills"), t, configs(spark, [RUN])))


def ledger_fold_compat(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    return _final(ledger.final_snapshot(stored(fills.fills(orders(t), t, configs(spark, [RUN])), "fills"), t, configs(spark, [RUN]), weighted=False))


def param_sweep(spark: SparkSession, sf: str) -> DataFrame:
    t, runs = ticks(spark, sf), configs(spark, SWEEP)
    return _final(ledger.final_snapshot(stored(fills.fills(sweep(orders(t), runs), t, runs), "fills"), t, runs))


def _history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t, runs = ticks(spark, sf), configs(spark, [RUN])
    f = stored(fills.fills(orders(t), t, runs), "fills")
    return ledger.history(f, t, runs), ledger.states(f, runs)


def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    h, _ = _history(spark, sf)
    return h.select("seq", "ts_ms", F.col("position").alias("position_scaled"), money("cash", 4), money("equity", 4), money("equity_mtm", 4))


def drawdown_curve(spark: SparkSession, sf: str) -> DataFrame:
    h, _ = _history(spark, sf)
    return metrics.curve(h, equity="equity_mtm").select("seq", money("peak", 4), money("drawdown", 8), money("ret", 8))


def performance_metrics(spark: SparkSession, sf: str) -> DataFrame:
    h, _ = _history(spark, sf)
    m = metrics.performance(metrics.curve(h, equity="equity_mtm"), equity="equity_mtm")
    return m.select("run_id", "n_snapshots", money("initial_equity"), money("total_return", 8), money("max_drawdown", 8), money("sharpe_ratio", 5))


def trade_metrics(spark: SparkSession, sf: str) -> DataFrame:
    _, trades_ = _history(spark, sf)
    return metrics.trade_metrics(trades_.where("pnl <> 0")).select("run_id", "total_trades", money("win_rate", 8), money("mean_pnl"), money("profit_factor"))


def auto_ticksize_price(spark: SparkSession, sf: str) -> DataFrame:
    step = ticksize.nice_step(F.col("price") * F.lit(ticksize.PRICE_SHARE) / F.lit(20.0))
    return trades(spark, sf).where("price > 0").select("event_id", money_of(step).alias("tick_size"))


def money_of(c: F.Column, digits: int = 9) -> F.Column:
    return F.round(c, digits) + F.lit(0.0)


def auto_ticksize_ohlc(spark: SparkSession, sf: str) -> DataFrame:
    c = candle.to_prices(candles(spark, sf, True), TICK_SIZE)
    t = ticksize.from_candles(c, 20, by=("symbol",))
    return t.select("symbol", money_of(F.col("range"), 6).alias("range"), money_of(F.col("tick_size")).alias("tick_size"))


def first_trade_price(spark: SparkSession, sf: str) -> DataFrame:
    return first_price(plain_ticks(spark, sf), order=F.struct("ts", "event_id"))


def parquet_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """Trades written in the converted form and read again, summed by side."""
    path = scratch(spark, "trades")
    trades(spark, sf).select("timestamp", "price", "qty", side_code(F.col("is_buyer_maker")).alias("side")).write.option("compression", "zstd").parquet(path)
    t = load_dataset(spark, path)
    return t.groupBy(F.col("side").cast("int").alias("side")).agg(F.count("*").alias("n"), F.sum(scale_qty(F.col("qty"))).alias("qty_scaled"), F.sum(price_truncate(F.col("price"), TICK_SIZE)).alias("price_ticks"), F.min("timestamp").alias("first_ts"))


def _on_tick(engine, tick) -> int:
    """The rules above, placed by a stateful strategy tick by tick."""
    refused = 0
    dear = tick.price
    for i, (kind, least, order, side, qty, share) in enumerate((("purchase", 150, "MARKET", "BUY", 1.5, None), ("click", 150, "MARKET", "SELL", 0.75, None), ("signup", 120, "LIMIT", "BUY", 1.25, 0.05), ("view", 120, "LIMIT", "SELL", 1.0, 1.5))):
        if tick.event_type == kind and dear > least:
            x = dear * share / TICK_SIZE if share else None
            limit = int(x + 0.5) if share else None
            refused += engine.place(Order(int(tick.seq) * 4 + i, order, side, int(qty * 1e6), limit)) != 0
    return refused


def stateful_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Without the kernel's cap on open orders, as in ``ledger_fold_final``: the rules' open orders grow with the run."""
    s = strategy.run(ticks(spark, sf), configs(spark, [RUN]), _on_tick, every_tick=False, extra=("event_type", "price"), max_open=None)
    return s.select("run_id", F.round(F.col("position") * 1e6).cast("long").alias("position_scaled"), money("cash"), F.round("avg_entry_price", 6).alias("average"), F.round("realized_pnl", 6).alias("realized"), money("equity"))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks from a stream over the events file; they are ordered by event_id."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "event_type", (F.col("event_id") + 1).alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("value").alias("price"), price_half_even(F.col("value"), TICK_SIZE).alias("price_tick"), ((k + 1) / 100).alias("qty"), side_of_maker(k % 2 == 1).alias("side"))


def streaming_bucket_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Every bucket once, by partial sums: events come in the order of event_id, which is not that of time."""
    path = scratch(spark, "buckets")
    stream_bucket.bucket_tables(_stream(spark, sf), BUCKET_MS, f"{path}/table", f"{path}/late", f"{path}/state").awaitTermination()
    return stream_bucket.read_buckets(spark.read.parquet(f"{path}/table"))


def streaming_engine(spark: SparkSession, sf: str) -> DataFrame:
    """The market orders of the rules, replayed by the streaming engine: the state after each tick with a fill."""
    s = _stream(spark, sf)
    none = lambda kind: F.lit(None).cast(kind)
    buy = (F.col("event_type") == "purchase") & (F.col("price") > 150)
    sell = (F.col("event_type") == "click") & (F.col("price") > 150)
    tick = F.struct(F.lit("tick").alias("kind"), none("bigint").alias("order_seq"), none("string").alias("order_type"), none("string").alias("side"), none("bigint").alias("qty_scaled"))
    order = F.struct(F.lit("order").alias("kind"), (F.col("seq") * 4 + F.when(buy, 0).otherwise(1)).alias("order_seq"), F.lit("MARKET").alias("order_type"), F.when(buy, "BUY").otherwise("SELL").alias("side"), F.when(buy, 1_500_000).otherwise(750_000).cast("bigint").alias("qty_scaled"))
    rows = s.select("seq", "ts_ms", "price_tick", F.explode(F.when(buy | sell, F.array(tick, order)).otherwise(F.array(tick))).alias("x"))
    feed = rows.select(F.lit("run").alias("run_id"), F.lit("all").alias("symbol"), "x.kind", "seq", "ts_ms", "price_tick", "x.order_seq", "x.order_type", "x.side", "x.qty_scaled", none("bigint").alias("limit_tick"))
    path = scratch(spark, "engine")
    stream_engine.snapshot_tables(feed, f"{path}/table", f"{path}/state", RUN.initial_cash, RUN.taker_fee * 10_000, RUN.spread_bps, RUN.tick_size).awaitTermination()
    out = stream_engine.read_snapshots(spark, f"{path}/table")
    return out.where("n_fills > 0").select("seq", "ts_ms", F.round(F.col("position") * 1e6).cast("long").alias("position_scaled"), money("cash"), F.round("avg_entry_price", 6).alias("average"), "n_fills")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        agg_trades_normalize, price_quantize_modes, tick_bucket_volume, tick_side_rollup, candles_from_ticks, candle_validity_split, ingestion_counters, candle_roundtrip_float,
        candle_files_roundtrip, market_event_union, market_order_fills, limit_order_fills, demo_strategy_fills, cancelled_orders, open_order_peak, position_cash_prefix,
        ledger_fold_final, ledger_fold_compat, param_sweep, equity_curve, drawdown_curve, performance_metrics, trade_metrics, auto_ticksize_price, auto_ticksize_ohlc,
        first_trade_price, parquet_conversion, stateful_strategy, streaming_bucket_volume, streaming_engine,
    )
}

# --- SQL -----------------------------------------------------------------------------------------------------------

_T = """t as (select row_number() over (order by ts, event_id) as seq, row_number() over (partition by user_id order by ts, event_id) as user_seq,
  event_id, event_type, 'u' || user_id as symbol, epoch_us(ts) // 1000 as ts_ms, value as price, round_even(value / 0.01, 0)::bigint as price_tick,
  (regexp_extract(props, '[0-9]+')::int + 1) / 100 as qty, trunc((regexp_extract(props, '[0-9]+')::int + 1) / 100 * 1e6)::bigint as qty_scaled,
  case when regexp_extract(props, '[0-9]+')::int % 2 = 1 then 'SELL' else 'BUY' end as side from events)"""
_O = """o as (select seq * 4 as order_seq, seq as placed, 'MARKET' as order_type, 'BUY' as side, 1500000::bigint as q, null::bigint as lim from t where event_type = 'purchase' and price > 150
  union all select seq * 4 + 1, seq, 'MARKET', 'SELL', 750000, null from t where event_type = 'click' and price > 150
  union all select seq * 4 + 2, seq, 'LIMIT', 'BUY', 1250000, round(price * 0.05 / 0.01)::bigint from t where event_type = 'signup' and price > 120
  union all select seq * 4 + 3, seq, 'LIMIT', 'SELL', 1000000, round(price * 1.5 / 0.01)::bigint from t where event_type = 'view' and price > 120)"""
_HIT = """hit as (select order_seq, placed, order_type, side, q, lim, placed + 1 as fill_seq from o where order_type = 'MARKET'
  union all select o.order_seq, o.placed, o.order_type, o.side, o.q, o.lim, min(t.seq) from o join t on t.seq > o.placed and case when o.side = 'BUY' then t.price_tick <= o.lim else t.price_tick >= o.lim end
  where order_type = 'LIMIT' group by all)"""


def _c(rows: str = "('run', 100000.0::double, 2.0::double, 2.0::double)") -> str:
    return f"c(run_id, initial_cash, taker_bps, spread_bps) as (values {rows})"


_F = """fa as (select c.run_id, order_seq, placed, fill_seq, ts_ms, order_type, hit.side, q, taker_bps, case when order_type = 'MARKET' then price_tick else lim end as base, spread_bps from hit join t on t.seq = fill_seq cross join c),
fb as (select *, case when side = 'BUY' then base + ceil(base::double * (spread_bps / 10000.0))::bigint else base - ceil(base::double * (spread_bps / 10000.0))::bigint end as fill_tick from fa),
fc as (select *, (fill_tick::double * 0.01::double) * (q::double / 1e6) as notional from fb),
f as (select *, notional * (taker_bps / 10000.0) as fee, row_number() over (partition by run_id order by fill_seq, order_seq) as n from fc)"""
_SHOWN = "select order_seq, fill_seq, ts_ms, order_type, side, q as qty_scaled, fill_tick, round(notional, 6) + 0.0 as notional, round(fee, 8) + 0.0 as fee from f"
_FILLS = f"with {_T}, {_O}, {_HIT}, {_c()}, {_F} "


def _r(weighted: bool = True) -> str:
    sq = "case when f.side = 'BUY' then f.q else -f.q end"
    add = sq if weighted else "f.q"
    return f"""r as (select run_id, 0::bigint as n, initial_cash as cash, 0::bigint as pos, 0.0::double as avg, 0.0::double as realized, 0::bigint as seq, 0::bigint as order_seq, 0.0::double as pnl from c
  union all select z.run_id, z.n, z.cash, z.pos, case when z.old = 0 then z.ft when (z.old > 0) = z.buy then coalesce((z.old * z.avg + z.add * z.ft) / nullif(z.pos, 0), z.avg) when z.pos = 0 then 0.0 when (z.pos > 0) <> (z.old > 0) then z.ft else z.avg end,
    z.realized + z.gain, z.seq, z.order_seq, z.realized + z.gain - z.realized from (
    select r.run_id, f.n, case when f.side = 'BUY' then r.cash - (f.notional + f.fee) else r.cash + (f.notional - f.fee) end as cash, r.pos + {sq} as pos, r.pos as old, r.avg, f.side = 'BUY' as buy, {add} as add, f.fill_tick::double as ft, r.realized, f.fill_seq as seq, f.order_seq,
      case when r.pos = 0 or (r.pos > 0) = (f.side = 'BUY') then 0.0 else (least(abs(r.pos), f.q) / 1e6 * f.fill_tick::double * 0.01::double - least(abs(r.pos), f.q) / 1e6 * r.avg * 0.01::double) * (case when r.pos > 0 then 1 else -1 end) end as gain
    from r join f on f.run_id = r.run_id and f.n = r.n + 1) z)"""


def _fold(weighted: bool = True, rows: str | None = None) -> str:
    c = _c(rows) if rows else _c()
    return f"""with recursive {_T}, {_O}, {_HIT}, {c}, {_F}, {_r(weighted)},
e as (select run_id, max(n) as n, arg_max(cash, n) as cash, arg_max(pos, n) as pos, arg_max(avg, n) as avg, arg_max(realized, n) as realized from r group by run_id),
l as (select arg_max(price_tick, seq) as p from t),
u as (select *, case when pos = 0 then 0.0 else pos / 1e6 * p * 0.01::double - pos / 1e6 * avg * 0.01::double end as un from e cross join l) """


_FINAL = "select run_id, n as n_fills, pos as position_scaled, round(cash, 6) + 0.0 as cash, round(avg, 6) + 0.0 as average, round(realized, 6) + 0.0 as realized, round(un, 6) + 0.0 as unrealized, round(cash + un, 6) + 0.0 as equity, round(cash + pos / 1e6 * p * 0.01::double, 6) + 0.0 as equity_mtm from u"
_HIST = f"""with recursive {_T}, {_O}, {_HIT}, {_c()}, {_F}, {_r()},
s as (select run_id, seq, arg_max(cash, n) as cash, arg_max(pos, n) as pos, arg_max(avg, n) as avg from r group by run_id, seq),
h as (select t.seq, t.ts_ms, s.cash, s.pos, s.cash + case when s.pos = 0 then 0.0 else s.pos / 1e6 * t.price_tick * 0.01::double - s.pos / 1e6 * s.avg * 0.01::double end as equity, s.cash + s.pos / 1e6 * t.price_tick * 0.01::double as mtm
  from t asof join s on t.seq >= s.seq),
d as (select seq, mtm, max(mtm) over w as peak, (mtm - max(mtm) over w) / max(mtm) over w as dd, (mtm - lag(mtm) over (order by seq)) / lag(mtm) over (order by seq) as ret from h window w as (order by seq rows between unbounded preceding and current row)) """
_BARS = "b as (select ts_ms - ts_ms % 3600000 as ts_open, arg_min(price_tick, seq) as open_tick, max(price_tick) as high_tick, min(price_tick) as low_tick, arg_max(price_tick, seq) as close_tick, sum(qty_scaled)::bigint as volume_scaled, count(*) as trade_count from t group by 1)"
_STEP = "(case when {v} / pow(10, floor(log10({v}))) <= 1.5 then 1.0 when {v} / pow(10, floor(log10({v}))) <= 3 then 2.0 when {v} / pow(10, floor(log10({v}))) <= 3.5 then 2.5 when {v} / pow(10, floor(log10({v}))) <= 7 then 5.0 else 10.0 end)::double * pow(10, floor(log10({v})))"

ORACLE_SQL: dict[str, str] = {
    "agg_trades_normalize": f"with {_T} select event_id, ts_ms as timestamp, price, qty_scaled, qty_scaled / 1e6 as qty, side, (side = 'SELL')::int as side_code from t",
    "price_quantize_modes": "select event_id, round_even(value / 0.5, 0)::bigint as half_even, round(value / 0.5)::bigint as half_away, trunc(value / 0.5)::bigint as truncated from events",
    "tick_bucket_volume": f"with {_T} select ts_ms - ts_ms % 60000 as ts_ms, price_tick, side, sum(round(qty * 1e6)::bigint)::bigint / 1e6 as qty from t group by all order by 1, 2, 3",
    "tick_side_rollup": f"with {_T}, x as (select ts_ms - ts_ms % 86400000 as ts_ms, side, qty_scaled from t) select coalesce(ts_ms, -1) as ts_ms, coalesce(side, 'both') as side, sum(qty_scaled)::bigint as qty_scaled, count(*) as n from x group by rollup (x.ts_ms, x.side)",
    "candles_from_ticks": f"with {_T} select symbol, ts_ms - ts_ms % 3600000 as ts_open, ts_ms - ts_ms % 3600000 + 3600000 as ts_close, arg_min(price_tick, user_seq) as open_tick, max(price_tick) as high_tick, min(price_tick) as low_tick, arg_max(price_tick, user_seq) as close_tick, sum(qty_scaled)::bigint as volume_scaled, count(*) as trade_count from t group by 1, 2, 3",
    "candle_validity_split": f"with {_T}, {_BARS} select not (trade_count <= 5 or trade_count = 8 or trade_count = 10) as is_valid, count(*) as n, sum(trade_count)::bigint as trades from b group by 1",
    "ingestion_counters": f"with {_T}, {_BARS}, x as (select trade_count <= 5 or trade_count = 8 or trade_count = 10 as bad from b) select count(*) filter (not bad) as candles_processed, 0::bigint as candles_rejected, count(*) filter (bad) as parse_errors, count(*) filter (bad) as invalid_candles from x",
    "candle_roundtrip_float": f"with {_T}, {_BARS} select ts_open, open_tick, high_tick, low_tick, close_tick, volume_scaled from b",
    "candle_files_roundtrip": f"with {_T}, {_BARS} select ts_open, ts_open + 60000 as ts_close, open_tick, high_tick, low_tick, close_tick, volume_scaled, trade_count, file from b cross join (values ('a.ndjson'), ('b.csv')) v(file)",
    "market_event_union": f"with {_T}, {_BARS} select 'trade' as kind, true as is_trade, false as is_bar, count(*) as n, min(ts_ms) as first_ts, max(ts_ms) as last_ts from t union all select 'bar', false, true, count(*), min(ts_open), max(ts_open) from b",
    "market_order_fills": _FILLS + _SHOWN + " where order_type = 'MARKET'",
    "limit_order_fills": _FILLS + _SHOWN + " where order_type = 'LIMIT'",
    "demo_strategy_fills": f"""with {_T}, p as (select symbol, min(user_seq) + 1 as fill_seq from t where side = 'BUY' group by 1),
g as (select p.symbol, fill_seq, ts_ms, price_tick + ceil(price_tick::double * (2.0 / 10000.0))::bigint as fill_tick from p join t on t.symbol = p.symbol and t.user_seq = fill_seq)
select symbol, fill_seq, ts_ms, 'BUY' as side, 100000::bigint as qty_scaled, fill_tick, round((fill_tick::double * 0.01::double) * (100000::double / 1e6), 6) + 0.0 as notional, round((fill_tick::double * 0.01::double) * (100000::double / 1e6) * (2.0::double / 10000.0), 8) + 0.0 as fee from g""",
    "cancelled_orders": _FILLS + _SHOWN + " where order_type = 'LIMIT' and fill_seq <= placed + 40",
    "open_order_peak": _FILLS + ", x as (select placed as seq, 1 as d from o union all select fill_seq, -1 from f), y as (select seq, sum(d) as d from x group by seq), z as (select sum(d) over (order by seq) as open from y) select 'run' as run_id, max(open)::bigint as peak_open, max(open) > 1024 as over_cap from z",
    "position_cash_prefix": _FILLS + "select order_seq, fill_seq, sum(case when side = 'BUY' then q else -q end) over w::bigint as position_scaled, round(100000.0::double + sum(case when side = 'BUY' then -(notional + fee) else notional - fee end) over w, 3) + 0.0 as cash from f window w as (order by n rows between unbounded preceding and current row)",
    "ledger_fold_final": _fold() + _FINAL,
    "ledger_fold_compat": _fold(False) + _FINAL,
    "param_sweep": _fold(rows="('a', 100000.0::double, 2.0::double, 0.0::double), ('b', 100000.0, 2.0, 2.0), ('c', 50000.0, 10.0, 10.0)") + _FINAL,
    "equity_curve": _HIST + "select seq, ts_ms, pos as position_scaled, round(cash, 4) + 0.0 as cash, round(equity, 4) + 0.0 as equity, round(mtm, 4) + 0.0 as equity_mtm from h",
    "drawdown_curve": _HIST + "select seq, round(peak, 4) + 0.0 as peak, round(dd, 8) + 0.0 as drawdown, round(ret, 8) + 0.0 as ret from d",
    "performance_metrics": _HIST + "select 'run' as run_id, count(*) as n_snapshots, round(arg_min(mtm, seq), 6) + 0.0 as initial_equity, round((arg_max(mtm, seq) - arg_min(mtm, seq)) / arg_min(mtm, seq), 8) + 0.0 as total_return, round(min(dd), 8) + 0.0 as max_drawdown, round(avg(ret) / stddev_pop(ret) * sqrt(252.0), 5) + 0.0 as sharpe_ratio from d",
    "trade_metrics": _HIST + "select run_id, count(*) as total_trades, round(avg((pnl > 0)::int), 8) + 0.0 as win_rate, round(avg(pnl), 6) + 0.0 as mean_pnl, round(sum(pnl) filter (pnl > 0) / abs(sum(pnl) filter (pnl < 0)), 6) + 0.0 as profit_factor from r where pnl <> 0 group by 1",
    "auto_ticksize_price": "select event_id, round(" + _STEP.format(v="(value * 0.002::double / 20.0::double)") + ", 9) + 0.0 as tick_size from events where value > 0",
    "auto_ticksize_ohlc": f"""with {_T}, b as (select symbol, ts_ms - ts_ms % 3600000 as ts_open, max(price_tick) * 0.01::double as high, min(price_tick) * 0.01::double as low from t group by 1, 2),
k as (select *, row_number() over (partition by symbol order by ts_open desc) as k from b),
m as (select symbol, median(high - low) filter (k <= 100) as med, max(high) - min(low) as whole from k group by 1), x as (select symbol, case when med > 0 then med else whole end as range from m)
select symbol, round(range, 6) + 0.0 as range, case when range > 0 then round({_STEP.format(v="(range / 20.0::double)")}, 9) + 0.0 end as tick_size from x""",
    "first_trade_price": f"with {_T} select arg_min(price, seq) as first_price from t",
    "parquet_conversion": f"with {_T} select (side = 'SELL')::int as side, count(*) as n, sum(qty_scaled)::bigint as qty_scaled, sum(trunc(price / 0.01)::bigint)::bigint as price_ticks, min(ts_ms) as first_ts from t group by 1",
    "stateful_strategy": _fold() + "select run_id, pos as position_scaled, round(cash, 6) + 0.0 as cash, round(avg, 6) + 0.0 as average, round(realized, 6) + 0.0 as realized, round(cash + un, 6) + 0.0 as equity from u",
    "streaming_bucket_volume": f"with {_T} select ts_ms - ts_ms % 60000 as ts_ms, price_tick, side, sum(round(qty * 1e6)::bigint)::bigint / 1e6 as qty from t group by all",
    "streaming_engine": f"with recursive {_T}, {_O.replace('o as (', 'o_all as (', 1)}, o as (select * from o_all where order_type = 'MARKET'), {_HIT}, {_c()}, {_F}, {_r()} select r.seq, t.ts_ms, arg_max(pos, n) as position_scaled, round(arg_max(cash, n), 6) + 0.0 as cash, round(arg_max(avg, n), 6) + 0.0 as average, count(*) as n_fills from r join t on t.seq = r.seq where n > 0 group by 1, 2",
}
