"""Registered queries of sources, sinks, streams and runs as objects, and the SQL that expresses them."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.engine import Backtest
from tickspark.functions.quantize import ms_to_timestamp, order_type_number, price_truncate, scale_qty, side_number
from tickspark.operators import events, fills, metrics
from tickspark.operators.orders import accepted, normalise
from tickspark.sources import sinks, synthetic, trades
from tickspark.sources.candle_files import read_candles
from tickspark.sources.schema import configs
from tickspark.sources.scratch import scratch, stored
from tickspark.streaming import bucket as stream_bucket
from tickspark.streaming import feeder

from . import queries as q
from .market import TICK_SIZE, plain_ticks, ticks
from .market import trades as market_trades

CODECS = ("zstd", "snappy", "gzip", None)
#: Open orders that the query of the cap allows; the kernel's own cap is never reached by these tables.
CAP = 4
LATE_MS = 120_000


def _csv(spark: SparkSession, sf: str) -> str:
    """The trades as CSV, as they come from an exchange."""
    path = scratch(spark, "agg-trades")
    market_trades(spark, sf).select("timestamp", "price", "qty", "is_buyer_maker").write.option("header", True).csv(path)
    return path


def csv_trades_feed(spark: SparkSession, sf: str) -> DataFrame:
    t = trades.feed(spark, "aggtrades_csv", path=_csv(spark, sf), tick_size=0.5)
    return t.select("seq", "ts_ms", "price_tick", q.money("qty"), "side")


def csv_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV converted with every codec, and how many rows differ from the CSV."""
    path = _csv(spark, sf)
    plain = trades.read_agg_trades_csv(spark, path).select("timestamp", "price", "qty", F.col("is_buyer_maker").cast("byte").alias("side"))
    out = None
    for codec in CODECS:
        t = trades.load_dataset(spark, trades.convert_to_parquet(spark, path, scratch(spark, "converted"), codec))
        gone = trades.integrity(t, plain)
        rows = t.groupBy(F.col("side").cast("int").alias("side")).agg(F.count("*").alias("n"), F.sum(scale_qty(F.col("qty"))).alias("qty_scaled"), F.sum(price_truncate(F.col("price"), TICK_SIZE)).alias("price_ticks"), F.min("timestamp").alias("first_ts"))
        rows = rows.select(F.lit(codec or "none").alias("codec"), "*", F.lit(gone["only_left"] + gone["only_right"]).cast("long").alias("differing"))
        out = rows if out is None else out.unionByName(rows)
    return out


def batch_ticks_feed(spark: SparkSession, sf: str) -> DataFrame:
    path = trades.convert_to_parquet(spark, _csv(spark, sf), scratch(spark, "converted"))
    return trades.batch_ticks(trades.load_dataset(spark, path), 0.5).select("seq", "ts_ms", "price_tick", q.money("qty"), "side")


def array_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The ticks of each user as one batch of arrays, and unpacked again."""
    t = plain_ticks(spark, sf, True)
    names = ("ts_ms", "price_tick", "qty", "side")
    packed = t.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", *names))).alias("x"))
    packed = packed.select("symbol", *[F.col("x").getField(n).alias(n) for n in names])
    return trades.unpack_batches(packed, names).select("symbol", (F.col("place") + 1).cast("long").alias("seq"), "ts_ms", "price_tick", q.money("qty"), "side")


def candle_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Candles under other names in CSV and NDJSON, some spoilt, and the reasons that they are rejected for."""
    c = q.odd_candles(spark, sf)
    n = F.col("trade_count")
    cells = [F.when(n == 7, F.lit("x")).otherwise(F.col("open").cast("string")), *[F.col(k).cast("string") for k in ("high", "low", "close")], F.when(n == 9, F.lit("")).otherwise(F.col("volume").cast("string")), n.cast("string")]
    line = F.when(n == 6, F.lit("1,2")).otherwise(F.concat_ws(",", F.col("ts_open").cast("string"), F.col("ts_close").cast("string"), *cells))
    path = scratch(spark, "candles")
    head = spark.createDataFrame([("open_time,close_time,open_price,h,low,c,base_volume,count",)], "value string")
    # A header has to be the first line of its file, so this file is written by one task.
    lines = c.select(line.alias("value")).unionByName(head)
    lines.coalesce(1).sortWithinPartitions(F.desc(F.col("value").startswith("open_time"))).write.text(f"{path}/a.csv")
    json_line = F.when(n == 6, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("ts_open").alias("ts"), F.col("ts_close").alias("close_time"), F.when(n != 7, F.col("open")).alias("o"), F.col("high").alias("high_price"), F.col("low").alias("l"), F.col("close").alias("close_price"), F.col("volume").alias("v"), n.alias("num_trades"))))
    c.select(json_line.alias("value")).write.text(f"{path}/b.ndjson")
    out = None
    for name in ("a.csv", "b.ndjson"):
        good, bad = read_candles(spark, f"{path}/{name}", TICK_SIZE)
        kind = F.when(F.col("error_kind") == "InvalidValue", F.concat_ws(" ", "error_kind", F.col("error_detail"))).otherwise(F.col("error_kind"))
        rows = bad.groupBy(kind.alias("reason")).count().unionByName(good.agg(F.count("*").alias("count")).select(F.lit("none").alias("reason"), "count"))
        rows = rows.select(F.lit(name).alias("file"), "reason", F.col("count").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def observed_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that are filled while the candles are handed on as events."""
    from tickspark.functions import candles as candle

    rows = q.odd_candles(spark, sf).withColumn("error_kind", F.when(~candle.valid_prices(), "InvalidCandle"))
    seen, counts = events.observed(rows)
    good = candle.to_ticks(seen.where("error_kind is null"), TICK_SIZE)
    n = events.bar_events(good).agg(F.count("*").alias("n"), F.min(events.timestamp()).alias("first_ts")).first()
    got = counts.get
    return spark.createDataFrame([(got["candles_processed"], got["parse_errors"], n["n"], n["first_ts"])], "candles_processed long, parse_errors long, n_events long, first_ts long")


def candle_stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Candles and broken lines that arrive as files, handed on in micro-batches; the callback fails on the first batch."""
    c = q.candle.to_prices(q.candles(spark, sf), TICK_SIZE)
    path = scratch(spark, "candle-stream")
    line = F.when(F.col("trade_count") == 6, F.lit("{broken")).otherwise(F.to_json(F.struct("ts_open", "ts_close", "open", "high", "low", "close", "volume", "trade_count")))
    c.repartition(3, "ts_open").select(line.alias("value")).write.text(f"{path}/in")
    taken, failed = [], []

    def on_events(df: DataFrame) -> None:
        n = df.agg(F.count("*")).first()[0]
        if not failed:
            failed.append(n)
            raise RuntimeError("the first batch fails")
        taken.append(n)

    rows = feeder.candle_stream(spark, f"{path}/in", TICK_SIZE, max_files=1)
    stream, counters = feeder.feed_candles(rows, on_events, f"{path}/state", f"{path}/rejects")
    stream.awaitTermination()
    rejects = spark.read.parquet(f"{path}/rejects").count()
    return spark.createDataFrame([(counters.candles_processed, counters.candles_rejected, counters.parse_errors, counters.callback_errors, sum(taken) + sum(failed), rejects)], "candles_processed long, candles_rejected long, parse_errors long, callback_errors long, n_events long, n_rejects long")


def streaming_bucket_late(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks that arrive in the order of event_id, in one batch: buckets of all ticks, kept as partial sums."""
    path = scratch(spark, "late")
    s = q._stream(spark, sf)
    stream_bucket.bucket_tables(s, q.BUCKET_MS, f"{path}/table", f"{path}/late", f"{path}/state", LATE_MS).awaitTermination()
    table = spark.read.parquet(f"{path}/table")
    return stream_bucket.read_buckets(table).withColumn("late", F.lit(spark.read.schema(s.schema).parquet(f"{path}/late").count()).cast("long"))


def synthetic_trades(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for generated trades, whose values are random."""
    t = synthetic.agg_trades(spark, 100_000)
    step = F.col("timestamp") - F.lit(1_704_067_200_000)
    return t.agg(F.count("*").alias("n"), F.min(step).alias("first"), F.max(step).alias("last"), F.count_distinct("timestamp").alias("times"), F.count_if(F.col("price") <= 0).alias("unpriced"), F.count_if(F.col("qty") < 0).alias("negative"), (F.abs(F.avg(F.col("is_buyer_maker").cast("int")) - 0.5) < 0.01).alias("fair"), (F.abs(F.avg("qty") - 0.05) < 0.001).alias("mean_qty"))


def tag_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose tags are written in other cases, and their codes."""
    o = q.orders(ticks(spark, sf))
    raw = o.select("run_id", "symbol", "order_seq", "placed_after_seq", F.initcap("order_type").alias("order_type"), F.lower("side").alias("side"), (F.col("qty_scaled") / 1e6).alias("qty"), (F.col("limit_tick") * TICK_SIZE).alias("price"))
    n = normalise(raw, TICK_SIZE)
    return n.groupBy(side_number(F.col("side")).alias("side"), order_type_number(F.col("order_type")).alias("order_type")).agg(F.count("*").alias("n"), F.sum("qty_scaled").alias("qty_scaled"), F.sum("limit_tick").alias("limit_ticks"))


def order_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Fills when no more than ``CAP`` orders may be open."""
    t = ticks(spark, sf)
    o = q.orders(t)
    f = fills.fills(o, t, configs(spark, [q.RUN]))
    return q._shown(accepted(f, o, most=CAP))


def _run(spark: SparkSession, sf: str) -> Backtest:
    t = ticks(spark, sf)
    return Backtest(spark, t, q.orders(t), [q.RUN])


def backtest_trades(spark: SparkSession, sf: str) -> DataFrame:
    t = _run(spark, sf).trades()
    return t.select("order_seq", "fill_seq", "side", "qty_scaled", "fill_tick", F.col("position").alias("position_scaled"), q.money("cash", 4), q.money("average", 4), q.money("pnl", 4))


def backtest_reset(spark: SparkSession, sf: str) -> DataFrame:
    """The last snapshot of a run, and of the same run after a reset."""
    b = _run(spark, sf)
    out = None
    for k, run in enumerate((b, b.reset())):
        s = run.snapshot().select(F.lit(k).alias("attempt"), "run_id", "n_fills", F.round(F.col("position") * 1e6).cast("long").alias("position_scaled"), q.money("cash"), q.money("equity"))
        out = s if out is None else out.unionByName(s)
    return out


def _result(spark: SparkSession, sf: str, aliases: bool = False) -> sinks.BacktestResult:
    """Snapshots by market value and the trades that realized something; under their other names, if asked for."""
    h, t = (stored(x, "history") for x in q._history(spark, sf))
    h, t = h.drop("equity").withColumnRenamed("equity_mtm", "value" if aliases else "equity"), t.where("pnl <> 0")
    return sinks.BacktestResult(h, t.withColumnRenamed("pnl", "profit") if aliases else t)


def summary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded metrics of a run, of the same run under other names, of a run without trades, and of no run."""
    r, other = _result(spark, sf), _result(spark, sf, True)
    quiet = sinks.BacktestResult(r.snapshots, r.trades.limit(0))
    none = sinks.BacktestResult(r.snapshots.limit(0), r.trades.limit(0))
    rows = [(n, *[float(x.metrics()[k]) for k in metrics.DECIMALS]) for n, x in (("run", r), ("aliases", other), ("quiet", quiet), ("none", none))]
    return spark.createDataFrame(rows, "run string, " + ", ".join(f"{k} double" for k in metrics.DECIMALS))


def summary_text(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the text summary and of the metrics of a tear sheet."""
    r = _result(spark, sf)
    rows = [("summary", i, x) for i, x in enumerate(r.summary().split("\n"))]
    rows += [("sheet", i, ": ".join(x)) for i, x in enumerate(sinks.shown(r.metrics(), sinks.SHEET))]
    return spark.createDataFrame(rows, "part string, line int, text string")


def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a result, read again: metrics as JSON, the equity curve and the tables of the tear sheet as CSV."""
    r = _result(spark, sf)
    folder = mkdtemp(prefix="result") if spark.sparkContext.master.startswith("local") else None
    path = folder or scratch(spark, "result")
    r.to_csv(f"{path}/equity")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/equity")
    rows = back.agg(F.count("*").alias("n"), F.round(F.sum(F.round("equity", 4)), 2).alias("total"), F.min("timestamp").alias("first_ts")).select(F.lit("equity").alias("file"), "*")
    if folder:  # a tear sheet goes to the driver's disk
        sheet = sinks.tearsheet(r, f"{folder}/sheet")
        c = spark.read.option("header", True).option("inferSchema", True).csv(f"{sheet}/equity.csv")
        rows = rows.unionByName(c.agg(F.count("*").alias("n"), F.round(F.min("drawdown"), 4).alias("total"), F.min("timestamp").alias("first_ts")).select(F.lit("sheet").alias("file"), "*"))
        m = json.loads(Path(f"{sheet}/metrics.json").read_text())
        rows = rows.unionByName(spark.createDataFrame([("metrics", len(m), float(m["total_return"]), None)], "file string, n long, total double, first_ts long"))
    return rows


def trade_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Markers of trades, whose sides have other names, by the minute."""
    f = q._fills(spark, sf)
    name = F.when(F.col("order_seq") % 3 == 0, F.when(F.col("side") == "BUY", "Long").otherwise("Short")).otherwise(F.lower("side"))
    minute = F.date_format(F.date_trunc("minute", ms_to_timestamp(F.col("ts_ms"))), "yyyy-MM-dd HH:mm")
    return f.groupBy(minute.alias("minute"), sinks.marker_side(name).alias("marker")).agg(F.count("*").alias("n"), F.max("fill_tick").alias("highest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        csv_trades_feed, csv_conversion, batch_ticks_feed, array_batches, candle_rejects, observed_counters, candle_stream_counters, streaming_bucket_late, synthetic_trades,
        tag_codes, order_cap, backtest_trades, backtest_reset, summary_metrics, summary_text, result_files, trade_markers,
    )
}

# --- SQL -----------------------------------------------------------------------------------------------------------

_T = q._T
_FEED = "with {t} select row_number() over (order by ts_ms, price, qty, side) as seq, ts_ms, {tick}::bigint as price_tick, round(qty, 6) + 0.0 as qty, side from t"
_METRICS = """m as (select round_even((arg_max(mtm, seq) - arg_min(mtm, seq)) / arg_min(mtm, seq), 4) as total_return, round_even(min(dd), 4) as max_drawdown, round_even(avg(ret) / stddev_pop(ret) * sqrt(252.0), 2) as sharpe_ratio, arg_min(mtm, seq) as first from d),
k as (select count(*) as total_trades, round_even(avg((pnl > 0)::int), 4) as win_rate, avg(pnl) as mean_pnl, round_even(sum(pnl) filter (pnl > 0) / abs(sum(pnl) filter (pnl < 0)), 2) as profit_factor from r where pnl <> 0),
x as (select *, round_even(mean_pnl / first, 6) as avg_trade from m cross join k) """
_MARK = "strftime(date_trunc('minute', make_timestamp(ts_ms * 1000)), '%Y-%m-%d %H:%M')"

ORACLE_SQL: dict[str, str] = {
    "csv_trades_feed": _FEED.format(t=_T, tick="round_even(price / 0.5, 0)"),
    "batch_ticks_feed": _FEED.format(t=_T, tick="trunc(price / 0.5)"),
    "csv_conversion": f"with {_T} select codec, (side = 'SELL')::int as side, count(*) as n, sum(qty_scaled)::bigint as qty_scaled, sum(trunc(price / 0.01)::bigint)::bigint as price_ticks, min(ts_ms) as first_ts, 0::bigint as differing from t cross join (values ('zstd'), ('snappy'), ('gzip'), ('none')) v(codec) group by 1, 2",
    "array_batches": f"with {_T} select symbol, user_seq as seq, ts_ms, price_tick, round(qty, 6) + 0.0 as qty, side from t",
    "candle_rejects": f"""with {_T}, {q._BARS}, v as (select trade_count as n, trade_count <= 5 or trade_count in (8, 10) as invalid from b),
w as (select 'a.csv' as file, case when n = 6 then 'Csv' when n = 7 then 'InvalidValue open: x' when n = 9 then 'InvalidValue volume: ' when invalid then 'InvalidCandle' else 'none' end as reason from v
  union all select 'b.ndjson', case when n in (6, 7) then 'Json' when invalid then 'InvalidCandle' else 'none' end from v)
select file, reason, count(*) as n from w group by 1, 2 union all select f, 'none', 0 from (values ('a.csv'), ('b.ndjson')) z(f) where not exists (select 1 from w where file = f and reason = 'none')""",
    "observed_counters": f"with {_T}, {q._BARS}, x as (select *, trade_count <= 5 or trade_count in (8, 10) as bad from b) select count(*) filter (not bad) as candles_processed, count(*) filter (bad) as parse_errors, count(*) filter (not bad) as n_events, min(ts_open) filter (not bad) as first_ts from x",
    "candle_stream_counters": f"with {_T}, {q._BARS} select count(*) filter (trade_count <> 6) as candles_processed, 0::bigint as candles_rejected, count(*) filter (trade_count = 6) as parse_errors, 1::bigint as callback_errors, count(*) filter (trade_count <> 6) as n_events, count(*) filter (trade_count = 6) as n_rejects from b",
    "streaming_bucket_late": f"with {_T} select ts_ms - ts_ms % 60000 as ts_ms, price_tick, side, sum(round(qty * 1e6)::bigint)::bigint / 1e6 as qty, 0::bigint as late from t group by all",
    "synthetic_trades": "select 100000::bigint as n, 0::bigint as first, 4999950::bigint as last, 100000::bigint as times, 0::bigint as unpriced, 0::bigint as negative, true as fair, true as mean_qty",
    "tag_codes": f"with {_T}, {q._O} select (side = 'SELL')::int as side, (order_type = 'MARKET')::int as order_type, count(*) as n, sum(q)::bigint as qty_scaled, sum(lim)::bigint as limit_ticks from o group by 1, 2",
    "order_cap": f"""with recursive {_T}, {q._O}, {q._HIT}, {q._c()}, {q._F},
p as (select o.order_seq, o.placed, coalesce(f.fill_seq, 4000000000) as e, row_number() over (order by o.placed, o.order_seq) as i from o left join f using (order_seq)),
g as (select 0::bigint as i, []::bigint[] as ends, null::bigint as taken
  union all select p.i, case when len(list_filter(g.ends, lambda y: y > p.placed)) < {CAP} then list_append(list_filter(g.ends, lambda y: y > p.placed), p.e) else list_filter(g.ends, lambda y: y > p.placed) end,
    case when len(list_filter(g.ends, lambda y: y > p.placed)) < {CAP} then p.order_seq end from g join p on p.i = g.i + 1)
{q._SHOWN} where order_seq in (select taken from g)""",
    "backtest_trades": q._HIST + "select f.order_seq, f.fill_seq, f.side, f.q as qty_scaled, f.fill_tick, r.pos as position_scaled, round(r.cash, 4) + 0.0 as cash, round(r.avg, 4) + 0.0 as average, round(r.pnl, 4) + 0.0 as pnl from f join r on r.n = f.n",
    "backtest_reset": q._fold() + "select k::int as attempt, run_id, n as n_fills, pos as position_scaled, round(cash, 6) + 0.0 as cash, round(cash + un, 6) + 0.0 as equity from u cross join (values (0), (1)) v(k)",
    "summary_metrics": q._HIST + ", " + _METRICS + """select run, total_return, max_drawdown, sharpe_ratio, win_rate::double as win_rate, total_trades::double as total_trades, avg_trade, profit_factor from x cross join (values ('run'), ('aliases')) v(run)
union all select 'quiet', total_return, max_drawdown, sharpe_ratio, 0, 0, 0, 0 from x union all select 'none', 0, 0, 0, 0, 0, 0, 0""",
    "summary_text": q._HIST + ", " + _METRICS + """select 'summary' as part, unnest([0, 1, 2, 3, 4, 5, 6, 7])::int as line, unnest(['Backtest Results:', '-----------------', printf('Total Return: %.2f%%', total_return * 100), printf('Max Drawdown: %.2f%%', max_drawdown * 100), printf('Sharpe Ratio: %.2f', sharpe_ratio),
  printf('Win Rate: %.2f%%', win_rate * 100), 'Total Trades: ' || total_trades, printf('Avg Trade: %.4f', avg_trade)]) as text from x
union all select 'sheet', unnest([0, 1, 2, 3, 4, 5, 6])::int, unnest([printf('Total Return: %.2f%%', total_return * 100), printf('Max Drawdown: %.2f%%', max_drawdown * 100), printf('Sharpe Ratio: %.2f', sharpe_ratio), printf('Win Rate: %.1f%%', win_rate * 100), 'Total Trades: ' || total_trades,
  printf('Avg Trade: %.3f%%', avg_trade * 100), printf('Profit Factor: %.2f', profit_factor)]) from x""",
    "result_files": q._HIST + "select 'equity' as file, count(*) as n, round(sum(round(mtm, 4)), 2) as total, min(ts_ms) as first_ts from h union all select 'sheet', count(*), round(min(dd) * 100, 4), (select min(ts_ms) from h) from d union all select 'metrics', 7, round_even((arg_max(mtm, seq) - arg_min(mtm, seq)) / arg_min(mtm, seq), 4), null from d",
    "trade_markers": q._FILLS + f"select {_MARK} as minute, case when side = 'BUY' then 'buy' else 'sell' end as marker, count(*) as n, max(fill_tick) as highest from f group by 1, 2",
}
