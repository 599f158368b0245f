import json

from pyspark.sql import functions as F

from tickspark.operators.bucket import aggregate_ticks
from tickspark.streaming import bucket, engine, feeder
from tickspark.sources.schema import RunConfig

from .test_engine import kernel_config, random_run
from tickspark.operators.kernel import Engine, Order

TICK = "ts_ms long, price_tick long, qty double, side string"


def test_stream_buckets_equal_batch(spark, tmp_path):
    rows = [(1_600_000_000_000 + i * 137, 100 + i % 3, 0.5 + i % 4, "BUY" if i % 2 else "SELL") for i in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], TICK).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    s = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = bucket.aggregate_ticks(s, 1000, "1 second").writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, aggregate_ticks(spark.createDataFrame(rows, TICK), 1000).collect()))
    got = sorted(map(tuple, spark.table("buckets").collect()))
    assert set(got) <= set(want) and len(got) > 0.8 * len(want)  # the last buckets are not finished
    # Late rows go to a table of their own; sums and late rows together are all rows.
    late = [(1_600_000_000_000, 7, 1.0, "BUY"), (1_600_000_000_001, 7, 2.0, "BUY")]
    spark.createDataFrame(late, TICK).coalesce(1).write.parquet(str(tmp_path / "in" / "z"))
    out = [str(tmp_path / x) for x in ("table", "late", "state")]
    bucket.bucket_tables(s, 1000, *out, delay_ms=1000).awaitTermination()
    assert sorted(map(tuple, bucket.read_buckets(spark.read.parquet(out[0])).collect())) == want
    assert sorted(map(tuple, spark.read.schema(TICK).parquet(out[1]).drop("batch").collect())) == late


def test_engine_stream_equals_kernel_over_any_split(spark, tmp_path):
    config = RunConfig(initial_cash=10_000.0, spread_bps=3.0)
    rows, want = [], {}
    for s in range(2):
        e, seq, n = Engine(**kernel_config(config)), 0, 0
        for x in random_run(s, 60, 20):
            if x[0] == "tick":
                seq += 1
                rows.append(("run", f"s{s}", "tick", seq, x[1], x[2], None, None, None, None, None))
                e.step(x[1], x[2])
                want[f"s{s}", seq] = (e.snapshot()["cash"], e.snapshot()["equity"])
            else:
                limit = None if x[4] is None else int(x[4] * 100 + 0.5)
                e.place(Order(n, x[1], x[2], int(x[3] * 1e6), limit))
                rows.append(("run", f"s{s}", "order", seq, 0, 0, n, x[1], x[2], int(x[3] * 1e6), limit))
                n += 1
    rows.sort(key=lambda r: (r[3], r[2] == "order", r[1], r[6] or 0))
    cuts = [0, 31, 32, 90, len(rows)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:b], engine.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    s = spark.readStream.schema(engine.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = engine.run(s, config.initial_cash, config.taker_fee * 10_000, config.spread_bps, config.tick_size)
    out.writeStream.format("memory").queryName("engine").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["symbol"], r["seq"]): (r["cash"], r["equity"]) for r in spark.table("engine").collect()}
    assert got == want


def test_feeder_counts_rejects_and_goes_on(spark, tmp_path):
    good = {"ts_open": 1609459200000, "open": 1.0, "high": 2.0, "low": 1.0, "close": 1.5, "volume": 1}
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.ndjson").write_text("\n".join([json.dumps(good | {"ts_open": good["ts_open"] + k}), "{broken", ""]))
    seen = []

    def on_events(df):
        seen.extend(r["ts"] for r in df.collect())
        if len(seen) == 1:
            raise RuntimeError("the callback fails once")

    rows = feeder.candle_stream(spark, str(tmp_path / "in"), 0.5, max_files=1)
    q, counters = feeder.feed_candles(rows, on_events, str(tmp_path / "c"), str(tmp_path / "rejects"))
    q.awaitTermination()
    assert len(seen) == 3 and (counters.candles_processed, counters.parse_errors, counters.candles_rejected, counters.callback_errors) == (3, 3, 0, 1)
    assert spark.read.parquet(str(tmp_path / "rejects")).where(F.col("error_kind") == "Json").count() == 3
