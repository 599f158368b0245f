import pytest

from tickspark.operators import events
from tickspark.sources import candle_files, synthetic, trades

CSV = "timestamp,price,qty,is_buyer_maker\n1704067200050,42151.00,0.018,false\n1704067200000,42150.50,0.025,true\n1704067200100,42150.75,0.032,1\n1704067200150,42152.25,0.041,0\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_trades_csv(spark, tmp_path):
    p = write(tmp_path / "t.csv", CSV)
    t = trades.agg_trades_feed(spark, p, 0.5).orderBy("seq").collect()
    assert [(r["ts_ms"], r["price_tick"], r["side"]) for r in t] == [(1704067200000, 84301, "SELL"), (1704067200050, 84302, "BUY"), (1704067200100, 84302, "SELL"), (1704067200150, 84304, "BUY")]
    assert trades.feed(spark, "aggtrades_csv", path=p, tick_size=1.0).count() == 4
    trades.register_feed("mine", lambda spark, n: spark.range(n))
    assert trades.feed(spark, "mine", n=3).count() == 3
    with pytest.raises(FileNotFoundError):
        trades.read_agg_trades_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="qty"):
        trades.read_agg_trades_csv(spark, write(tmp_path / "bad.csv", "timestamp,price,is_buyer_maker\n1,2,true\n"))
    extra = write(tmp_path / "x.csv", "id,price,timestamp,qty,is_buyer_maker\n7,1.5,10,2,true\n")
    assert tuple(trades.read_agg_trades_csv(spark, extra).first()) == (10, 1.5, 2.0, True)


@pytest.mark.parametrize("codec", ["zstd", "snappy", "gzip", None])
def test_conversion_round_trip(spark, tmp_path, codec):
    p = write(tmp_path / "t.csv", CSV)
    out = trades.convert_to_parquet(spark, p, str(tmp_path / "t.parquet"), codec)
    back = trades.load_dataset(spark, out)
    want = trades.read_agg_trades_csv(spark, p).selectExpr("timestamp", "price", "qty", "cast(is_buyer_maker as tinyint) side")
    assert trades.integrity(back, want) == {"only_left": 0, "only_right": 0}
    assert dict(back.dtypes)["side"] == "tinyint" and (tmp_path / "t.csv").exists()
    assert [r["price_tick"] for r in trades.batch_ticks(back, 1.0).orderBy("seq").collect()] == [42150, 42151, 42150, 42152]
    with pytest.raises(ValueError):
        trades.convert_to_parquet(spark, p, str(tmp_path / "u"), "lzma")
    with pytest.raises(FileNotFoundError):
        trades.load_dataset(spark, str(tmp_path / "none"))


def test_candle_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", "timestamp, open ,high,low,close,volume\n1609459200000,42000.5,42500.0,41500.0,42200.0,1500.5\n1609459260000, 42200.0,42800.0,42100.0,42700.0,2000.3\n1609459320000,42500,42000,41000,42000,1\n1609459320000,x,42000,41000,42000,1\n1609459320000,1,2\n1609459320000,1,1,1,1,\n")
    good, bad = candle_files.read_candles(spark, p, 0.5)
    rows = good.orderBy("ts_open").collect()
    assert [(r["ts_open"], r["ts_close"], r["open_tick"], r["trade_count"]) for r in rows] == [(1609459200000, 1609459260000, 84001, 0), (1609459260000, 1609459320000, 84400, 0)]
    assert sorted(r["error_kind"] for r in bad.collect()) == ["Csv", "InvalidCandle", "InvalidValue", "InvalidValue"]
    counts = events.ingestion(candle_files.candle_rows(spark, p, 0.5)).first()
    assert tuple(counts) == (2, 0, 4, 1)


def test_candle_csv_headers(spark, tmp_path):
    p = write(tmp_path / "b.csv", "close_time,o,h,l,c,vol,num_trades\n1609459260000,42000,42500,41500,42200,1500,7\n")
    r = candle_files.read_candles(spark, p, 1.0)[0].first()
    assert (r["ts_open"], r["open_tick"], r["high_tick"], r["trade_count"]) == (1609459200000, 42000, 42500, 7)
    with pytest.raises(ValueError, match="HeaderMapping"):
        candle_files.read_candles(spark, write(tmp_path / "c.csv", "ts,o,h,l\n1,1,1,1\n"), 1.0)
    good, bad = candle_files.read_candles(spark, write(tmp_path / "d.csv", "o,h,l,c,v\n1,1,1,1,1\n"), 1.0)
    assert good.count() == 0 and bad.first()["error_kind"] == "MissingField"
    with pytest.raises(ValueError, match="file_extension"):
        candle_files.read_candles(spark, write(tmp_path / "e.CSV", ""), 1.0)


def test_candle_json(spark, tmp_path):
    p = write(tmp_path / "a.ndjson", '{"ts_open":1609459200000,"ts_close":1609459260000,"open":42000,"high":42500,"low":41500,"close":42200,"volume":1500.5}\n{"t":1,"time":1609459260000,"o":42200,"h":42800,"l":42100,"c":42700,"v":2000,"trades":3}\n{"open":1,"high":1,"low":1,"close":1,"volume":1}\n{"time":1,"open":2,"high":\n{"time":5,"open":2,"high":2,"low":2,"close":2}\n')
    good, bad = candle_files.read_candles(spark, p, 1.0)
    assert [(r["open_tick"], r["close_tick"], r["trade_count"]) for r in good.orderBy("ts_open").collect()] == [(42000, 42200, 0), (42200, 42700, 3)]
    assert sorted(r["error_kind"] for r in bad.collect()) == ["InvalidCandle", "Json", "Json"]


def test_synthetic(spark):
    rows = synthetic.agg_trades(spark, 1000).orderBy("timestamp").collect()
    assert len(rows) == 1000 and rows[1]["timestamp"] - rows[0]["timestamp"] == 50 and all(r["price"] > 0 and r["qty"] >= 0 for r in rows)
    assert 0.3 < sum(r["is_buyer_maker"] for r in rows) / 1000 < 0.7
