import math

import pytest
from pyspark.sql import functions as F

from tickspark.functions import candles as c
from tickspark.functions import quantize as q


def values(spark, xs, expr):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    return [r[1] for r in df.select("i", expr(F.col("x"))).orderBy("i").collect()]


def test_rounding_modes(spark):
    xs = [0.5, 1.5, 2.5, -2.5, 2.4, -0.5, 7.9]
    assert values(spark, xs, lambda x: q.price_half_even(x, 1.0)) == [0, 2, 2, -2, 2, 0, 7 + 1]
    assert values(spark, xs, lambda x: q.price_half_away(x, 1.0)) == [1, 2, 3, -3, 2, -1, 8]
    assert values(spark, xs, lambda x: q.price_truncate(x, 1.0)) == [0, 1, 2, -2, 2, 0, 7]


def test_quantities(spark):
    xs = [1.5, 0.123456789, 0.000249, float("nan"), 1e300, -1e300]
    assert values(spark, xs, q.scale_qty) == [1_500_000, 123_456, int(0.000249 * 1e6), 0, 2**63 - 1, -(2**63)]
    assert values(spark, [1500.123456789], q.scale_volume) == [1_500_123_457]


def test_buckets_floor(spark):
    df = spark.createDataFrame([(-1500,), (-1000,), (0,), (1999,)], "t long")
    assert [r[0] for r in df.select(q.bucket_start(F.col("t"), 1000)).collect()] == [-2000, -1000, 0, 1000]
    with pytest.raises(ValueError):
        q.bucket_start(F.col("t"), 0)


def test_tags_and_sides(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "m boolean")
    assert [tuple(r) for r in df.select(q.side_of_maker(F.col("m")), q.side_code(F.col("m"))).collect()] == [("SELL", 1), ("BUY", 0), (None, None)]
    ok = spark.createDataFrame([("buy",), ("Sell",)], "s string")
    assert [r[0] for r in ok.select(q.parsed_tag(F.col("s"), ("BUY", "SELL"), "side")).collect()] == ["BUY", "SELL"]
    for bad in (spark.createDataFrame([("hold",)], "s string").select(q.parsed_tag(F.col("s"), ("BUY", "SELL"), "side")), spark.createDataFrame([(2,)], "s int").select(q.side_from_code(F.col("s")))):
        with pytest.raises(Exception, match="invalid side"):
            bad.collect()


def test_nice_steps(spark):
    assert values(spark, [0.037, 180, 3.8, 23.7, 1.0, 7.1, 0, -3], q.nice_step) == [pytest.approx(0.05), 200, 5, 20, 1, 10, None, None]
    with pytest.raises(ValueError):
        q.check_tick_size(0)


BASE = {"ts_open": 1609459200000, "ts_close": 1609459260000, "open_tick": 4200, "high_tick": 4250, "low_tick": 4150, "close_tick": 4220, "volume_scaled": 1500000000, "trade_count": 42}
CASES = [({}, True), ({"ts_close": 1609459100000}, False), ({"ts_open": -1}, False), ({"high_tick": 4150, "low_tick": 4250}, False), (dict.fromkeys(BASE, 0), False), ({"open_tick": 5000}, False), ({"close_tick": 4100}, False), ({"volume_scaled": -1000}, False), ({"trade_count": -1}, False), ({"open_tick": 4200, "high_tick": 4200, "low_tick": 4200, "close_tick": 4200}, True), ({"volume_scaled": 0, "trade_count": 0}, True), ({"open_tick": None}, False)]


def test_validity_in_ticks(spark):
    df = spark.createDataFrame([(i, *(BASE | m).values()) for i, (m, _) in enumerate(CASES)], "i int, " + ", ".join(f"{k} long" for k in BASE))
    assert [r[0] for r in df.orderBy("i").select(c.valid_ticks()).collect()] == [ok for _, ok in CASES]


def test_validity_in_prices(spark):
    base = {"ts_open": 1, "ts_close": 2, "open": 42.0, "high": 43.0, "low": 41.0, "close": 42.5, "volume": 1.0, "trade_count": 1}
    cases = [({}, True), ({"open": math.nan}, False), ({"high": math.inf}, False), ({"volume": -100.0}, False), ({"volume": math.inf}, False)]
    df = spark.createDataFrame([(i, *(base | m).values()) for i, (m, _) in enumerate(cases)], "i int, ts_open long, ts_close long, open double, high double, low double, close double, volume double, trade_count long")
    assert [r[0] for r in df.orderBy("i").select(c.valid_prices()).collect()] == [ok for _, ok in cases]
    ticks = c.to_ticks(spark.createDataFrame([(1, 2, 42000.5, 42500.0, 41500.25, 42200.75, 1500.123456789, 1)], "ts_open long, ts_close long, open double, high double, low double, close double, volume double, trade_count long"), 0.25)
    r = ticks.first()
    assert (r["open_tick"], r["high_tick"], r["low_tick"], r["close_tick"]) == (168002, 170000, 166001, 168803)
    back = c.to_prices(ticks, 0.25).first()
    assert back["open"] == 42000.5 and abs(back["volume"] - 1500.123456789) < 1e-6
