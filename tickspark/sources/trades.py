"""Aggregate trades: CSV and Parquet in, Parquet out, ticks for the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions.quantize import check_tick_size, price_half_even, price_truncate, side_code, side_from_code, side_of_maker
from tickspark.operators.sequence import with_seq

from .schema import AGG_TRADES, TRADES

REQUIRED = ("timestamp", "price", "qty", "is_buyer_maker")
CODECS = {"zstd": "zstd", "snappy": "snappy", "gzip": "gzip", None: "none", "none": "none", "uncompressed": "uncompressed"}


def must_exist(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        raise FileNotFoundError(path)


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_agg_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, price, qty, is_buyer_maker (true/false or 1/0); columns in any order, others are ignored."""
    must_exist(spark, path)
    columns = _header(spark, path)
    missing = set(REQUIRED) - set(columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    types = dict(x.split() for x in AGG_TRADES.split(", ")) | {"is_buyer_maker": "string"}
    raw = spark.read.schema(", ".join(f"`{c}` {types.get(c, 'string')}" for c in columns)).option("header", True).csv(path)
    flag = F.lower(F.trim("is_buyer_maker"))
    return raw.select("timestamp", "price", "qty", F.when(flag.isin("true", "1"), True).when(flag.isin("false", "0"), False).alias("is_buyer_maker"))


def agg_trades_feed(spark: SparkSession, path: str, tick_size: float = 1.0, symbol: str = "all") -> DataFrame:
    """Ticks of a CSV of trades: prices rounded half to even, in the order of time; ties keep the order of the values."""
    ts = check_tick_size(tick_size)
    t = read_agg_trades_csv(spark, path)
    rows = t.select(F.lit(symbol).alias("symbol"), F.col("timestamp").alias("ts_ms"), price_half_even(F.col("price"), ts).alias("price_tick"), "qty", side_of_maker(F.col("is_buyer_maker")).alias("side"), "price")
    return with_seq(rows, ["ts_ms", "price", "qty", "side"]).drop("price")


def convert_to_parquet(spark: SparkSession, input_csv: str, output_parquet: str, compression: str | None = "zstd") -> str:
    """Writes the trades of a CSV as timestamp, price, qty and side code; the CSV stays."""
    if compression not in CODECS:
        raise ValueError(f"unknown codec {compression}")
    t = read_agg_trades_csv(spark, input_csv)
    out = t.select(F.col("timestamp").cast("long"), F.col("price").cast("double"), F.col("qty").cast("double"), side_code(F.col("is_buyer_maker")).alias("side"))
    out.write.mode("overwrite").option("compression", CODECS[compression]).parquet(output_parquet)
    return output_parquet


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Converted trades, with the types they were written with."""
    must_exist(spark, path)
    return spark.read.schema(TRADES).parquet(path)


def batch_ticks(trades: DataFrame, tick_size: float, symbol: str = "all") -> DataFrame:
    """Ticks of converted trades: prices truncated, sides checked."""
    ts = check_tick_size(tick_size)
    rows = trades.select(F.lit(symbol).alias("symbol"), F.col("timestamp").alias("ts_ms"), price_truncate(F.col("price"), ts).alias("price_tick"), "qty", side_from_code(F.col("side")).alias("side"), "price")
    return with_seq(rows, ["ts_ms", "price", "qty", "side"]).drop("price")


def unpack_batches(batches: DataFrame, names: tuple[str, ...] = ("ts_ms", "price_tick", "qty", "side")) -> DataFrame:
    """Rows of batches that hold a tick's fields in an array each; arrays of different lengths fail before any row is given."""
    same = F.lit(True)
    for n in names[1:]:
        same = same & (F.size(n) == F.size(names[0]))
    rows = F.when(same, F.arrays_zip(*names)).otherwise(F.raise_error(F.lit("the arrays of a batch differ in length")))
    others = [c for c in batches.columns if c not in names]
    return batches.select(*others, F.posexplode(rows).alias("place", "x")).select(*others, "place", *[F.col("x").getField(n).alias(n) for n in names])


def first_price(ticks: DataFrame, price: str = "price", order: str | Column = "seq") -> DataFrame:
    return ticks.agg(F.min_by(price, order).alias("first_price"))


def integrity(a: DataFrame, b: DataFrame) -> dict[str, int]:
    """Rows of each side that the other lacks, counting repeats; both 0 if the tables hold the same rows."""
    return {"only_left": a.exceptAll(b).count(), "only_right": b.exceptAll(a).count()}


Feed = Callable[..., DataFrame]
FEEDS: dict[str, Feed] = {"aggtrades_csv": agg_trades_feed}


def register_feed(name: str, feed: Feed) -> None:
    """Adds a source: a function of the session and its options that gives ticks in order of ``seq``."""
    FEEDS[name] = feed


def feed(spark: SparkSession, name: str, **options: object) -> DataFrame:
    if name not in FEEDS:
        raise ValueError(f"unknown feed {name}")
    return FEEDS[name](spark, **options)
