"""Candles from CSV and newline-delimited JSON: header aliases, defaults, and rejects with the reason."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions.candles import PRICES, to_ticks, valid_prices, valid_ticks
from tickspark.functions.quantize import check_tick_size

from .trades import must_exist

MINUTE = 60_000
#: Names a column may have; fixed values.
CSV_ALIASES = {
    "ts_open": ("timestamp", "ts", "time", "ts_open", "open_time"),
    "ts_close": ("ts_close", "close_time", "timestamp_close"),
    "open": ("open", "o", "open_price"),
    "high": ("high", "h", "high_price"),
    "low": ("low", "l", "low_price"),
    "close": ("close", "c", "close_price"),
    "volume": ("volume", "v", "vol", "base_volume"),
    "trade_count": ("trades", "trade_count", "num_trades", "count"),
}
#: JSON keys are taken as they are written, and know fewer names.
JSON_ALIASES = {k: tuple(n for n in v if n not in ("open_time", "base_volume", "count")) for k, v in CSV_ALIASES.items()}
NUMBER = r"^[+-]?((?i)inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
FIELDS = ("ts_open", "ts_close", *PRICES, "volume", "trade_count")


def header_map(columns: list[str]) -> dict[str, int]:
    """Field to the place of its column; the last of several names of one field counts."""
    out = {}
    for i, c in enumerate(columns):
        name = c.strip().lower()
        for field, names in CSV_ALIASES.items():
            if name in names:
                out[field] = i
    missing = [f for f in (*PRICES, "volume") if f not in out]
    if missing:
        raise ValueError(f"HeaderMapping: no column for {', '.join(missing)}")
    return out


def _real(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def _whole(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))


def _finish(rows: DataFrame, tick_size: float) -> DataFrame:
    """Adds the reasons validity gives and the candle in ticks; error columns are null for good rows."""
    ok = F.col("error_kind").isNull()
    rows = rows.withColumn("error_kind", F.when(~ok, F.col("error_kind")).when(~valid_prices(), "InvalidCandle"))
    priced = rows.withColumns({f"_{p}": F.col(p) for p in (*PRICES, "volume")})
    ticked = to_ticks(priced, tick_size).withColumn("error_kind", F.when(F.col("error_kind").isNotNull(), F.col("error_kind")).when(~valid_ticks(), "InvalidCandle"))
    return ticked.select("ts_open", "ts_close", *[f"{p}_tick" for p in PRICES], "volume_scaled", "trade_count", "error_kind", "error_detail")


def csv_rows(spark: SparkSession, path: str, tick_size: float) -> DataFrame:
    """Every record with its candle or the reason it has none."""
    ts = check_tick_size(tick_size)
    must_exist(spark, path)
    first = spark.read.text(path).first()
    columns = next(csv.reader([first[0]])) if first else []
    place = header_map(columns)
    names = [f"c{i}" for i in range(len(columns))]
    raw = spark.read.schema(", ".join(f"{n} string" for n in [*names, "_bad"])).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    cell = lambda f: F.coalesce(F.trim(F.col(names[place[f]])), F.lit(""))
    got = {f: (_whole if f in ("ts_open", "ts_close", "trade_count") else _real)(cell(f)) for f in FIELDS if f in place}
    bad: Column = F.when(F.col("_bad").isNotNull(), F.struct(F.lit("Csv").alias("k"), F.col("_bad").alias("d")))
    if "ts_open" not in place and "ts_close" not in place:
        bad = F.coalesce(bad, F.struct(F.lit("MissingField").alias("k"), F.lit("timestamp").alias("d")))
    for f, value in got.items():
        bad = F.coalesce(bad, F.when(value.isNull(), F.struct(F.lit("InvalidValue").alias("k"), F.concat(F.lit(f"{f}: "), cell(f)).alias("d"))))
    none = F.lit(None).cast("long")
    got.setdefault("ts_open", got["ts_close"] - MINUTE if "ts_close" in got else none)
    got.setdefault("ts_close", got["ts_open"] + MINUTE)
    got.setdefault("trade_count", F.lit(0).cast("long"))
    rows = raw.select(*[got[f].alias(f) for f in FIELDS], bad.alias("_error"))
    rows = rows.select(*FIELDS, F.col("_error.k").alias("error_kind"), F.col("_error.d").alias("error_detail"))
    return _finish(rows, ts)


JSON_WHOLE = ("ts_open", "ts_close", "trade_count")
JSON_SCHEMA = ", ".join([*[f"`{n}` {'bigint' if f in JSON_WHOLE else 'double'}" for f, names in JSON_ALIASES.items() for n in names], "_bad string"])
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def json_candles(raw: DataFrame, tick_size: float) -> DataFrame:
    """Lines read with ``JSON_SCHEMA``, in a batch or a stream, with their candle or the reason they have none."""
    got = {f: F.coalesce(*[F.col(f"`{n}`") for n in names]) for f, names in JSON_ALIASES.items()}
    missing = F.when(got["volume"].isNull() | got["open"].isNull() | got["high"].isNull() | got["low"].isNull() | got["close"].isNull(), "Json")
    fields = {"ts_open": F.coalesce(got["ts_open"], F.lit(0).cast("long")), "trade_count": F.coalesce(got["trade_count"], F.lit(0).cast("long"))}
    fields["ts_close"] = F.coalesce(got["ts_close"], fields["ts_open"] + MINUTE)
    rows = raw.select(*[fields.get(f, got[f]).alias(f) for f in FIELDS], F.coalesce(F.when(F.col("_bad").isNotNull(), "Json"), missing).alias("error_kind"), F.col("_bad").alias("error_detail"))
    return _finish(rows, check_tick_size(tick_size))


def json_rows(spark: SparkSession, path: str, tick_size: float) -> DataFrame:
    """Every line with its candle or the reason it has none."""
    must_exist(spark, path)
    return json_candles(spark.read.schema(JSON_SCHEMA).options(**JSON_OPTIONS).json(path), tick_size)


def candle_rows(spark: SparkSession, path: str, tick_size: float) -> DataFrame:
    """By the extension of the path, which is matched as it is written."""
    kind = path.rstrip("/").rpartition(".")[2]
    if kind == "csv":
        return csv_rows(spark, path, tick_size)
    if kind in ("json", "jsonl", "ndjson"):
        return json_rows(spark, path, tick_size)
    raise ValueError(f"InvalidValue: file_extension {kind}")


def read_candles(spark: SparkSession, path: str, tick_size: float) -> tuple[DataFrame, DataFrame]:
    """(candles, rejects) of one file or folder."""
    rows = candle_rows(spark, path, tick_size)
    return rows.where("error_kind is null").drop("error_kind", "error_detail"), rows.where("error_kind is not null").select("error_kind", "error_detail")
