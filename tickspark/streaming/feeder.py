"""Candles that arrive as files: parsed, counted, and handed on in micro-batches."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickspark.operators.events import bar_events
from tickspark.sources.candle_files import JSON_OPTIONS, JSON_SCHEMA, json_candles

log = logging.getLogger(__name__)


@dataclass
class Counters:
    candles_processed: int = 0
    candles_rejected: int = 0
    parse_errors: int = 0
    callback_errors: int = 0


def candle_stream(spark: SparkSession, folder: str, tick_size: float, max_files: int | None = None) -> DataFrame:
    """Rows of the NDJSON files of a folder as they arrive; max_files bounds a micro-batch."""
    reader = spark.readStream.schema(JSON_SCHEMA).options(**JSON_OPTIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return json_candles(reader.json(folder), tick_size)


def feed_candles(rows: DataFrame, on_events: Callable[[DataFrame], None], checkpoint: str, rejects: str | None = None, available_now: bool = True) -> tuple[StreamingQuery, Counters]:
    """Calls on_events with the bar events of each micro-batch. Rejected rows go to a table, an error of on_events to the
    log, and the stream goes on."""
    counters = Counters()

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        good, bad = df.where("error_kind is null"), df.where("error_kind is not null")
        n = df.agg(F.count_if(F.col("error_kind").isNull()), F.count_if(F.col("error_kind").isNotNull())).first()
        counters.candles_processed += n[0]
        counters.parse_errors += n[1]
        if rejects:
            bad.withColumn("batch", F.lit(number)).write.mode("append").parquet(rejects)
        try:
            on_events(bar_events(good))
        except Exception:
            counters.callback_errors += 1
            log.exception("batch %d: the callback failed", number)
        df.unpersist()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(), counters
