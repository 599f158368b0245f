"""Bucketed volumes of a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickspark.functions.quantize import QTY_SCALE, bucket_start

KEYS = ("ts_ms", "price_tick", "side")


def aggregate_ticks(stream: DataFrame, bucket_ms: int, watermark: str = "10 minutes") -> DataFrame:
    """The batch buckets, over a stream: finished buckets are given once and leave the state. Rows of a bucket that the
    watermark has passed find no state; ``bucket_tables`` keeps these."""
    rows = stream.withColumn("_time", F.timestamp_millis("ts_ms")).withWatermark("_time", watermark)
    rows = rows.groupBy(F.window("_time", f"{bucket_ms} milliseconds"), "price_tick", "side").agg(F.sum(F.round(F.col("qty") * QTY_SCALE).cast("long")).alias("q"))
    return rows.select(F.unix_millis("window.start").alias("ts_ms"), "price_tick", "side", (F.col("q") / F.lit(QTY_SCALE)).alias("qty"))


def bucket_tables(stream: DataFrame, bucket_ms: int, table: str, late: str, checkpoint: str, delay_ms: int = 600_000, available_now: bool = True) -> StreamingQuery:
    """Adds the buckets of each micro-batch to a table of partial sums, and its rows that are later than the delay to another.

    No row is lost, however late: ``read_buckets`` sums the partial sums. A row is late if its bucket had ended the delay
    before the latest tick of the batches before. A batch that is run again replaces what it wrote.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        seen = spark.read.schema("last bigint, batch bigint").parquet(f"{checkpoint}/seen").where(F.col("batch") < number) if number else None
        last = seen.agg(F.max("last")).first()[0] if seen is not None else None
        batch = batch.persist()
        start = bucket_start(F.col("ts_ms"), bucket_ms)
        is_late = F.lit(False) if last is None else F.coalesce(start + bucket_ms + delay_ms <= last, F.lit(False))
        sums = batch.where(~is_late).groupBy(start.alias("ts_ms"), "price_tick", "side").agg(F.sum(F.round(F.col("qty") * QTY_SCALE).cast("long")).alias("q"))
        sums.write.mode("overwrite").parquet(f"{table}/batch={number}")
        batch.where(is_late).write.mode("overwrite").parquet(f"{late}/batch={number}")
        batch.agg(F.greatest(F.max("ts_ms"), F.lit(last).cast("long")).alias("last")).write.mode("overwrite").parquet(f"{checkpoint}/seen/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint}/query")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_buckets(table: DataFrame) -> DataFrame:
    """Buckets of a table of partial sums."""
    return table.groupBy(*KEYS).agg((F.sum("q") / F.lit(QTY_SCALE)).alias("qty"))
