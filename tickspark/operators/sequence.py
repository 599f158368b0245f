"""Row numbers in a total order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.sources.scratch import stored


def with_seq(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "seq") -> DataFrame:
    """Adds 1, 2, ... in the given order, for each key of ``by`` or, without one, over the whole table.

    Over the whole table the rows are range-partitioned by the order and written once with the number of their partition
    and their place in it; they are lifted by the counts of the partitions before. The bounds of a range partitioning are
    sampled anew whenever it is run, so counts and rows must both come from the one run that was written. The counts, one
    number for each partition, are the only rows that reach the driver. The order must be total: rows that tie in it may
    be numbered either way.
    """
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    spark = df.sparkSession
    # Ids of a task start at its number shifted by 33 bits, and tasks are in the order of their ranges.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = ranged.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("__id", 33).cast("int").alias("__part"), F.col("__id").bitwiseAND(F.lit(2**33 - 1)).alias("__place"))
    rows = stored(placed, "ranged")
    base, before = [], 0
    for r in sorted(rows.groupBy("__part").count().collect()):
        base.append((r[0], before))
        before += r[1]
    lifts = spark.createDataFrame(base, "__part int, __base long")  # as many rows as the shuffle has partitions
    out = rows.join(F.broadcast(lifts), "__part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__base") + F.col("__place") + 1).alias(name))
