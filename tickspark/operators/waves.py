"""Folds over long runs: rows come in waves of bounded size, and accounts are handed on from wave to wave."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tickspark.sources.scratch import remove, scratch

#: Rows of a wave, which one task may have to sort if all are of one run and symbol.
WAVE = 1 << 21
KEY = ("run_id", "symbol")
SAVED = "saved string"


class Fold(Protocol):
    """The account of one run and symbol."""

    def apply(self, row: object) -> tuple | None:
        """A row of output, if the row gives one."""

    def last(self) -> tuple | None:
        """The row of output after the last that gave one."""

    def save(self) -> str:
        """All that ``start`` needs to go on."""


#: start(row, saved) gives a new account for its first row, or one that goes on from what was saved.
Start = Callable[[object, str | None], Fold]


def fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _cut(rows: DataFrame, order: list[str | Column], size: int) -> tuple[DataFrame, int, str | None]:
    """Rows with the number of their wave, the number of waves and the path of the stored rows. Waves follow each other in
    the given order, over all keys; a table of one wave is not stored."""
    n = max(1, -(-rows.count() // size))
    if n == 1:
        return rows.withColumn("wave", F.lit(0)), 1, None
    path = scratch(rows.sparkSession, "waves")
    cut = rows.repartitionByRange(n, *order).withColumn("wave", F.spark_partition_id())
    cut.write.parquet(path)  # a file has one wave, so a wave reads no other file's rows
    return rows.sparkSession.read.schema(cut.schema).parquet(path), n, path


def chained(rows: DataFrame, order: list[str | Column], start: Start, schema: str, path: str, before: DataFrame | None = None, widen: Callable[[DataFrame], DataFrame] | None = None, size: int | None = None) -> int:
    """Writes what the accounts give for the rows in their order, and gives the number of the last wave.

    A wave is one job, whose tasks sort and fold the wave's rows of their keys; the wave after it goes on from the accounts
    that it wrote. ``path`` gets a folder for each wave: rows of output, and one with its account in ``saved`` for
    every key so far (``outputs`` and ``accounts`` part them). before: accounts to begin with. widen: applied to the rows of a
    wave, to give them their run_id. order: from numbers that all keys share, such as seq; rows that tie in it may come either way.
    """
    names, spark = fields(schema), rows.sparkSession

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, account = None, None

        def closing() -> tuple:
            return (*(account.last() or (*key, *[0] * (len(names) - 2))), account.save())

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if (r.run_id, r.symbol) != key:
                    if key is not None:
                        out.append(closing())
                    key, account = (r.run_id, r.symbol), start(r, r.saved)
                if r.saved is None and (x := account.apply(r)) is not None:
                    out.append((*x, None))
            yield pd.DataFrame(out, columns=[*names, "saved"])
        if key is not None:
            yield pd.DataFrame([closing()], columns=[*names, "saved"])

    cut, n, stored_at = _cut(rows, order, size or WAVE)
    for w in range(n):
        part = cut.where(F.col("wave") == w).drop("wave")
        part = (widen(part) if widen else part).withColumn("saved", F.lit(None).cast("string"))
        if before is not None:
            # Zeros, not nulls: a batch of pandas turns whole numbers with a null among them to doubles.
            blank = [F.lit(0 if isinstance(f.dataType, NumericType) else None).cast(f.dataType).alias(f.name) for f in part.schema if f.name not in (*KEY, "saved")]
            part = part.unionByName(before.select(*KEY, "saved", *blank))
        part = part.repartition(*KEY).sortWithinPartitions(*KEY, F.col("saved").isNull(), *order)
        part.mapInPandas(fold, f"{schema}, {SAVED}").write.mode("overwrite").parquet(f"{path}/wave={w}")
        before = accounts(spark, f"{path}/wave={w}", schema)
    if stored_at:
        remove(spark, stored_at)
    return n - 1


def outputs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of output of all waves below a path."""
    return spark.read.schema(f"{schema}, {SAVED}").option("recursiveFileLookup", True).parquet(path).where("saved is null").drop("saved")


def accounts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The accounts after a wave, each with its last row of output (zeros, if it has none yet)."""
    return spark.read.schema(f"{schema}, {SAVED}").parquet(path).where("saved is not null")
