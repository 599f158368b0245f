"""Orders: building, validating, declarative strategies, cancels and the cap on open orders."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions.quantize import parsed_tag, price_half_away, scale_qty
from tickspark.operators.ledger import running_sums
from tickspark.sources.schema import ORDER_TYPES, ORDERS, SIDES, bounded

MAX_OPEN = 1024


def normalise(orders: DataFrame, tick_size: float) -> DataFrame:
    """Orders with qty and price to fixed point; tags of any case are accepted, others and limits without price fail."""
    kind = parsed_tag(F.col("order_type"), ORDER_TYPES, "order type")
    limit = F.when(kind == "LIMIT", F.when(F.col("price").isNull(), F.raise_error(F.lit("a LIMIT order needs a price"))).otherwise(price_half_away(F.col("price"), tick_size)))
    return orders.select("run_id", "symbol", F.col("order_seq").cast("long"), F.col("placed_after_seq").cast("long"), kind.alias("order_type"), parsed_tag(F.col("side"), SIDES, "side").alias("side"), scale_qty(F.col("qty")).alias("qty_scaled"), limit.cast("long").alias("limit_tick"))


def from_signals(ticks: DataFrame, rules: list[tuple[Column, str, str, Column, Column | None]], tick_size: float, run_id: str = "run") -> DataFrame:
    """A declarative strategy: (condition on a tick, order type, side, qty, price or None) rules, each placing one order after
    every tick that meets it; orders of one tick are placed in the order of the rules."""
    made = F.array(*[F.when(cond, F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("order_type"), F.lit(side).alias("side"), qty.cast("double").alias("qty"), (price if price is not None else F.lit(None)).cast("double").alias("price"))) for i, (cond, kind, side, qty, price) in enumerate(rules)])
    rows = ticks.select(F.lit(run_id).alias("run_id"), "symbol", F.col("seq").alias("placed_after_seq"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("o"))
    rows = rows.select("run_id", "symbol", "placed_after_seq", (F.col("placed_after_seq") * len(rules) + F.col("o.rule")).alias("order_seq"), "o.order_type", "o.side", "o.qty", "o.price")
    return normalise(rows, tick_size)


def first_buy_strategy(ticks: DataFrame, qty: float = 0.1, run_id: str = "run") -> DataFrame:
    """One market buy after the first BUY tick of each symbol."""
    first = ticks.where("side = 'BUY'").groupBy("symbol").agg(F.min("seq").alias("placed_after_seq"))
    return first.select(F.lit(run_id).alias("run_id"), "symbol", F.lit(0).cast("long").alias("order_seq"), "placed_after_seq", F.lit("MARKET").alias("order_type"), F.lit("BUY").alias("side"), scale_qty(F.lit(float(qty))).alias("qty_scaled"), F.lit(None).cast("long").alias("limit_tick"))


def from_rows(spark: SparkSession, rows: list[tuple], tick_size: float) -> DataFrame:
    """Orders from (run_id, symbol, order_seq, placed_after_seq, order_type, side, qty, price) tuples."""
    return normalise(spark.createDataFrame(rows, "run_id string, symbol string, order_seq long, placed_after_seq long, order_type string, side string, qty double, price double"), tick_size)


def sweep(orders: DataFrame, configs: DataFrame) -> DataFrame:
    """The same orders for every run of a configuration table."""
    runs = bounded(configs.select("run_id"))
    return orders.drop("run_id").join(runs, F.lit(True)).select(*[c.split()[0] for c in ORDERS.split(", ")])


def apply_cancels(filled: DataFrame, cancels: DataFrame) -> DataFrame:
    """Drops fills of orders that were cancelled after a tick before the one they filled on.

    cancels: run_id, symbol, order_seq, cancel_after_seq. Of several cancels of an order the first counts; a cancel of an
    order that is filled by then, or of none, changes nothing.
    """
    first = cancels.groupBy("run_id", "symbol", "order_seq").agg(F.min("cancel_after_seq").alias("cancel_after_seq"))
    return filled.join(first, ["run_id", "symbol", "order_seq"], "left").where("cancel_after_seq is null or fill_seq <= cancel_after_seq").drop("cancel_after_seq")


def refused(orders: DataFrame, filled: DataFrame, cancels: DataFrame | None = None, most: int = MAX_OPEN) -> DataFrame:
    """(run_id, symbol, order_seq) of the orders that the kernel refuses because ``most`` are open when they are placed.

    When an order would fill does not depend on the others, so only the orders of a run have to be gone through, never its
    ticks: a task holds the ends of at most ``most`` open orders. Runs that never have so many open are left out before.
    A cancelled order counts until the next tick.
    """
    key = ["run_id", "symbol", "order_seq"]
    over = open_peak(orders, filled).where(F.col("peak_open") > most).select("run_id", "symbol")
    rows = orders.join(over, ["run_id", "symbol"], "left_semi").select(*key, "placed_after_seq").join(filled.select(*key, "fill_seq"), key, "left")
    if cancels is not None:
        rows = rows.join(cancels.groupBy(*key).agg((F.min("cancel_after_seq") + 1).alias("gone")), key, "left")
        rows = rows.withColumn("fill_seq", F.least("fill_seq", "gone")).drop("gone")
    rows = rows.withColumn("fill_seq", F.coalesce("fill_seq", F.lit(2**62))).repartition("run_id", "symbol").sortWithinPartitions("run_id", "symbol", "placed_after_seq", "order_seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, ends = None, []
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if (r.run_id, r.symbol) != run:
                    run, ends = (r.run_id, r.symbol), []
                while ends and ends[0] <= r.placed_after_seq:
                    heapq.heappop(ends)
                if len(ends) < most:
                    heapq.heappush(ends, r.fill_seq)
                else:
                    out.append((*run, r.order_seq))
            yield pd.DataFrame(out, columns=key)

    return rows.mapInPandas(fold, "run_id string, symbol string, order_seq bigint")


def accepted(filled: DataFrame, orders: DataFrame, cancels: DataFrame | None = None, most: int = MAX_OPEN) -> DataFrame:
    """Fills of the orders that the kernel takes."""
    return filled.join(refused(orders, filled, cancels, most), ["run_id", "symbol", "order_seq"], "left_anti")


def open_peak(orders: DataFrame, filled: DataFrame) -> DataFrame:
    """The most orders that were open at once in each run; above ``MAX_OPEN`` the kernel refuses some (``refused``).

    Changes are summed for each tick first, and the running sum is taken in blocks.
    """
    placed = orders.groupBy("run_id", "symbol", F.col("placed_after_seq").alias("seq")).agg(F.count("*").alias("d"))
    closed = filled.groupBy("run_id", "symbol", F.col("fill_seq").alias("seq")).agg((-F.count("*")).alias("d"))
    change = placed.union(closed).groupBy("run_id", "symbol", "seq").agg(F.sum("d").alias("d"))
    change = running_sums(change, "seq", [], {"open": F.col("d")})
    return change.groupBy("run_id", "symbol").agg(F.max("open").alias("peak_open"), (F.max("open") > MAX_OPEN).alias("over_cap"))
