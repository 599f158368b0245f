"""Fills: the first tick after placement at which an order fires, with spread, notional and fee.

A market order fires on the tick after its placement, an equi-join on seq. A limit order fires on the first later tick at
or through its limit. That tick is found in a tree over seq: every node has the lowest and highest price below it, and
``FAN`` nodes lie in one row of their parent. The search climbs from the order's place to the first node to its right that
reaches the limit, and descends to its first tick that does. Each step joins an order to one row of the tree, by an
equi-join; the upper levels, whose size is known, are broadcast, so that orders never meet in the few keys there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.sources.schema import bounded

FAN = 64
#: Rows of a level of the tree up to which it is broadcast; a row has ``FAN`` nodes of 24 bytes.
SMALL_LEVEL = 20_000


def _first_reaching(after: Column | None = None) -> Column:
    """The first node of the joined row that reaches the order's limit."""
    def fits(x: Column) -> Column:
        hit = F.when(F.col("side") == "BUY", x["low"] <= F.col("limit_tick")).otherwise(x["high"] >= F.col("limit_tick"))
        return hit if after is None else hit & (x["node"] > after)

    return F.array_min(F.transform(F.filter("nodes", fits), lambda x: x["node"]))


def price_tree(ticks: DataFrame, levels: int) -> list[DataFrame]:
    """(symbol, parent, nodes) of each level, nodes having node, low and high; the nodes of level 0 are the ticks."""
    out = []
    nodes = ticks.select("symbol", F.col("seq").alias("node"), F.col("price_tick").alias("low"), F.col("price_tick").alias("high"))
    for _ in range(levels):
        rows = nodes.groupBy("symbol", F.floor(F.col("node") / FAN).cast("long").alias("parent")).agg(F.collect_list(F.struct("node", "low", "high")).alias("nodes"), F.min("low").alias("low"), F.max("high").alias("high"))
        out.append(rows.select("symbol", "parent", "nodes"))
        nodes = rows.select("symbol", F.col("parent").alias("node"), "low", "high")
    return out


def first_crossing(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """Limit orders with ``fill_seq``, the first later tick that reaches the limit; orders that none reaches are left out."""
    size = ticks.agg(F.max("seq").alias("last"), F.count("*").alias("n"), F.approx_count_distinct("symbol").alias("symbols")).first()
    levels, reach = 1, FAN
    while size["last"] is not None and reach <= size["last"]:
        levels, reach = levels + 1, reach * FAN
    tree = price_tree(ticks.select("symbol", "seq", "price_tick"), levels)
    key = ["run_id", "symbol", "order_seq"]
    # Orders that a step does not concern get a key of their own that no row has, so that they meet in no partition.
    aside = -1 - F.pmod(F.xxhash64(*key), F.lit(2**40))

    def step(rows: DataFrame, k: int, parent: Column) -> DataFrame:
        level = tree[k].withColumnRenamed("symbol", "_s").withColumnRenamed("parent", "_p")
        level = F.broadcast(level) if size["n"] / FAN ** (k + 1) + 1.2 * size["symbols"] <= SMALL_LEVEL else level
        rows = rows.withColumn("_parent", F.coalesce(parent, aside))
        return rows.join(level, (F.col("symbol") == F.col("_s")) & (F.col("_parent") == F.col("_p")), "left")

    rows = orders.select(*key, "side", "limit_tick", "placed_after_seq", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("node"))
    keep = rows.columns
    for k in range(levels):
        at = F.floor(F.col("placed_after_seq") / FAN**k).cast("long")
        met = step(rows, k, F.when(F.col("node").isNull(), F.floor(at / FAN).cast("long"))).withColumn("_hit", _first_reaching(at))
        rows = met.withColumn("level", F.coalesce("level", F.when(F.col("_hit").isNotNull(), F.lit(k)))).withColumn("node", F.coalesce("node", "_hit")).select(*keep)
    for k in range(levels - 1, 0, -1):
        met = step(rows, k - 1, F.when(F.col("level") == k, F.col("node"))).withColumn("_hit", _first_reaching())
        rows = met.withColumn("node", F.when(F.col("level") == k, F.col("_hit")).otherwise(F.col("node"))).withColumn("level", F.when(F.col("level") == k, F.lit(k - 1)).otherwise(F.col("level"))).select(*keep)
    return rows.where("node is not null").select(*key, F.col("node").alias("fill_seq"))


def with_costs(rows: DataFrame) -> DataFrame:
    """fill_tick, notional and fee from base_tick and a run's configuration; operands in the kernel's order."""
    d = F.ceil(F.col("base_tick").cast("double") * (F.col("spread_bps") / 10_000.0)).cast("long")
    rows = rows.withColumn("fill_tick", F.when(F.col("side") == "BUY", F.col("base_tick") + d).otherwise(F.col("base_tick") - d))
    rows = rows.withColumn("notional", (F.col("fill_tick").cast("double") * F.col("tick_size")) * (F.col("qty_scaled").cast("double") / 1e6))
    return rows.withColumn("fee", F.col("notional") * (F.col("taker_bps") / 10_000.0))


FILL_COLUMNS = ("run_id", "symbol", "order_seq", "fill_seq", "ts_ms", "order_type", "side", "qty_scaled", "fill_tick", "notional", "fee")


def fills(orders: DataFrame, ticks: DataFrame, configs: DataFrame) -> DataFrame:
    """One row for each order that fires. ticks need a dense seq for each symbol."""
    t = ticks.select("symbol", F.col("seq").alias("fill_seq"), "ts_ms", F.col("price_tick").alias("tick_price"))
    market = orders.where("order_type = 'MARKET'").withColumn("fill_seq", F.col("placed_after_seq") + 1)
    limit = orders.where("order_type = 'LIMIT'")
    limit = limit.join(first_crossing(limit, ticks), ["run_id", "symbol", "order_seq"])
    fired = market.unionByName(limit).join(t, ["symbol", "fill_seq"])
    fired = fired.withColumn("base_tick", F.when(F.col("order_type") == "MARKET", F.col("tick_price")).otherwise(F.col("limit_tick")))
    return with_costs(fired.join(bounded(configs), "run_id")).select(*FILL_COLUMNS)
