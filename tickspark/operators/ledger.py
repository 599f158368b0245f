"""Positions, cash, average entry and profit from fills, and their state at every tick.

Cash and position are prefix sums. The average entry a fill leaves is a * (average before) + b, where a and b depend on the
fill and on the position before it, and the profit it realizes is linear in the average before, too. So the fills of a block
of ``BLOCK`` seq compose to one such map whatever came before, blocks are folded side by side, and the state before each
block comes from the maps of the blocks before it, a row for each block. A long run is as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.sources.schema import bounded
from tickspark.sources.scratch import stored

from .kernel import Account

BLOCK = 65_536
RUN = ("run_id", "symbol")
STATE = ("cash", "position", "average", "realized")


def _block(seq: str) -> Column:
    return F.floor(F.col(seq) / BLOCK).cast("long")


def running_sums(rows: DataFrame, seq: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with the running sum of each of ``sums`` over the rows of their run: sums of blocks first, then within a block."""
    rows = rows.withColumn("_block", _block(seq)).withColumns({f"_add_{n}": c for n, c in sums.items()})
    w = Window.partitionBy(*RUN).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*RUN, "_block").agg(*[F.sum(f"_add_{n}").alias(f"_of_{n}") for n in sums])
    before = per.select(*RUN, "_block", *[F.sum(f"_of_{n}").over(w).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy(*RUN, "_block").orderBy(seq, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, [*RUN, "_block"])
    out = out.withColumns({n: F.sum(f"_add_{n}").over(inside) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums})
    return out.drop("_block", *[f"_{p}_{n}" for p in ("add", "before") for n in sums])


def _signed() -> Column:
    return F.when(F.col("side") == "BUY", F.col("qty_scaled")).otherwise(-F.col("qty_scaled"))


def prefix_sums(filled: DataFrame, configs: DataFrame) -> DataFrame:
    """fills with the position and cash after each."""
    cash = F.when(F.col("side") == "BUY", -(F.col("notional") + F.col("fee"))).otherwise(F.col("notional") - F.col("fee"))
    out = running_sums(filled, "fill_seq", ["order_seq"], {"position_scaled": _signed(), "cash": cash})
    return out.join(bounded(configs.select("run_id", "initial_cash")), "run_id").withColumn("cash", F.col("initial_cash") + F.col("cash")).drop("initial_cash")


def _maps(filled: DataFrame, configs: DataFrame, weighted: bool) -> DataFrame:
    """For each run and block: the number of fills, the position after them, what they add to the cash, and the maps of the
    average (a, b) and of the realized profit (u + v * average) from the state before the block."""
    rows = running_sums(filled, "fill_seq", ["order_seq"], {"_pos": _signed()})
    fold = F.struct("fill_seq", "order_seq", "side", "qty_scaled", F.col("fill_tick").cast("double").alias("f"), "notional", "fee", F.col("_pos").alias("pos"))
    blocks = rows.groupBy(*RUN, _block("fill_seq").alias("_block")).agg(F.sort_array(F.collect_list(fold)).alias("fills"))
    blocks = blocks.join(bounded(configs.select("run_id", "tick_size")), "run_id")

    def state(**values: Column) -> Column:
        return F.struct(*[v.cast("double").alias(k) for k, v in values.items()])

    def step(s: Column, x: Column) -> Column:
        buy, pos, ts = x["side"] == "BUY", x["pos"], F.col("tick_size")
        sq = F.when(buy, x["qty_scaled"]).otherwise(-x["qty_scaled"])
        old = pos - sq
        same = (old > 0) == buy
        added = sq if weighted else x["qty_scaled"]
        whole = F.nullif(pos, F.lit(0))
        fresh = (old == 0) | (~same & (pos != 0) & ((pos > 0) != (old > 0)))
        keep = fresh | (~same & (pos == 0))
        a = F.when(keep, F.lit(0.0)).when(same, F.coalesce(old * s["a"] / whole, s["a"])).otherwise(s["a"])
        b = F.when(fresh, x["f"]).when(keep, F.lit(0.0)).when(same, F.coalesce((old * s["b"] + added * x["f"]) / whole, s["b"])).otherwise(s["b"])
        closed = F.least(F.abs(old), x["qty_scaled"]) / F.lit(1e6)
        sign = F.when((old == 0) | same, F.lit(0.0)).when(old > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        gain = closed * x["f"] * ts - closed * s["b"] * ts
        cash = F.when(buy, s["cash"] - (x["notional"] + x["fee"])).otherwise(s["cash"] + (x["notional"] - x["fee"]))
        return state(cash=cash, a=a, b=b, u=s["u"] + sign * gain, v=s["v"] - sign * (closed * s["a"] * ts))

    zero = state(cash=F.lit(0.0), a=F.lit(1.0), b=F.lit(0.0), u=F.lit(0.0), v=F.lit(0.0))
    return blocks.select(*RUN, "_block", F.size("fills").cast("long").alias("n"), F.element_at("fills", -1)["pos"].alias("pos"), F.aggregate("fills", zero, step).alias("m")).select(*RUN, "_block", "n", "pos", "m.*")


_CARRIED = "run_id string, symbol string, _block bigint, n_fills bigint, " + ", ".join(f"{k} {'bigint' if k.endswith('position') else 'double'}" for k in (*STATE, *(f"before_{k}" for k in STATE)))


def carried(filled: DataFrame, configs: DataFrame, weighted: bool = True) -> DataFrame:
    """For each run and block with fills: the fills so far, and the state after and before its fills. Rows are blocks, not fills."""
    rows = _maps(filled, configs, weighted).join(bounded(configs.select("run_id", "initial_cash")), "run_id")
    rows = rows.repartition(*RUN).sortWithinPartitions(*RUN, "_block")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, n, now = None, 0, ()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.run_id, r.symbol) != run:
                    run, n, now = (r.run_id, r.symbol), 0, (r.initial_cash, 0, 0.0, 0.0)
                cash, _, average, realized = before = now
                now = (cash + r.cash, int(r.pos), r.a * average + r.b, realized + r.u + r.v * average)
                n += r.n
                out.append((*run, r.block, n, *now, *before))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _CARRIED.split(", ")])

    return rows.select(*RUN, F.col("_block").alias("block"), "n", "pos", "cash", "a", "b", "u", "v", "initial_cash").mapInPandas(fold, _CARRIED)


def fold_final(filled: DataFrame, configs: DataFrame, weighted: bool = True) -> DataFrame:
    """The state of each run and symbol after its last fill."""
    last = carried(filled, configs, weighted).groupBy(*RUN).agg(F.max_by(F.struct("n_fills", *STATE), "_block").alias("s"))
    return last.select(*RUN, "s.*")


def states(filled: DataFrame, configs: DataFrame, weighted: bool = True, blocks: DataFrame | None = None) -> DataFrame:
    """fills with the state after each, and the profit each realized: one pass over the sorted fills of each block, from the
    state before it. blocks is the result of ``carried``, where it is there already."""
    rows = filled.withColumn("_block", _block("fill_seq"))
    blocks = carried(filled, configs, weighted) if blocks is None else blocks
    rows = rows.join(blocks.drop("n_fills", *STATE), [*RUN, "_block"]).join(bounded(configs.select("run_id", "tick_size", "taker_bps")), "run_id")
    rows = rows.withColumnRenamed("_block", "block").repartition(*RUN, "block").sortWithinPartitions(*RUN, "block", "fill_seq", "order_seq")
    keep = [f.name for f in filled.schema]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, account = None, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if (r.run_id, r.symbol, r.block) != run:
                    run = (r.run_id, r.symbol, r.block)
                    account = Account(r.before_cash, int(r.before_position), r.before_average, r.before_realized)
                before = account.realized
                account.fill(r.side, int(r.qty_scaled), int(r.fill_tick), r.tick_size, r.taker_bps, weighted)
                out.append((account.cash, account.position, account.average, account.realized, account.realized - before))
            yield pd.concat([b[keep].reset_index(drop=True), pd.DataFrame(out, columns=[*STATE, "pnl"])], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filled.schema)
    return rows.mapInPandas(fold, f"{kinds}, cash double, position bigint, average double, realized double, pnl double")


def snapshot_columns(price: Column, tick_size: Column) -> dict[str, Column]:
    """Unrealized profit, equity as the kernel has it (cash plus unrealized profit), and equity marked to market."""
    units = F.col("position") / F.lit(1e6)
    unrealized = F.when(F.col("position") == 0, F.lit(0.0)).otherwise(units * price * tick_size - units * F.col("average") * tick_size)
    return {"unrealized": unrealized, "equity": F.col("cash") + unrealized, "equity_mtm": F.col("cash") + units * price * tick_size}


def final_snapshot(filled: DataFrame, ticks: DataFrame, configs: DataFrame, weighted: bool = True) -> DataFrame:
    """The state of each run and symbol at the last tick; runs without fills have their initial cash."""
    last = ticks.groupBy("symbol").agg(F.max_by("ts_ms", "seq").alias("ts_ms"), F.max_by("price_tick", "seq").alias("last_tick"))
    runs = last.join(bounded(configs.select("run_id", "initial_cash", "tick_size")), F.lit(True))
    s = runs.join(fold_final(filled, configs, weighted), list(RUN), "left").fillna(0, ["n_fills", "position"]).fillna(0.0, ["average", "realized"])
    s = s.withColumn("cash", F.coalesce("cash", "initial_cash"))
    return s.withColumns(snapshot_columns(F.col("last_tick"), F.col("tick_size"))).drop("initial_cash", "tick_size")


def history(filled: DataFrame, ticks: DataFrame, configs: DataFrame, weighted: bool = True) -> DataFrame:
    """The state after every tick of every run (after the tick's fills, before orders placed on it)."""
    blocks = stored(carried(filled, configs, weighted), "carried")
    after = states(filled, configs, weighted, blocks)
    after = after.groupBy(*RUN, "fill_seq").agg(F.max_by(F.struct(*STATE), "order_seq").alias("s")).select(*RUN, F.col("fill_seq").alias("seq"), "s")
    runs = bounded(configs.select("run_id", "initial_cash", "tick_size"))
    # The state before each block of ticks: that after the last block before it that has fills.
    ends = blocks.select(*RUN, F.col("_block").alias("block"), F.struct(*STATE).alias("end"))
    spans = ticks.select("symbol", _block("seq").alias("block")).distinct().join(runs.select("run_id"), F.lit(True)).join(ends, [*RUN, "block"], "left")
    w = Window.partitionBy(*RUN).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = spans.select(*RUN, "block", F.last("end", ignorenulls=True).over(w).alias("before"))
    rows = ticks.select("symbol", "seq", "ts_ms", "price_tick").withColumn("block", _block("seq")).join(runs, F.lit(True))
    rows = rows.join(after, [*RUN, "seq"], "left").join(opened, [*RUN, "block"], "left")
    w = Window.partitionBy(*RUN, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    now = F.coalesce(F.last("s", ignorenulls=True).over(w), F.col("before"), F.struct(F.col("initial_cash").alias("cash"), F.lit(0).cast("long").alias("position"), F.lit(0.0).alias("average"), F.lit(0.0).alias("realized")))
    out = rows.withColumn("now", now).select(*RUN, "seq", "ts_ms", "price_tick", "tick_size", "now.*")
    return out.withColumns(snapshot_columns(F.col("price_tick"), F.col("tick_size"))).drop("tick_size")
