"""Results of a run: metrics, equity curve, summary and the tables of a tear sheet."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.operators.metrics import DECIMALS, EQUITY, curve, pick, rounded, summary

#: Points of a curve that are drawn, about.
POINTS = 4000

#: Colours of the plots.
COLORS = {"background": "#101418", "grid": "#2c343c", "text": "#d8dee9", "muted": "#8a949e", "equity": "#5fb3b3", "drawdown": "#ec5f67", "buy": "#99c794", "sell": "#f99157"}
#: Names a trade's side may have; fixed values.
BUY_NAMES, SELL_NAMES = ("buy", "long", "open"), ("sell", "short", "close")
#: Metrics of the text summary and of the tear sheet, and how each is shown; fixed values.
SUMMARY = (("total_return", ".2%"), ("max_drawdown", ".2%"), ("sharpe_ratio", ".2f"), ("win_rate", ".2%"), ("total_trades", "d"), ("avg_trade", ".4f"))
SHEET = (("total_return", ".2%"), ("max_drawdown", ".2%"), ("sharpe_ratio", ".2f"), ("win_rate", ".1%"), ("total_trades", "d"), ("avg_trade", ".3%"), ("profit_factor", ".2f"))


def shown(metrics: dict, layout: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    """(label, text) of the metrics of a layout; one that is missing counts as 0."""
    return [(k.replace("_", " ").title(), format(int(v) if f == "d" else float(v), f)) for k, f in layout for v in (metrics.get(k) or 0,)]


def setup_dark_theme() -> dict[str, str]:
    """Sets the colours of all plots, where matplotlib is installed; the palette is given either way."""
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        return COLORS
    plt.style.use("dark_background")
    faces = dict.fromkeys(("figure.facecolor", "axes.facecolor", "legend.facecolor"), COLORS["background"])
    lines = dict.fromkeys(("axes.edgecolor", "grid.color", "legend.edgecolor"), COLORS["grid"])
    texts = dict.fromkeys(("text.color", "axes.labelcolor", "xtick.color", "ytick.color"), COLORS["text"])
    plt.rcParams.update(faces | lines | texts | {"axes.grid": True, "grid.alpha": 0.3, "font.size": 9})
    return COLORS


def marker_side(side: Column) -> Column:
    """buy or sell for the names a trade's side may have; null for others."""
    low = F.lower(side)
    return F.when(low.isin(*BUY_NAMES), "buy").when(low.isin(*SELL_NAMES), "sell")


@dataclass
class BacktestResult:
    """Snapshots and trades stay distributed; metrics of one run are a small dictionary."""

    snapshots: DataFrame
    trades: DataFrame
    config: dict = field(default_factory=dict)
    #: Column of the equity; by default the first of its names that is there.
    equity: str | None = None

    def __post_init__(self) -> None:
        self.equity = self.equity or pick(self.snapshots, EQUITY)

    def curve(self) -> DataFrame:
        return curve(self.snapshots, equity=self.equity)

    def metrics(self) -> dict:
        """Rounded metrics; all 0 without snapshots. More than one run raises: read ``summary`` tables for those."""
        rows = rounded(summary(self.curve(), self.trades, equity=self.equity)).limit(2).collect()
        if len(rows) > 1:
            raise ValueError("more than one run; use operators.metrics.summary")
        return {k: (rows[0][k] if rows else 0) for k in DECIMALS}

    def to_json(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.metrics(), indent=2))

    def equity_table(self) -> DataFrame:
        s = self.snapshots
        return s.orderBy("seq").select(F.col("ts_ms").alias("timestamp"), F.col(self.equity).alias("equity"), "cash", (F.col("position") / 1e6).alias("position"), F.col("realized").alias("realized_pnl"), F.col("unrealized").alias("unrealized_pnl"))

    def to_csv(self, path: str, files: int | None = None) -> None:
        """Writes a folder of CSV files in the order of time; files=1 gives a single one."""
        t = self.equity_table()
        (t.coalesce(files) if files else t).write.mode("overwrite").option("header", True).csv(path)

    def summary(self) -> str:
        """The text that is printed after a run: a title, a rule, and a line for each metric."""
        title = "Backtest Results:"
        return "\n".join([title, "-" * len(title), *(f"{label}: {text}" for label, text in shown(self.metrics(), SUMMARY))])


def tearsheet(result: BacktestResult, output: str) -> str:
    """Writes metrics.json and the equity, drawdown and marker tables; a picture of four panels too where matplotlib is
    installed: price and markers, equity, drawdown, metrics. Returns the folder."""
    out = Path(output)
    out.mkdir(parents=True, exist_ok=True)
    metrics = result.metrics()
    (out / "metrics.json").write_text(json.dumps(metrics, indent=2))
    c = result.curve()
    table = c.orderBy("seq").select(F.col("ts_ms").alias("timestamp"), F.col(result.equity).alias("equity"), (F.coalesce("drawdown", F.lit(0.0)) * 100).alias("drawdown"))
    table.write.mode("overwrite").option("header", True).csv(str(out / "equity.csv"))
    marks = result.trades.select(F.col("ts_ms").alias("timestamp"), marker_side(F.col("side")).alias("marker"), F.col("fill_tick").alias("price"), "pnl")
    marks.write.mode("overwrite").option("header", True).csv(str(out / "trades.csv"))
    try:
        import matplotlib
    except ImportError:
        return str(out)
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    setup_dark_theme()
    # At most some thousand points of the curve and of the trades are drawn, evenly spaced; the tables above are whole.
    price = pick(c, ("price", "price_tick")) if {"price", "price_tick"} & set(c.columns) else result.equity
    thin = lambda df, n: df.where(F.pmod(F.xxhash64("timestamp"), F.lit(max(1, n // POINTS))) == 0).orderBy("timestamp").toPandas()
    rows = thin(c.select(F.col("ts_ms").alias("timestamp"), F.col(price).alias("price"), F.col(result.equity).alias("equity"), "drawdown"), table.count())
    at = thin(marks, marks.count())
    fig, (top, middle, low, last) = plt.subplots(4, 1, figsize=(14, 10), height_ratios=[3, 2, 2, 2])
    time = rows["timestamp"].astype("datetime64[ms]")
    top.plot(time, rows["price"], color=COLORS["text"])
    for name, shape in (("buy", "^"), ("sell", "v")):
        some = at[at["marker"] == name]
        top.scatter(some["timestamp"].astype("datetime64[ms]"), some["price"], color=COLORS[name], marker=shape, label=name)
    top.legend()
    middle.plot(time, rows["equity"], color=COLORS["equity"])
    low.fill_between(time, rows["drawdown"].fillna(0) * 100, color=COLORS["drawdown"])
    last.axis("off")
    last.table(cellText=shown(metrics, SHEET), loc="center")
    for ax, title in ((top, "Price and trades"), (middle, "Equity"), (low, "Drawdown, percent"), (last, "Metrics")):
        ax.set_title(title)
    fig.savefig(out / "tearsheet.png")
    plt.close(fig)
    return str(out)
