import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickspark.plans import file_queries, queries
from tickspark.operators import fills, ledger
from tickspark.operators.kernel import Engine, Order
from tickspark.sources.scratch import stored

TABLES = ("events",)
QUERIES = queries.QUERIES | file_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | file_queries.ORACLE_SQL


def rows(df):
    out = df.toPandas()
    out = out[sorted(out.columns)]
    plain = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(map(plain, r)) for r in out.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    class Frame:
        def __init__(self, pdf):
            self.pdf = pdf

        def toPandas(self):
            return self.pdf

    assert rows(QUERIES[name](spark, sf)) == rows(Frame(con.execute(ORACLE_SQL[name]).df()))


def test_fills_and_ledger_equal_the_kernel_over_many_partitions(spark):
    """Ten times the rows of the driver's comparison, so that numbering, tree and blocks have several parts."""
    big = "/root/testdata/sf0.1"
    t = stored(queries.ticks(spark, big), "ticks")
    n = t.count()
    assert t.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first() == (1, n, n)
    runs = queries.configs(spark, [queries.RUN])
    o = queries.orders(t)
    e = Engine(100_000.0, 2.0, 2.0, 0.01)
    placed = {}
    for r in o.collect():
        placed.setdefault(r["placed_after_seq"], []).append(r)
    ends = {}
    for r in t.orderBy("seq").select("seq", "ts_ms", "price_tick").collect():
        e.step(r["ts_ms"], r["price_tick"])
        ends.update((f[0], r["seq"]) for f in e.fills)
        e.fills.clear()
        for x in sorted(placed.get(r["seq"], ()), key=lambda x: x["order_seq"]):
            assert e.place(Order(x["order_seq"], x["order_type"], x["side"], x["qty_scaled"], x["limit_tick"])) == 0
    got = stored(fills.fills(o, t, runs), "fills")
    assert {r["order_seq"]: r["fill_seq"] for r in got.collect()} == ends
    s = ledger.final_snapshot(got, t, runs).first()
    assert (s["n_fills"], s["position"]) == (len(ends), e.account.position)
    assert [s[k] for k in ("cash", "average", "realized")] == [pytest.approx(x, rel=1e-9) for x in (e.account.cash, e.account.average, e.account.realized)]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ts_ms", "price_tick", "side", "qty"] and df.count() > 0


def test_the_rest_works_without_the_text_operators(tmp_path):
    repo = Path(__file__).resolve().parent.parent
    for p in ("tickspark", "tests", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(repo / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tickspark" / "llm"), str(tmp_path / "tests" / "llm")], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and e.queries().keys() == e.oracle_sql().keys(), e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_quantize.py", "tests/test_sources.py"], cwd=tmp_path, check=True, timeout=200)
