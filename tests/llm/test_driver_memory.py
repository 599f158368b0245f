import numpy as np
import pytest

from tickspark.llm import common, components, near_copies


def nodes_of(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("\n")


@pytest.fixture
def planned(monkeypatch):
    """The numbers of plan nodes of the tables that these modules write."""
    sizes = []
    for module in (components, near_copies):
        monkeypatch.setattr(module, "settled", lambda df, *a, **k: (sizes.append(nodes_of(df)), common.settled(df, *a, **k))[1])
    return sizes


def test_components_are_planned_in_small_steps(spark, planned):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000, k) for k in range(500, 700)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}
    assert max(planned) <= 20


def test_pairs_are_fitted_in_small_steps_and_once(spark, planned, monkeypatch):
    monkeypatch.setattr(near_copies, "PARTNERS", 3)
    pairs = [(0, k) for k in range(1, 30)] + [(4, 9), (7, 8)]
    of = [(k, k % 3) for k in range(30)] + [(0, 1), (6, 0), (9, 1)]  # repeated ids
    table = spark.createDataFrame(of, "node bigint, x int")
    out = near_copies._fitting(spark.createDataFrame(pairs, "u bigint, v bigint"), table, lambda x: x.as_py(), lambda x, y: x == y)
    have = {k: {x for n, x in of if n == k} for k in range(30)}
    assert sorted(map(tuple, out.collect())) == sorted(p for p in pairs if have[p[0]] & have[p[1]])
    assert max(planned) <= 30


def test_driver_gives_back_memory(spark):
    said = common.give_back(spark)
    assert said is not None and "rim" in said
