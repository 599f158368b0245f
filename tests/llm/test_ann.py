import numpy as np
import pytest

from tickspark.llm import ann


def brute(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = max({len(v) for _, v in ok}, key=lambda n: sum(len(v) == n for _, v in ok))
    ok = [(i, v) for i, v in ok if len(v) == n]
    out = {}
    for q, v in ok:
        if q % 20 == 0:
            out[q] = sorted(((-float(w @ v), i) for i, w in ok if i != q))[:k]
    return out


def check(got, want, least, k=20):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {q for q, w in want.items() if w}
    hit = total = 0
    for q, w in want.items():
        rows = sorted(by.get(q, []))
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == min(k, len(w))
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        exact = {i: -s for s, i in w}
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in rows if i in exact)
        hit += sum(i in exact for _, i, _ in rows)
        total += len(w)
    assert hit >= least * total, hit / total


def test_recall_on_whole_table(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(ann.neighbours(emb).collect(), brute([(r["vec_id"], r["embedding"]) for r in emb.collect()]), 0.9)


@pytest.mark.parametrize("part", [64, 8192])
def test_copies_ties_and_odd_rows(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "PART", part)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(300)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(300, 500)]
    rows += [(None, [1.0] * 6), (600, None), (620, [0.0] * 6), (640, [float("nan")] + [1.0] * 5), (660, [None] + [1.0] * 5), (680, [1.0] * 3), (700, []), (720, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, uid int, part int")
    check(ann.neighbours(df).collect(), brute(rows), 0.9)


def test_small_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.neighbours(spark.createDataFrame([], kind)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(20, [1.0, 2.0])], kind)).count() == 0
    got = ann.neighbours(spark.createDataFrame([(20, [1.0, 2.0]), (3, [2.0, 1.0]), (40, [1.0, 2.0])], kind)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(20, 1, 40, 5.0), (20, 2, 3, 4.0), (40, 1, 20, 5.0), (40, 2, 3, 4.0)]
