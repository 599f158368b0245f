import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickspark.llm import simhash as s
from tickspark.llm.components import components


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    """Least id reachable over links of at most three bits."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.asarray(ids).copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(label))])
        if (new == label).all():
            return label
        label = new


TEXTS = [None, "", "  \t", "one", "ONE", "one two", "A b C d", "É x \x1c y", "word " * 70000, "a b c d e f g h i j"]


def test_whole_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect() + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(r[0], r[1], "x", 1) for r in rows], "doc_id long, text string, root string, u int")
    got = {r["doc_id"]: r for r in s.near_duplicates(df).collect()}
    fps = np.array([brute_fingerprint(r[1]) for r in rows], np.uint64)
    ids = [r[0] for r in rows]
    assert [got[i]["fingerprint"] for i in ids] == [f"{int(f):016x}" for f in fps]
    assert [got[i]["component_id"] for i in ids] == brute_components(ids, fps).tolist()


def fingerprints(rng, n, flips, seeds=1):
    base = rng.integers(0, 2**64, seeds, dtype=np.uint64)[rng.integers(0, seeds, n)]
    for _ in range(flips):
        base ^= np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(base)


@pytest.mark.parametrize(("n", "flips", "seeds"), [(1, 0, 1), (300, 1, 1), (400, 3, 40), (600, 6, 3), (500, 40, 500)])
def test_gray_index_equals_brute_force(n, flips, seeds):
    rng = np.random.default_rng(n + flips)
    fps = fingerprints(rng, n, flips, seeds)
    rng.shuffle(fps)
    label = s.GrayIndex(fps, np.zeros(len(fps), np.int64)).components()
    want = brute_components(np.arange(len(fps)), fps)
    assert len({*zip(label, want, strict=True)}) == len(set(want)) == len(set(label))


def test_groups_stay_apart():
    rng = np.random.default_rng(1)
    fps = fingerprints(rng, 200, 2)
    groups = np.sort(rng.integers(0, 3, len(fps)))
    groups = np.unique(groups, return_inverse=True)[1]
    label = s.GrayIndex(fps, groups).components()
    for g in range(3):
        m = groups == g
        assert len({*zip(label[m], brute_components(np.flatnonzero(m), fps[m]), strict=True)}) == len(set(label[m]))


@pytest.mark.parametrize("bucket", [16, 4096])
def test_split_buckets_lose_no_link(spark, monkeypatch, bucket):
    monkeypatch.setattr(s, "BUCKET", bucket)
    rng = np.random.default_rng(8)
    fps = np.unique(np.r_[fingerprints(rng, 400, 5, 2), fingerprints(rng, 300, 2, 30)])
    ids = np.arange(len(fps)) * 3
    nodes = spark.createDataFrame([(int(f), int(i)) for f, i in zip(fps.view(np.int64), ids, strict=True)], "fp long, rep long")
    root = {r["node"]: r["root"] for r in components(s.links(nodes)).collect()}
    assert [root.get(i, i) for i in ids.tolist()] == brute_components(ids, fps).tolist()


@pytest.mark.parametrize("bucket", [16, 4096])
def test_candidates_are_near_and_join_all_links(spark, monkeypatch, bucket):
    monkeypatch.setattr(s, "BUCKET", bucket)
    rng = np.random.default_rng(9)
    fps = np.r_[fingerprints(rng, 300, 3, 2), fingerprints(rng, 200, 12, 20)]
    fps = np.r_[fps, fps[:40]]
    ids = rng.permutation(len(fps))
    of = dict(zip(ids.tolist(), fps, strict=True))
    nodes = spark.createDataFrame([(int(f), int(i)) for f, i in zip(fps.view(np.int64), ids, strict=True)], "fp long, node long")
    got = s.candidates(nodes)
    pairs = [(r["u"], r["v"]) for r in got.collect()]
    bits = [int(np.bitwise_count(of[u] ^ of[v])) for u, v in pairs]
    assert len(set(pairs)) == len(pairs) and all(u < v for u, v in pairs) and 3 < max(bits) <= s.WIDE
    root = {r["node"]: r["root"] for r in components(got).collect()}
    three = brute_components(ids, fps)
    assert all(root.get(int(i), int(i)) == root.get(int(t), int(t)) for i, t in zip(ids, three, strict=True))


def test_components_of_a_long_path_and_a_hub(spark):
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    hub = spark.range(1000, 2000).select(F.col("id").alias("u"), F.lit(1500).cast("long").alias("v"))
    root = {r["node"]: r["root"] for r in components(path.union(hub)).collect()}
    assert all(root[i] == 0 for i in range(1, 301)) and all(root[i] == 1000 for i in range(1001, 2000)) and len(root) == 1299
    assert components(path.limit(0)).count() == 0


def test_deduplicate(spark):
    rows = [(5, "same words in here", "en"), (2, "same words in here", "de"), (None, "same words in here", "fr"), (9, "quite another text", "en"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = s.deduplicate(docs)
    assert got.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in got.collect()))) == ["2", "9", "None", "None"]
    assert s.near_duplicates(docs.limit(0)).count() == 0
