import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as p
from tickspark.llm import near_copies as s
from tickspark.llm import packing


def brute_keep(rows):
    """Least id of each component of texts whose five-word shingles have Jaccard similarity of at least 0.8."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    label = [i for i, _ in rows]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while True:
        old = list(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == old:
            return set(label)


def noisy(rng, words, share):
    return " ".join(w if rng.random() > share else f"n{rng.integers(10**6)}" for w in words)


def test_stage_removes_near_copies_beyond_three_bits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"] for r in p.near_duplicates(spark, docs, sf).collect()}
    assert got == brute_keep(rows) and {1, 6} <= got and not {145, 177} & got


@pytest.mark.parametrize(("rounds", "common"), [(1, 1), (3, 1 << 17)])
def test_equals_brute_force(spark, monkeypatch, rounds, common):
    monkeypatch.setattr(s, "ROUNDS", rounds)
    monkeypatch.setattr(s, "COMMON", common)
    rng = np.random.default_rng(rounds)
    texts = [None, "", " \t", "one", "ONE", "a b c d", "A b c  d", "a b c d e", "a b c d e f g h i j"]
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 400, rng.integers(6, 200))]
        texts += [noisy(rng, base, share) for share in rng.choice([0, 0.01, 0.02, 0.03, 0.05], 14)]
        texts += [" ".join(base[: len(base) * k // 10]) for k in (7, 8, 9)]
    chain = [f"c{k}" for k in range(150)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 50, 7)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "one", "y")], "doc_id long, text string, root string").repartition(3)
    got = s.deduplicate(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(None) == 1 and sorted(i for i in ids if i is not None) == sorted(brute_keep(rows))
    assert s.deduplicate(docs.limit(0)).count() == 0


def test_parities_never_rule_out_near_copies():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, rng.integers(1, 600)))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.2 * rng.random()], rng.integers(-(2**63), 2**63 - 1, rng.integers(0, 1 + len(x) // 5))]))
        differ = len(np.setxor1d(x, y))
        bits = sum(int(w).bit_count() for w in (s.parity(x) ^ s.parity(y)).view(np.uint64))
        assert bits <= differ
        if s._similar(x, y):
            assert s.close(len(x), s.parity(x)[:, None], np.array([len(y)]), s.parity(y)[:, None]).all()


def test_parities_rule_out_most_other_pairs():
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(-(2**63), 2**63 - 1, 100))
    y = np.concatenate([x[:70], rng.integers(-(2**63), 2**63 - 1, 30)])
    assert not s.close(len(x), s.parity(x)[:, None], np.array([len(y)]), s.parity(y)[:, None]).any()


def test_index_of_fingerprints_finds_links(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(2)
    bases = [[f"w{k}" for k in rng.integers(0, 4000, 300)] for _ in range(20)]
    rows = [(20 * k + j, noisy(rng, base, 0.006 * j)) for k, base in enumerate(bases) for j in range(4)]
    rows += [(1000 + r["doc_id"], r["text"]) for r in docs.collect()]
    sets = {i: s.shingles((t or "").encode()) for i, t in rows}
    prints = {i: np.uint64(s.simhash.majority(x) & (2**64 - 1)) for i, x in sets.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = s.settled(s._sets(df), "test-sets")
    nodes = found.groupBy("digest").agg(s.F.min("doc_id").alias("node")).select("node").distinct()
    texts = df.select(s.F.col("doc_id").alias("node"), s.F.col("text").cast("binary").alias("text"))
    got = {(r["u"], r["v"]) for r in s.indexed(found, nodes, texts).collect()}
    bits = [int(np.bitwise_count(prints[u] ^ prints[v])) for u, v in got]
    assert all(s._similar(sets[u], sets[v]) for u, v in got) and max(bits) <= s.simhash.WIDE and sum(b > 3 for b in bits) > 5
    edges = {(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in s.links(df)[1].collect()}
    assert got <= edges  # the rest are what the exact join adds


def test_order_of_shingles_counts_the_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = Counter(g for r in docs.collect() for g in s.shingles((r["text"] or "").encode()).tolist())
    gram, n = s._commonest(docs)
    assert dict(zip(gram.tolist(), n.tolist(), strict=True)) == {g: k for g, k in want.items() if k > 1}
    assert (np.diff(gram) > 0).all() and len(s._commonest(docs.limit(0))[0]) == 0


def test_words_kept_by_packing_are_released():
    encoder = packing._encoder(packing.tokenizer_path())
    encoder.cache.get(["some", "words"])
    assert encoder.cache.new
    s.release()
    assert not encoder.cache.new and not encoder.cache.size
    assert packing._encoder(packing.tokenizer_path()) is not encoder
