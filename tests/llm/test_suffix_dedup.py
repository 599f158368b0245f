import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tickspark.llm import suffix_dedup as s
from tickspark.llm.suffix_array import suffix_arrays

N = 50


def brute(rows):
    """doc_id and text rows to (doc_id, bytes, removed, spans, digest), sorted."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - N + 1):
                w = t[k : k + N]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, int)
        if i is not None:
            for k in range(len(t) - N + 1):
                if first[t[k : k + N]] < i:
                    gone[k] += 1
                    gone[k + N if k + N <= len(t) else len(t)] -= 1
        hit = np.cumsum(gone)[:-1] > 0
        kept = bytes(x for x, h in zip(t, hit, strict=True) if not h)
        spans = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        out.append((i, len(t), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, th string, bucket int")
    assert sorted(map(tuple, s.duplicated_spans(df).collect()), key=str) == brute(rows)


def naive(t):
    return sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(120):
        texts = [np.r_[rng.integers(1, rng.integers(2, 5), rng.integers(0, 40)), 0] for _ in range(rng.integers(1, 6))]
        size = np.array([len(t) for t in texts])
        off = np.cumsum(size) - size
        sa = suffix_arrays(np.concatenate(texts), size)
        assert all((sa[o : o + len(t)] - o).tolist() == naive(t) for t, o in zip(texts, off, strict=True))


@pytest.mark.parametrize("bucket", [2_000, 20_000, 8 << 20])
def test_whole_query_equals_brute_force(spark, sf, monkeypatch, bucket):
    monkeypatch.setattr(s, "BUCKET", bucket)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r[0], r[1]) for r in docs if len(r[1]) < 6000][:160])


def noisy(seed, docs, alphabet, passages):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(passages)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            a = rng.randint(0, max(0, len(p) - 30))
            p = p[a : a + rng.randint(30, 120)]
            if rng.random() < 0.3 and p:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice(alphabet) + p[k + 1 :]
            parts.append(p)
            parts.append(" ".join(word() for _ in range(rng.randint(0, 6))))
        rows.append((i * 3 % 101, rng.choice(["", " "]).join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "ab"), (2, "abcdefgh"), (3, "aé"), (4, "a")])
@pytest.mark.parametrize(("bucket", "texts"), [(300, 48), (300, 1), (8 << 20, 3)])
def test_borders_edits_and_runs(spark, monkeypatch, seed, alphabet, bucket, texts):
    monkeypatch.setattr(s, "BUCKET", bucket)
    rows = noisy(seed, 60, alphabet, 5)
    check(spark, rows)
    # The same contexts with other bounds on a suffix array: the reducer's part on its own.
    monkeypatch.setattr(s, "TEXTS", texts)
    c = contexts(rows)
    c.settle(np.arange(len(c.key)), np.unique(c.key, return_inverse=True)[1], -s.LEFT, 0)
    got = {(r, x) for who, lo, hi in c.found for r, a, b in zip(who.tolist(), lo.tolist(), hi.tolist(), strict=True) for x in range(a, b)}
    first = {}
    strings = [(i, k, bytes(c.text[k, s.LEFT + a : s.LEFT + a + N]), a) for k in range(len(c.key)) for i in [int(c.ids[k])] for a in range(-int(c.before[k]), int(c.after[k]) - N + 1)]
    for i, k, w, _ in strings:
        first[c.key[k], w] = min(first.get((c.key[k], w), i), i)
    want = {(int(c.row[k]), int(c.at[k]) + x) for i, k, w, a in strings if first[c.key[k], w] < i for x in range(a, a + N)}
    assert got == want


def contexts(rows):
    """Every context of these rows as one message of one bucket a document."""
    messages = []
    for j, (i, t) in enumerate(sorted(rows)):
        t = t.encode()
        c = s.Corpus(pa.table({"_id": pa.array([i], pa.int64()), "_text": pa.array([t], pa.binary()), "_th": pa.array([0], pa.int64()), "_bucket": [j]}))
        a = s._local(c)
        raw = b"".join(t[x:y] for x, y in zip(a["s"].tolist(), a["e"].tolist(), strict=True))
        meta = np.stack([a["at"] - a["s"], a["e"] - a["at"]], axis=1).astype(np.uint8)
        if len(a["at"]):
            messages.append({"n": len(a["at"]), "a": s._pack(a["h"], True), "b": s._pack(a["ids"]), "c": s._pack(a["at"].astype("<u4")), "d": s._pack(meta.view("<u2").ravel()), "e": pa.compress(raw, codec="zstd", asbytes=True)})
    return s.Contexts(messages)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(s, "BUCKET", 500)
    long = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP!"
    check(spark, [(1, None), (None, long), (2, ""), (3, long), (3, long), (3, long + "x"), (4, "y" + long), (5, long[:50]), (6, long[:49]), (7, "z" * 400), (8, "z" * 400), (8, long + long), (9, long[1:] + long[:1])])
    check(spark, [])


def test_long_documents_in_slices(monkeypatch):
    rows = [(i, t) for i, t in noisy(9, 6, "abcdef", 4)]
    tables = [pa.table({"_id": pa.array([i for i, _ in rows], pa.int64()), "_text": pa.array([(t * 9).encode() for _, t in rows], pa.binary()), "_th": pa.array(range(len(rows)), pa.int64())})]
    whole = s.Corpus(tables[0]).anchors()
    for size in (64, 100, 333):
        monkeypatch.setattr(s, "SLICE", size)
        parts = s.Corpus(tables[0]).anchors()
        o = np.argsort(whole[0], kind="stable")
        assert len(whole[0]) > 50 and all((x[o] == y).all() for x, y in zip(whole, parts, strict=True))


def test_remove_duplicated_keeps_columns(spark):
    text = "The quick brown fox jumps over the lazy dog while it rains é."
    docs = spark.createDataFrame([(2, text + " more", len(text) + 5, "a"), (1, text, len(text), "b"), (None, text, len(text), "c"), (3, None, None, "d")], "doc_id long, text string, n_chars long, source string")
    got = {r["source"]: r for r in s.remove_duplicated(docs).collect()}
    assert s.remove_duplicated(docs).columns == docs.columns and len(got) == 4
    assert got["a"]["text"] == " more" and got["a"]["n_chars"] == 5 and got["b"]["text"] == text and got["c"]["text"] == text and got["d"]["text"] is None
