import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tickspark.llm import idcache, packing


def check(docs, got):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4") for d, t in docs}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for d, ps in by_doc.items():
        at = 0
        for s, n, crc, total in sorted(ps):
            assert s == at and total == len(want[d]) and crc == zlib.crc32(want[d][s : s + n].tobytes())
            at += n
        assert at == len(want[d])
    used = pad = 0
    for ps in by_seq.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at and n > 0
            at += n
        assert at <= packing.LENGTH
        used += at
        pad += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return pad / (used + pad)


def test_whole_documents_are_packed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    share = check([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack_documents(docs).collect())
    assert share < 0.05


def test_edge_texts(spark):
    texts = [None, "", "  ", "Hello  WORLD's <|endoftext|> x<|startoftext|>y", "İΣΑΣ ﬁ é 12 34.5 \x1c a\x1cb   c d 😀😀", "word " * 9000, "z" * 5000, "é ́x"]
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 length", "2 shard")
    check(docs, packing.pack_documents(df).collect())
    assert packing.pack_documents(df.where("doc_id < 0")).count() == 0


def test_a_worker_of_the_pipeline_keeps_few_bytes_of_words(spark):
    """What the tasks of one worker keep of 400,000 different words, run here; the ids stay those of the tokenizer."""

    class Found(Exception):
        pass

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            raise Found(run)

    with pytest.raises(Found) as found:
        corpus_pipeline.pack(spark, Rows(), "")
    run = found.value.args[0]
    idcache.release()
    names = ["".join("etaoinshrd"[int(c)] for c in f"{i:06d}") for i in range(400_000)]
    docs = [(i // 400, " ".join(names[i : i + 400])) for i in range(0, len(names), 400)]
    docs += [(1000, docs[0][1])]  # its words have left the cache
    batch = pa.record_batch({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})
    rows = [r for half in (batch[:500], batch[500:]) for b in run(iter([half])) for r in b.to_pylist()]
    held = [idcache.ENTRY + len(x) for c in idcache._CACHES for kept in (c.new, c.old) for x in kept.values()]
    idcache.release()
    assert 0 < sum(held) <= 64 << 20
    check(docs, [r | {"sequence_id": k, "offset": 0} for k, r in enumerate(rows)])


@pytest.mark.parametrize("kind", ["uniform", "few", "small"])
def test_little_padding(kind):
    rng = np.random.default_rng(5)
    size = {"uniform": rng.integers(1, 2049, 20000), "few": rng.choice([2048, 1365, 700, 1952, 96, 4096], 20000), "small": rng.integers(1, 300, 20000)}[kind]
    size = -np.sort(-size)
    seq, off = packing.pack(size)
    fill = np.bincount(seq, size).astype(int)
    assert fill.max() <= 4096 and (seq >= 0).all()
    order = np.lexsort((off, seq))
    s, o, n = seq[order], off[order], size[order]
    first = np.r_[True, s[1:] != s[:-1]]
    assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all()
    waste = 1 - size.sum() / (4096 * len(fill))
    bound = size.sum() / 4096
    assert waste < 0.012 or len(fill) <= bound + 2, waste


@pytest.mark.parametrize("n", [1, 2048, 2049, 4095, 4096, 4097, 6144, 6145, 8192, 20001])
def test_cuts(n):
    c = packing.cuts(n)
    assert c[0][0] == 0 and c[-1][1] == n and all(a[1] == b[0] for a, b in zip(c, c[1:], strict=False))
    assert all(e - s == 4096 or 0 < e - s <= 2048 for s, e in c)


def test_program_meets_a_known_optimum():
    uses, patterns = packing.solve(np.array([3, 4, 5]), np.array([20, 10, 20]), 12, gap=1e-9)
    assert np.allclose(uses @ patterns, [20, 10, 20]) and abs(uses.sum() - 17.5) < 1e-6
