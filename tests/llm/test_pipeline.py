import re

import numpy as np

import corpus_pipeline as p
from tickspark.llm.common import table

from .test_near_copies import brute_keep
from .test_packing import check as check_packed
from .test_pii import brute as brute_pii
from .test_quality import brute as brute_quality
from .test_suffix_dedup import N


def test_stages_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in p.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "pii", "packing"]

    docs = p.quality_rules(spark, docs, sf).cache()
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, t in want.items():
        n, _, _, _, cov = brute_quality(t)
        if n < 10 or 100 * cov > 20 * n:
            assert i not in got
    assert len(got) > 0.5 * len(want) and all(set(got[i].split("\n")) <= set(want[i].split("\n")) for i in got)

    docs = p.near_duplicates(spark, docs, sf).cache()
    want = {i: got[i] for i in brute_keep(sorted(got.items()))}
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == want and docs.columns == columns

    docs = p.repeated_passages(spark, docs, sf).cache()
    seen, left = set(), {}
    for i in sorted(want):
        t = want[i].encode()
        hit = np.zeros(len(t), bool)
        for k in range(len(t) - N + 1):
            if t[k : k + N] in seen:
                hit[k : k + N] = True
        seen |= {t[k : k + N] for k in range(len(t) - N + 1)}
        left[i] = bytes(x for x, h in zip(t, hit, strict=True) if not h).decode(errors="ignore")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert docs.columns == columns and {i: t for i, (t, _) in got.items()} == left and all(n == len(t) for t, n in got.values())

    docs = p.personal_data(spark, docs, sf).cache()
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and set(got) == set(left)
    for i, t in got.items():
        counts, joined = brute_pii(left[i])
        if not any(counts) and "[" not in t:
            assert t == left[i]
        for span in joined.split(",") if joined else ():
            _, s, e = span.split(":")
            assert len(t) != len(left[i]) or left[i][int(s) : int(e)] not in t
        assert len(re.findall(r"\[[A-Z_]+\]", t)) >= min(1, sum(counts))
    check_packed(sorted(got.items()), p.pack(spark, docs, sf).collect())


def test_run_and_empty(spark, sf):
    assert p.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
    assert p.pack(spark, docs, sf).count() == 0


def test_batches_of_the_stages_are_small(spark):
    """Of 16 MB of text, no batch that reaches a Python worker has more than about 2 MB."""
    docs = spark.range(160).selectExpr("id doc_id", "repeat(cast(id % 10 as string), 100000) text").coalesce(1)
    p.quality_rules(spark, docs, "")
    sizes = docs.mapInArrow(lambda bs: (b.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
    assert len(sizes) > 4 and max(r["n"] for r in sizes) < 4 << 20
