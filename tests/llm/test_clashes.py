from pyspark.sql import functions as F

from tickspark.llm import ann, langid, packing, pii, quality, sentencepiece_fst, simhash, suffix_dedup

NAMES = ["_found", "_new", "_words", "_hashes", "q_kept", "_kept", "_still", "_id", "_text", "_th", "_bucket", "fp", "rep", "node", "ids", "shard", "n_ids", "a b", "x.y"]
TEXTS = [None, "", "mail me@example.org now, please: " + " ".join(f"w{i}" for i in range(30)), "again " + " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}." for i in range(12))]


def test_extra_columns_with_names_of_our_own(spark):
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    for stage in (quality.clean, simhash.deduplicate, suffix_dedup.remove_duplicated, pii.redact):
        want, got = stage(plain), stage(docs)
        assert got.columns == docs.columns
        for r in got.collect():
            assert all(r[n] == f"own {n}" for n in NAMES)
        key = lambda r: str((r["doc_id"], r["text"], r["n_chars"]))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    for op in (quality.judge, simhash.near_duplicates, suffix_dedup.duplicated_spans, pii.detect, packing.pack_documents, sentencepiece_fst.encode, langid.identify):
        assert op(docs).count() >= len(TEXTS)
        assert op(docs.limit(0)).count() == 0


def test_embeddings_with_extra_columns(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(n) for n in ("id", "vec", "uid", "cell", "code", "part", "block")])
    assert [tuple(r) for r in ann.neighbours(df).collect()] == [(20, 1, 3, 1.0)]
