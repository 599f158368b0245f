import pytest
from pyspark.sql import functions as F

from tickspark.llm import token_counts as t

CHANGE = "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long"


def changes(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], CHANGE).withColumn("n_docs", F.lit(99))


def state(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_deltas_and_repeated_batches(spark, tmp_path):
    r = t.Rollup(spark, str(tmp_path / "r"))
    assert state(r) == {} and not r.compact()
    one = changes(spark, [("insert", "s", "en", "1", 5), ("insert", "s", "en", "1", 5), ("insert", "s", None, "1", 7), ("insert", None, "en", "1", None)])
    assert r.apply("a", one) and not r.apply("a", one)
    assert state(r) == {("s", "en", "1"): (2, 10), ("s", None, "1"): (1, 7), (None, "en", "1"): (1, 0)}
    two = changes(spark, [("delete", "s", None, "1", 7), ("revise", "s", "en", "2", 9, "s", "en", "1", 5)])
    assert r.apply("b", two)
    want = {("s", "en", "1"): (1, 5), ("s", "en", "2"): (1, 9), (None, "en", "1"): (1, 0)}
    assert state(r) == want
    assert r.compact() and state(r) == want
    assert not t.Rollup(spark, str(tmp_path / "r")).apply("b", two) and state(r) == want
    assert r.apply("c", changes(spark, [])) and state(r) == want
    assert r.apply("d", changes(spark, [("delete", "s", "en", "2", 9)])) and ("s", "en", "2") not in state(r)
    assert r.compact() and state(r) == {k: v for k, v in want.items() if k != ("s", "en", "2")}


def test_real_tokenizers_over_all_documents(spark, sf):
    import sentencepiece
    from tokenizers import Tokenizer

    from tickspark.llm import packing, queries
    from tickspark.llm.sentencepiece_fst import model_path

    words, pieces = Tokenizer.from_file(packing.tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        t = d["text"] or ""
        for version, n in (("word_bpe_49k", len(words.encode(t, add_special_tokens=False).ids)), ("piece_bpe_32k", len(pieces.encode(t)))):
            docs, tokens = want.get((d["source"], d["lang"], version), (0, 0))
            want[d["source"], d["lang"], version] = docs + 1, tokens + n
    got = queries.QUERIES["op8_token_counts"](spark, sf)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want


def test_a_marker_is_created_once(spark, tmp_path):
    r = t.Rollup(spark, str(tmp_path / "m"))
    assert r._marker("batch-x", {"table": "1"}) and not r._marker("batch-x", {"table": "2"})
    assert r._names() == ["batch-x"] and r._read("batch-x") == {"table": "1"}


def test_unknown_change_is_refused(spark, tmp_path):
    r = t.Rollup(spark, str(tmp_path / "u"))
    with pytest.raises(Exception, match="unknown change"):
        r.apply("a", changes(spark, [("upsert", "s", "en", "1", 5)]))
    assert not r.committed("a") and state(r) == {}


def test_counts_of_odd_texts_equal_the_libraries(spark):
    import re

    import sentencepiece
    from tokenizers import Tokenizer

    from tickspark.llm import packing
    from tickspark.llm.sentencepiece_fst import model_path

    words, pieces = Tokenizer.from_file(packing.tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = [None, "", " ", "\t\n", " a  b ", "▁a ▁▁b a▁b", "word, word. Word\nWord", "é\U0001f600 ﬁ 東京", "<s> <0x41> <|endoftext|>", "=" * 77 + "\n" + "=" * 5, "x" * 300 + " ", "\x00\x01\x1c a"]
    df = spark.createDataFrame([(str(i), "l", x) for i, x in enumerate(texts)], "source string, lang string, text string")
    got = {int(r["source"]): tuple(r)[2:] for r in t.tokenized(df).collect()}
    for i, x in enumerate(texts):
        x = x or ""
        assert got[i] == (len(re.findall(r"[^\x20\x09-\x0D]+", x)), len(words.encode(x, add_special_tokens=False).ids), len(pieces.encode(x))), texts[i]
