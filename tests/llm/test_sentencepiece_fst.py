import random

import pyarrow as pa
import sentencepiece
import pytest

from tickspark.llm import sentencepiece_fst as f


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=f.model_path())


TEXTS = [None, "", " ", "  ", "a", " a  b ", "hello   world\n\nnew\tline ", "é😀 ﬁ 東京 \U0001f9ff́", "<s> <0x41> </s> <unk>", "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "word " * 5000, "    " * 40 + "z", "1234567890 3.14159 $%^&*()", "\x00\x01\x1c a"]


def test_ids_equal_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in docs] + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in f.encode(df).collect()}
    for i, t in rows:
        assert got[i]["ids"] == library.encode(t or ""), t and t[:80]
        assert got[i]["round_trip"] and got[i]["n_ids"] == len(got[i]["ids"])
    text = {r["doc_id"]: r["text"] for r in f.decode(f.encode(df)).collect()}
    assert all(text[i] == (t or "") for i, t in rows)
    assert f.encode(df.limit(0)).count() == 0


def test_random_strings_equal_the_library(library):
    rng = random.Random(4)
    fst = f.Transducer(f._model(f.model_path()))
    for _ in range(3000):
        t = "".join(rng.choice("aabbeeothinrs  \nÀß中😀1.") for _ in range(rng.randint(1, 40)))
        assert fst.encode(t).tolist() == library.encode(t), t


def test_unigram_takes_the_least_sum():
    def message(fields):
        out = b""
        for n, kind, v in fields:
            out += bytes([n << 3 | kind]) + (bytes([len(v)]) + v if kind == 2 else v)
        return out

    import itertools
    import struct

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("▁", -2.0, 1), ("a", -2.5, 1), ("b", -1.5, 1), ("ab", -3.0, 1), ("bb", -2.0, 1), ("abb", -5.6, 1)]
    raw = message([(1, 2, message([(1, 2, p.encode()), (2, 5, struct.pack("<f", s)), (3, 0, bytes([k]))])) for p, s, k in pieces] + [(2, 2, message([(3, 0, b"\1")])), (3, 2, message([(4, 0, b"\0")]))])
    fst = f.Transducer(raw)
    score = {p: s for p, s, k in pieces if k == 1}
    unit = "▁abba"
    best = None
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                parts.append(unit[at : i + 1])
                at = i + 1
        if all(p in score for p in parts):
            best = max(best or (-1e9, []), (sum(score[p] for p in parts), parts))
    assert [fst.pieces[i] for i in fst.shortest(unit)] == best[1]
    assert fst.shortest("▁zz") == [2, 0]


def test_words_are_cut_where_no_piece_crosses(library):
    """A word is composed once, whatever punctuation or line end is beside it."""
    fst = f.Transducer(f._model(f.model_path()))
    texts = ["word, word. word; word? word\nword,", None, "", " word  ", "▁word ▁▁x-- --"]
    words, ends = fst._split(texts)
    assert [w for w in words.dictionary.to_pylist() if "word" in w] == [" word", "word", "  word", " ▁word"] and ends.tolist()[1:3] == [ends[0]] * 2
    for kind in (pa.string(), pa.large_string()):
        assert fst.counts(pa.array(texts, kind)).tolist() == [len(library.encode(t or "")) for t in texts]
    fst.byte = {}
    fst._compile()  # without byte fallback a word stays whole
    assert fst._split(["word, word. ▁x"])[0].to_pylist() == [" word,", " word.", " ▁x"]


def test_pairs_are_decided_at_their_border():
    """Like the merge rules gone through, which few pairs need."""
    fst = f.Transducer(f._model(f.model_path()))
    rng, ids = random.Random(3), list(fst.id.values())
    same = [i for i in ids if set(fst.pieces[i]) <= set("▁ aetns=-")]
    pairs = [(rng.choice(k), rng.choice(k)) for k in (ids, same) for _ in range(5000)] + [(i, f.POINTS + ord("中")) for i in same]
    rules, walked = fst.stay_apart, []
    want = [rules(fst._text(a), fst._text(b)) for a, b in pairs]
    fst.stay_apart = lambda a, b: walked.append(a) or rules(a, b)
    assert [fst._apart(a, b) for a, b in pairs] == want and True in want and False in want
    walked.clear()
    fst.encode("The merge rules were gone through for each pair of neighbours, of which there are many in a text of many words. " * 3)
    assert len(walked) < 5
