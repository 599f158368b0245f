import itertools
import zlib

import numpy as np

from tickspark.llm import langid as g


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = g.identify(docs).join(docs.selectExpr("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    tested = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(tested) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in tested]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def model():
    rng = np.random.default_rng(3)
    m = g.Model(["a", "b", "c"], *(rng.normal(size=(1 << g.BITS, 3)).astype(np.float32) for _ in range(2)), np.ones((len(g.SCRIPTS) + 1, 3), bool))
    return m, rng


def test_path_equals_brute_force():
    m, rng = model()
    for scale in (1, 10, 30):
        for _ in range(60):
            s = rng.normal(size=(6, 3)) * scale
            best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(s[i, k] for i, k in enumerate(p)) - g.SWITCH * sum(x != y for x, y in itertools.pairwise(p)))
            assert tuple(m.path(s)) == best


def test_two_other_languages_share_a_switch():
    m, rng = model()
    assert m.path(np.array([[0.0, 14, -20], [0, -20, 14]])).tolist() == [1, 2]
    value = lambda s, p: sum(s[i, k] for i, k in enumerate(p)) - g.SWITCH * sum(x != y for x, y in itertools.pairwise(p))
    for _ in range(300):
        s = rng.normal(size=(5, 4)) * 9
        best = max(value(s, p) for p in itertools.product(range(4), repeat=5))
        assert abs(value(s, m.path(s)) - best) < 1e-9


def test_spans_and_scripts(spark):
    train = [(i, w, lang) for i, (w, lang) in enumerate([("the house and the garden are here with them", "en"), ("дом и сад здесь вместе с ними", "ru"), ("das haus und der garten sind schön hier", "de")] * 40)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    m = g.train(docs)
    assert m.languages == ["de", "en", "ru"]
    text = "the house and the garden are here with them. дом и сад здесь вместе с ними"
    lang, score, spans = m.label(text)
    assert lang == "en" and 0.5 < score < 1 and [x[2] for x in spans] == ["en", "ru"]
    assert text[spans[1][0] : spans[1][1]] == "дом и сад здесь вместе с ними"
    for t in (None, "", " 12 #", "😀"):
        assert m.label(t) == ("und", 0.0, [])
    assert m.label("東京")[0] in m.languages


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, "text", "en"), (1, None, None), (2, "word", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in g.identify(docs).collect()} == {"und"}
    assert g.identify(docs.limit(0)).count() == 0


def brute_label(model, text):
    """Words, scores and the best path, one character and one pair of languages at a time."""
    letters = lambda c: not 0xD800 <= ord(c) < 0xE000 and c.isalpha()
    words, k = [], 0
    while k < len(text):
        if not letters(text[k]):
            k += 1
            continue
        e = k
        while e < len(text) and letters(text[e]):
            e += 1
        words.append((k, e))
        k = e
    if not words:
        return "und", 0.0
    script = lambda c: next((i + 1 for i, (_, spans) in enumerate(g.SCRIPTS) if any(a <= c <= b for a, b in spans)), 0)
    low = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    mul, top = 0x9E3779B97F4A7C15, 64 - g.BITS
    rows = []
    for a, e in words:
        x = [0] + [low(c) for c in text[a:e]] + [0]
        s = np.zeros(len(model.languages))
        for i in range(1, len(x)):
            pair = (x[i - 1] << 21) + x[i]
            before = x[i - 2] if i > 1 and x[i - 1] else 0
            s += model.two[(pair * mul % 2**64) >> top].astype(float) + model.three[((pair + (before << 42)) * mul % 2**64) >> top]
        own = model.own[script(ord(text[a]))]
        rows.append(np.where(own, s, g.FOREIGN) if own.any() else s * 0)
    far, back = rows[0], []
    for r in rows[1:]:
        step = far[:, None] - g.SWITCH * (1 - np.eye(len(far)))
        back.append(step.argmax(axis=0))
        far = step.max(axis=0) + r
    path = [int(far.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    n = np.bincount(path[::-1], [e - a for a, e in words], len(far))
    return model.languages[int(n.argmax())], n.max() / n.sum()


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = g.train(docs)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in g.predict(docs, model).collect():
        lang, score = brute_label(model, text[r["doc_id"]] or "")
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9


def test_long_texts_are_cut_between_words(spark, sf, monkeypatch):
    model = g.train(spark.read.parquet(f"{sf}/documents.parquet"))
    text = "the house and the garden. der hund und die katze; " * 50 + "x" * 300 + " la maison et le jardin " * 50
    want = model.label(text)
    monkeypatch.setattr(g, "SLICE", 37)
    assert model.label(text) == want


def test_every_language_is_learned(spark, monkeypatch):
    made = [(1000 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + (k * 7 + j) % 26)}o" for j in range(20)), f"l{k:03d}") for k in range(300) for i in range(4)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = g.train(docs)
    assert len(model.languages) > 290
    monkeypatch.setattr(g, "MODEL_BYTES", 300 * 8 << 12)
    small = g.train(docs)
    assert small.languages == model.languages and len(small.two) <= 1 << 12
    got = g.predict(docs, small).where("lang_pred = 'und'").count()
    assert got == 0
