import re
from collections import Counter

from tickspark.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(win)
    cov = {i + k for i, g in enumerate(win) if c[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cov)


TEXTS = [None, "", " \t\n", "a b c d e", "a b c d e a b c d e", "x " * 3000, "one\none\n one\n\n\n", "é😀 # $$ \x0b b\x0cq" * 3, "w1 w2 w3 w4 w5 w6 " * 4 + "end"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_counts_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df, texts in ((frame(spark, TEXTS), dict(enumerate(TEXTS))), (docs, {r["doc_id"]: r["text"] for r in docs.collect()})):
        for r in quality.judge(df).collect():
            n = brute(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
            assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
            assert not (r["kept"] and r["base_failed"])


def test_line_rules_and_clean(spark):
    good = "\n".join(" ".join(f"word{i * 10 + k}" for k in range(9)) + "." for i in range(6))
    bad = "home | about | contact | more\nPlease enable JavaScript to view this page"
    docs = frame(spark, [good, good + "\n" + bad, bad + "\nshort one with words enough to be ten words long", None]).selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars", "1 as kept")
    got = {r["doc_id"]: r for r in quality.clean(docs).collect()}
    assert set(got) == {0, 1} and got[0]["text"] == good and got[1]["text"] == good and got[1]["n_chars"] == len(good)
    assert quality.clean(docs).columns == docs.columns


def test_empty_table(spark):
    assert quality.judge(frame(spark, [])).count() == 0
