import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tickspark.llm import pii
from tickspark.llm.common import scan

# The plain patterns of the contract.
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    found = []
    for k, (name, p) in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if name == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    found.sort()
    return [sum(f[1] == k for f in found) for k in range(4)], ",".join(f"{PLAIN[k][0]}:{s}:{e}" for s, k, e in found)


HARD = [
    None,
    "",
    " ",
    "a@b.com_x@y.org a@b@c.d a.b@c a@b..c x+y%z@q-r.s-t.u",
    "é😀 me@ex.org 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111 1111 1111 1111 2 +49 (0) 30 123456 +1 4111111111111111",
    "+1 (017) 555-7713- +1 ((( +12345678 +123456789 x+1 234 567 890.",
    "7" * 20000,
    "a" * 30000 + "@b.com",
    "1.2.3.4 " * 700,
    "GB82 WEST 1234 5698 7654 32 bank GB82WEST12345698765433 DE89370400440532013000 ssn 123-45-6789 call (212) 555-0199 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def check(got, texts):
    for r in got:
        n, joined = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == n, texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), texts[r["doc_id"]]
        assert ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in dict(PLAIN)) == joined


def test_base_spans_equal_plain_patterns(spark, sf):
    check(pii.detect(rows(spark, HARD)).collect(), HARD)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check(pii.detect(docs).collect(), texts)


def test_added_kinds(spark):
    r = {x["doc_id"]: x for x in pii.detect(rows(spark, HARD)).collect()}[len(HARD) - 1]
    kinds = [f["kind"] for f in r["findings"]]
    assert kinds.count("iban") == 2 and "ssn" in kinds and "local_phone" in kinds and "secret" in kinds
    bare = pii.detect(rows(spark, ["x 123-45-6789 y (212) 555-0199"])).collect()[0]
    assert bare["spans"] == ""


def test_context_and_secrets_of_any_length(spark):
    long = "k" * 45 + "1" + "Ab3" * 60
    texts = ["call 212-555-0199, 212-555-0198", "ssn 123-45-6789, 123-45-6788, 123-45-6787", "212-555-0199 212-555-0198 call", f"token {long}", "call " + "x" * 40 + " 212-555-0199", "call 212-555-0199" + ", 212-555-0198" * 9]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.detect(rows(spark, texts)).collect()}
    assert got[0] == ["local_phone:5:17", "local_phone:19:31"] and [x[:3] for x in got[1]] == ["ssn"] * 3
    assert len(got[2]) == 2 and got[3] == [f"secret:6:{6 + len(long)}"] and got[4] == [""]
    assert [int(x.split(":")[1]) for x in got[5]] == [5, 19, 33]
    assert pii.redact(rows(spark, texts[:1])).first()["text"] == "call [LOCAL_PHONE], [LOCAL_PHONE]"


def test_redact_hides_every_span_and_keeps_columns(spark):
    docs = rows(spark, HARD).withColumn("n_chars", F.length("text").cast("long")).withColumn("_found", F.lit("mine"))
    got = pii.redact(docs.drop("_found")).orderBy("doc_id").collect()
    assert got[0]["text"] is None and got[1]["text"] == ""
    assert got[4]["text"].startswith("é😀 [EMAIL] [IP].[IP] 256.1.1.1 [IP] ")
    assert got[9]["text"] == "[IP] " * 700
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got)
    again = pii.detect(rows(spark, [r["text"] for r in got])).collect()
    assert all(r["n_email"] == 0 and r["n_card"] == 0 for r in again if r["doc_id"] != 5)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 300])
def test_scan(spark, n):
    df = spark.createDataFrame([([(i * 7919) % 31 for i in range(n)],)], "a array<bigint>")
    r = df.select("a", scan(F.col("a")).alias("s"), scan(F.col("a"), "max").alias("m")).first()
    assert r["s"] == [sum(r["a"][: i + 1]) for i in range(n)] and r["m"] == [max(r["a"][: i + 1]) for i in range(n)]


def test_empty_table(spark):
    assert pii.detect(rows(spark, [])).count() == 0 and pii.redact(rows(spark, [])).count() == 0
