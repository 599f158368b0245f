"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only.

A document's matches and the gaps between them come from two passes of one pattern; running sums of their lengths are the
code-point positions. Everything stays within the row. Patterns are written so that they never go back over a run of
characters (possessive, anchored at the start of a run), so their time is linear even in long texts without spaces; they
give the same matches as the plain forms in the comments.

Four kinds are the base and are always kept: email, ip, card, phone. The method adds iban (confirmed by mod 97), ssn,
local_phone (a number without ``+``) and secret (long keys), kept only if pattern, checksum and context words together
reach ``THRESHOLD``. The score of a base span is reported with it and never drops it.

Nulls: a null text counts as empty. Repeated rows are handled one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scan, whole, with_text

THRESHOLD = 0.6
#: Code points before and after a match in which context words count.
BEFORE, AFTER = 40, 24


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    context: str
    #: Code points of the shortest match.
    least: int
    base: bool = False


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def _iban(m: Column) -> Column:
    """ISO 7064 mod 97: the first four characters go to the end, letters count as 10 to 35, the rest must be 1."""
    s = F.regexp_replace(m, " ", "")
    rest = F.aggregate(
        F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(s).between(15, 34) & (rest == 1)


#: In the order of ties: the base kinds as listed, then the added ones.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, "mail|contact|write|address", 5, True),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip, 0.6, "ip|host|server|address|login", 7, True),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike("[0-9][ -]?[0-9]"), _card, 0.7, "card|visa|credit|payment|karte|carte|tarjeta", 2, True),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|call|tel|fax|mobile", 4, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), _iban, 0.8, "iban|bank|account|konto|compte|cuenta", 12),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: F.lit(True), 0.5, "ssn|social security|social", 11),
    Kind("local_phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", lambda t: t.rlike("[0-9]{3}[ .-][0-9]{4}"), lambda m: F.lit(True), 0.4, "phone|call|tel|fax|mobile|dial", 12),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{32,}+(?![A-Za-z0-9+/_-])", lambda t: t.rlike("[A-Za-z0-9+/_-]{32}"), lambda m: F.lit(True), 0.3, "token|secret|api|key|password|passwd|bearer", 32),
)
CONTEXT = 0.3


def _found(i: int, kind: Kind) -> Column:
    """array<struct<s, k, e, score>> of one kind, from the columns that ``spans`` has made."""
    ms, gaps, starts = F.col(f"_m{i}"), F.col(f"_g{i}"), F.col(f"_s{i}")

    def span(m: Column, j: Column) -> Column:
        # The text around a match, put together again from as many matches and gaps as can lie in it.
        back, ahead = F.least(j, F.lit(-(-BEFORE // kind.least))), -(-AFTER // kind.least)
        before = F.concat(F.array_join(F.zip_with(F.slice(gaps, j - back + 1, back), F.slice(ms, j - back + 1, back), lambda a, b: F.concat(a, b)), ""), F.get(gaps, j))
        after = F.concat(F.get(gaps, j + 1), F.array_join(F.zip_with(F.slice(ms, j + 2, ahead), F.slice(gaps, j + 3, ahead), lambda a, b: F.concat(a, b)), ""))
        near = F.lower(F.concat(F.right(before, F.lit(BEFORE)), F.lit(" "), F.left(after, F.lit(AFTER))))
        score = F.lit(kind.score) + F.when(near.rlike(rf"\b(?:{kind.context})"), F.lit(CONTEXT)).otherwise(F.lit(0.0))
        s = F.get(starts, j)
        return F.struct(s.alias("s"), F.lit(i).alias("k"), (s + F.length(m)).alias("e"), F.least(score, F.lit(1.0)).alias("score"), m.alias("m"))

    all_ = F.transform(ms, span)
    good = F.filter(all_, lambda x: kind.valid(x["m"]) & (F.lit(True) if kind.base else x["score"] >= THRESHOLD))
    return F.transform(good, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["score"].alias("score")))


def _steps(ms: Column, gaps: Column) -> Column:
    """From the start of each match to the start of the next one."""
    return F.transform(ms, lambda x, j: (F.length(F.get(gaps, j)) + F.coalesce(F.length(F.get(ms, j - 1)), F.lit(0))).cast("bigint"))


def _of_kind(found: Column, i: int) -> Column:
    return F.filter(found, lambda x: x["k"] == i)


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``_found``: array<struct<s, k, e, score>> by start, then kind; code points, end exclusive."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    one = {}
    for i, kind in enumerate(KINDS):
        one[f"_m{i}"] = F.when(kind.guard(t), F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))).otherwise(none)
    two = {f"_g{i}": F.when(F.size(f"_m{i}") > 0, F.split(t, kind.pattern, -1)).otherwise(none) for i, kind in enumerate(KINDS)}
    no_longs = F.array().cast("array<bigint>")
    steps = {f"_d{i}": F.when(F.size(f"_m{i}") > 0, _steps(F.col(f"_m{i}"), F.col(f"_g{i}"))).otherwise(no_longs) for i in range(len(KINDS))}
    three = {f"_s{i}": scan(F.col(f"_d{i}")) for i in range(len(KINDS))}
    kind_of = "array<struct<s:bigint,k:int,e:bigint,score:double>>"
    four = {f"_f{i}": F.when(F.size(f"_m{i}") > 0, _found(i, kind)).otherwise(F.array().cast(kind_of)).cast(kind_of) for i, kind in enumerate(KINDS)}
    out = docs.withColumns(one).withColumns(two).withColumns(steps).withColumns(three).withColumns(four)
    out = out.withColumn("_found", F.sort_array(F.concat(*[F.col(f"_f{i}") for i in range(len(KINDS))])))
    return out.drop(*[f"_{c}{i}" for c in "mgdsf" for i in range(len(KINDS))])


def _text_of(found: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans, and all spans with their scores."""
    f = spans(docs.select("doc_id", "text")).select("doc_id", "_found")
    base = [i for i, k in enumerate(KINDS) if k.base]
    counts = [F.size(_of_kind(F.col("_found"), i)).cast("long").alias(f"n_{KINDS[i].name}") for i in base]
    names = F.array(*[F.lit(k.name) for k in KINDS])
    scored = F.transform("_found", lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["score"].alias("score")))
    return f.select("doc_id", *counts, F.sha2(_text_of(F.filter("_found", lambda x: x["k"] < len(base))), 256).alias("base_sha256"), _text_of(F.col("_found")).alias("spans"), scored.alias("findings"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; overlapping spans become one. The same columns."""
    f = spans(whole(docs))
    reach = F.concat(F.array(F.lit(0).cast("bigint")), F.col("_reach"))
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    piece = lambda x, i: F.when(x["s"] >= F.get(reach, i), F.concat(F.substr(F.col("text"), (F.get(reach, i) + 1).cast("int"), (x["s"] - F.get(reach, i)).cast("int")), F.get(names, x["k"]))).otherwise(F.lit(""))
    new = F.concat(F.array_join(F.transform("_found", piece), ""), F.substr(F.col("text"), (F.element_at("_reach", -1) + 1).cast("int")))
    hit = F.size("_found") > 0
    out = f.withColumn("_ends", F.transform("_found", lambda x: x["e"])).withColumn("_reach", F.when(hit, scan(F.col("_ends"), "max")))
    return with_text(out.withColumn("_new", F.when(hit, new).otherwise(F.col("text"))), docs.columns, F.col("_new"), hit)
