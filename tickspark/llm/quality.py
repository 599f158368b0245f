"""Line-first quality rules, in DataFrame functions only.

Every line is judged by rules for punctuation, navigation, boilerplate and symbols; failing lines are removed; a document
is rejected if that takes too large a share of its words, or if a document rule fails (too few words, or too many of
them in repeated five-word windows). All work stays within the row, so nothing is shuffled and no key can be hot.

Nulls: a null text has no words and fails. Repeated rows are judged one by one; extra columns are kept by ``clean`` and
ignored by ``judge``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, whole, with_text, words

#: Words in a window that must not repeat.
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Lines of so many words must hold a mark that ends a sentence or clause.
LONG_LINE_WORDS = 30
MARKS = r"[.!?:;…。！？।]"
#: Three or more parts between bars, or nothing but words that lead around a site.
NAVIGATION = r"(?i)(\|[^|]*){3}|^\s*((home|menu|login|log in|sign in|sign up|search|next|previous|contact|sitemap|back to top|skip to content)[\s|>»,/-]*)+$"
BOILERPLATE = r"(?i)lorem ipsum|enable javascript|use of cookies|uses cookies|accept (all )?cookies|privacy policy|terms of (use|service)|all rights reserved|subscribe to our newsletter|share on (facebook|twitter)"
#: Above this share of the line's characters, symbols make it fail.
SYMBOL_SHARE_PERCENT = 10
#: A document that loses more than this share of its words is rejected.
LOST_PERCENT = 50


def line_fails(line: Column) -> Column:
    """Rules of one line that has at least one word."""
    unmarked = (F.size(words(line)) >= LONG_LINE_WORDS) & ~line.rlike(MARKS)
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 100 > F.length(line) * SYMBOL_SHARE_PERCENT
    return line.rlike(BOILERPLATE) | line.rlike(NAVIGATION) | symbols | unmarked


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def window_hashes(w: Column, size: int = WINDOW) -> Column:
    """XXH64 of every window of ``size`` words, in order."""
    n = F.size(w)
    return F.when(n < size, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))


def repeated_pairs(hashes: Column) -> Column:
    """array<struct<h, i>> sorted by hash; empty for the usual document, in which no window occurs twice."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def repeated_starts(pairs: Column) -> Column:
    """Places of the windows that occur twice or more, in ascending order."""
    same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
    return F.sort_array(F.filter(F.transform(pairs, lambda p, i: F.when(same(i, i - 1) | same(i, i + 1), p["i"])), lambda i: i.isNotNull()))


def covered(starts: Column, size: int = WINDOW) -> Column:
    """How many words the windows at these places cover together."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-size).alias("at"), F.lit(0).alias("sum")),
        lambda acc, x: F.struct(x.alias("at"), (acc["sum"] + F.least(x - acc["at"], F.lit(size))).alias("sum")),
        lambda acc: acc["sum"],
    )


def measured(docs: DataFrame) -> DataFrame:
    """docs with the counts and verdicts that the rules need, in columns named ``q_*``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lost = F.aggregate("_bad", F.lit(0), lambda acc, x: acc + F.size(words(x)))
    base = (F.col("q_words") < 10) | (100 * F.col("q_repeat_words") > 20 * F.col("q_words"))
    return (
        docs.withColumns({"_words": words(F.col("text")), "_lines": F.filter(F.split(text, "\n", -1), has_word)})
        .withColumns({"_hashes": window_hashes(F.col("_words")), "_bad": F.filter("_lines", line_fails)})
        .withColumn("_pairs", repeated_pairs(F.col("_hashes")))
        .withColumns(
            {
                "q_words": F.size("_words").cast("long"),
                "q_word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "q_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
                "q_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "q_repeat_words": covered(repeated_starts(F.col("_pairs"))).cast("long"),
                "q_bad_lines": F.size("_bad").cast("long"),
                "q_lost_words": lost.cast("long"),
            }
        )
        .withColumn("q_base_failed", base)
        .withColumn("q_kept", ~base & (100 * F.col("q_lost_words") <= LOST_PERCENT * F.col("q_words")))
        .drop("_words", "_lines", "_hashes", "_bad", "_pairs")
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the verdict of every document."""
    m = measured(docs.select("doc_id", "text"))
    return m.select("doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat_words").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_bad_lines").alias("n_bad_lines"), F.col("q_lost_words").alias("n_lost_words"))


def clean(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep, without their failing lines; the same columns (n_chars follows the text)."""
    text = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~has_word(x) | ~line_fails(x)), "\n")
    # The random column keeps the optimizer from moving the filter, and with it every rule, below the counts it reads.
    kept = measured(whole(docs)).withColumns({"_kept": F.col("q_kept"), "_still": F.rand(0)}).where("_kept and _still >= 0")
    hit = F.col("q_bad_lines") > 0
    return with_text(kept, docs.columns, F.when(hit, text).otherwise(F.col("text")), hit)


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select r, i, array_to_string(words[i:i+4], ' ') as g from (select r, words, unnest(range(1, len(words) - 3)) as i from w)),
dup as (select r, i from (select *, count(*) over (partition by r, g) as c from win) where c > 1),
cov as (select r, count(distinct i + k) as n from (select r, i, unnest(range(0, 5)) as k from dup) group by r),
bad as (select r, list_filter(lines, lambda x:
    regexp_matches(x, '(?i)lorem ipsum|enable javascript|use of cookies|uses cookies|accept (all )?cookies|privacy policy|terms of (use|service)|all rights reserved|subscribe to our newsletter|share on (facebook|twitter)')
    or regexp_matches(x, '(?i)(\|[^|]*){3}|^\s*((home|menu|login|log in|sign in|sign up|search|next|previous|contact|sitemap|back to top|skip to content)[\s|>»,/-]*)+$')
    or len(regexp_extract_all(x, '[#*$%&|<>]')) * 100 > length(x) * 10
    or (len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) >= 30 and not regexp_matches(x, '[.!?:;…。！？।]'))) as bad from w),
m as (select w.r, doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(bad) as n_bad_lines,
  coalesce(list_sum(list_transform(bad, lambda x: len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')))), 0) as n_lost_words
  from w join bad using (r) left join cov using (r))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * n_lost_words <= 50 * n_words) as kept,
  n_bad_lines::bigint as n_bad_lines, n_lost_words::bigint as n_lost_words from m
"""
