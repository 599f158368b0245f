"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters. Its script, from code-point ranges, narrows the languages it may be in to those that use the
script in the training rows; its score in each language is the log probability of its character bigrams and trigrams,
word ends included. Viterbi finds the best sequence of languages over the words of a text, where a change of language
costs ``SWITCH``; that labels the spans. A text's language is the one with most letters, its score that share of letters.

Most texts stay in the language of the best sum: that is proved, without the dynamic program, if no stretch of words gains
more than one switch costs in any other language, and a first and a last stretch together gain no more either. A path
that has the best language somewhere pays a switch for each stretch of another one; a path that has it nowhere pays one
less, and its first and last stretch have to make up for that switch. Only the others run the dynamic program.

The model is fitted on at most ``SAMPLE`` rows of each language, the first by a hash of doc_id (counts of n-grams, never
texts, reach the driver: a table of fixed size for each language). Every lang value is learned; with very many, each gets a
smaller table, so that all together stay within ``MODEL_BYTES``. Everything else covers every row and whole texts; n-grams of
a long text are looked up slice by slice, and its words' scores are kept.

Nulls: a null text, or one without a letter, is ``und`` with score 0. A null doc_id is not held out and not learned from.
If there is nothing to learn from, every text is ``und``. Repeated rows are labelled one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.sources.schema import bounded

SAMPLE, SHARES = 2000, 40
#: N-grams are hashed into so many bits, or into fewer if the tables of all languages would be larger than so many bytes.
BITS, MODEL_BYTES = 16, 256 << 20
#: Code points of a text that are looked up together, and the next break between words.
SLICE = 1 << 18
#: Natural-log cost of a change of language.
SWITCH = 15.0
#: A word in a script that a language does not use.
FOREIGN = -20.0
#: Part of a language's letters that a script must have to be one of its own.
OWN_SCRIPT = 0.001

#: First and last code point of the scripts; fixed values of the Unicode standard. Other letters count as script 0.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("ethiopic", ((0x1200, 0x139F),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
POINTS = 0x110000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, its lower case, its script."""
    letter = np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(POINTS)), bool, POINTS)
    lower = np.arange(POINTS, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        x = chr(i).lower()
        if len(x) == 1:
            lower[i] = ord(x)
    script = np.zeros(POINTS, np.uint8)
    for k, (_, spans) in enumerate(SCRIPTS):
        for a, b in spans:
            script[a : b + 1] = k + 1
    return letter, lower, script


@dataclass
class Words:
    """The words of a text: code-point bounds, script, and for every n-gram place the word and two hashed n-grams."""

    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray
    two: np.ndarray
    three: np.ndarray


def _words(text: str) -> Words | None:
    letter, lower, script = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_ = np.zeros(len(points) + 2, bool)
    is_[1:-1] = letter[points]
    edge = np.flatnonzero(is_[1:] != is_[:-1])
    if not len(edge):
        return None
    start, end = edge[::2], edge[1::2]
    x = np.zeros(len(points) + 3, np.uint64)
    x[2:-1] = np.where(is_[1:-1], lower[points], 0)
    now, last = x[2:], x[1:-1]
    before = np.where(last > 0, x[:-2], 0)
    mul = np.uint64(0x9E3779B97F4A7C15)
    pair = last * np.uint64(1 << 21) + now
    two = (pair * mul) >> np.uint64(64 - BITS)
    three = ((pair + before * np.uint64(1 << 42)) * mul) >> np.uint64(64 - BITS)
    at = (now > 0) | (last > 0)
    first = (np.cumsum(at) - 1)[start]
    return Words(start, end, script[points[start]], first, two[at].astype(np.int64), three[at].astype(np.int64))


def _slices(text: str, most: int | None = None) -> Iterator[tuple[int, str]]:
    """Parts of a text and where they start; a cut is before a character that is no letter."""
    letter, most, at = _tables()[0], most or SLICE, 0
    while at < len(text):
        end = at + most
        while end < len(text) and letter[ord(text[end])]:
            end += 1
        yield at, text[at:end] if at or end < len(text) else text
        at = end


@dataclass
class Model:
    languages: list[str]
    two: np.ndarray
    three: np.ndarray
    own: np.ndarray

    def scores(self, w: Words) -> np.ndarray:
        """words x languages."""
        less = BITS - int(len(self.two)).bit_length() + 1
        s = np.add.reduceat(self.two[w.two >> less] + self.three[w.three >> less], w.first, axis=0)
        allowed = self.own[w.script]
        s = np.where(allowed, s, FOREIGN)
        s[~allowed.any(axis=1)] = 0
        return s

    def path(self, s: np.ndarray) -> np.ndarray:
        """The language of each word."""
        best = int(s.sum(axis=0).argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros_like(gain[:1]), gain[:-1]]), axis=0)
        first, last = gain.max(), (gain[-1] - low[-1]).max()
        if (gain - low).max() <= SWITCH and first + last <= SWITCH:
            return np.full(len(s), best)
        n, many = s.shape
        total, back = s[0].copy(), np.empty((n, many), np.int32)
        same = np.arange(many)
        for i in range(1, n):
            k = int(total.argmax())
            stay = total >= total[k] - SWITCH
            back[i] = np.where(stay, same, k)
            total = np.where(stay, total, total[k] - SWITCH) + s[i]
        out = np.empty(n, np.int64)
        out[-1] = int(total.argmax())
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        start, end, scores = [], [], []
        for at, part in _slices(text) if text and self.languages else ():
            if (w := _words(part)) is not None:
                start.append(w.start + at)
                end.append(w.end + at)
                scores.append(self.scores(w))
        if not scores:
            return "und", 0.0, []
        start, end = np.concatenate(start), np.concatenate(end)
        path = self.path(np.concatenate(scores))
        letters = np.bincount(path, end - start, len(self.languages))
        k = int(letters.argmax())
        cut = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        last = np.r_[cut[1:] - 1, len(path) - 1]
        return self.languages[k], float(letters[k] / letters.sum()), [(int(start[a]), int(end[b]), self.languages[path[a]]) for a, b in zip(cut, last, strict=True)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(bits: int):
    """One row of counts for every language of a task, whose batches are gone through once; at most the model's size is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                for _, part in _slices(text.as_py()):
                    if (w := _words(part)) is None:
                        continue
                    c = found.setdefault(lang.as_py(), [np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)])
                    np.add.at(c[0], w.two >> (BITS - bits), 1)
                    np.add.at(c[1], w.three >> (BITS - bits), 1)
                    c[2] += np.bincount(w.script, w.end - w.start, len(SCRIPTS) + 1).astype(np.int64)
        yield from _rows(found)

    return run


def _rows(found: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, c in found.items():
        yield pa.record_batch({"lang": [lang]} | {n: [x.astype("<i8").tobytes()] for n, x in zip(("two", "three", "script"), c, strict=True)})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list[np.ndarray]] = {}
    for b in batches:
        for r in b.to_pylist():
            c = [np.frombuffer(r[n], "<i8") for n in ("two", "three", "script")]
            found[r["lang"]] = [x + y for x, y in zip(found[r["lang"]], c, strict=True)] if r["lang"] in found else c
    yield from _rows(found)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the rows that may be learned from."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    many = max(1, rows.select("lang").distinct().count())
    bits = max(8, min(BITS, int(math.log2(MODEL_BYTES / (many * 8)))))  # two tables of four bytes a place
    # The first by hash in each of SHARES shares of a language, so that no task orders a whole language.
    key = F.xxhash64("doc_id")
    place = F.row_number().over(Window.partitionBy("lang", "share").orderBy("key", "doc_id"))
    ids = rows.select("lang", "doc_id", key.alias("key"), F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(SHARES)).alias("share"))
    ids = ids.withColumn("place", place).where(F.col("place") <= max(1, sample // SHARES)).select(F.col("lang").alias("l"), F.col("doc_id").alias("d")).distinct()
    taken = rows.join(bounded(ids), (F.col("doc_id") == F.col("d")) & (F.col("lang") == F.col("l")), "left_semi").select("lang", "text")
    kind = "lang string, two binary, three binary, script binary"
    # Two rounds, so that the driver gets one row of each language, not one from every task.
    table = taken.mapInArrow(_counts(bits), kind).repartition(min(16, many), "lang").mapInArrow(_summed, kind).collect()
    table.sort(key=lambda r: r["lang"])
    if not table:
        return Model([], *(np.zeros((1 << bits, 0), np.float32),) * 2, np.zeros((len(SCRIPTS) + 1, 0), bool))
    count = {n: np.array([np.frombuffer(r[n], "<i8") for r in table], float).T for n in ("two", "three", "script")}
    logs = {}
    for n in ("two", "three"):
        c = count[n] + 0.5
        p = np.log(c / c.sum(axis=0))
        logs[n] = (p - p.mean(axis=1, keepdims=True)).astype(np.float32)
    own = count["script"] > OWN_SCRIPT * count["script"].sum(axis=0)
    return Model([r["lang"] for r in table], logs["two"], logs["three"], own)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the labelled spans (code points) of every row."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.label(t.as_py()) for t in b.column(2)]
            lang, score, spans = zip(*got, strict=True) if got else ((), (), ())
            spans = [[{"start": s, "end": e, "lang": x} for s, e, x in row] for row in spans]
            yield pa.record_batch({"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "spans": pa.array(spans, span)})

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
