"""URL filtering with rules and an exact Bloom filter cascade.

A cascade encodes a set of listed keys exactly over a known universe of keys. Level 1 is a Bloom filter of the listed
keys; level 2 of those unlisted keys of the universe that level 1 lets through; level 3 of the listed keys that level 2
lets through, and so on until no false positive is left. A key is listed exactly if the first level that lacks it has an
even number, or if it is in all of an odd number of levels. Looking a key up needs no join, only the bits.

Size bound: level 1 has ``BITS`` bits a listed key and the rest shrink geometrically, so the bits grow with the list (and
with the false positives of level 1, ``FALSE`` of the universe), not with the pages. A cascade of more than ``max_bytes``
raises; split the list by a hash of the key into several cascades then.

Nulls: a null url, or one without ``://``, has an empty host and path; no rule fits it and the empty host is never listed.
Empty tables give empty results. Repeated pages give repeated rows. Columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settled

#: (verdict, host, path) of the fixed rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A host is listed if one of its labels holds one of these terms.
LISTED_TERMS = ("casino", "free-bets", "cheap-pills", "lottery", "xxx", "warez", "payday")
FALSE = 0.02


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _mixed(a: np.ndarray, level: int) -> np.ndarray:
    z = a + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass
class Level:
    number: int
    bits: int
    hashes: int
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def places(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """One row of bit positions for each key."""
        a, b = _mixed(k1, self.number), _mixed(k2, self.number) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(self.hashes, dtype=np.uint64)[None, :]) % np.uint64(self.bits)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        at = self.places(k1, k2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe that the cascade was built over."""
        out, open_ = np.zeros(len(k1), bool), np.ones(len(k1), bool)
        for level in self.levels:
            at = np.flatnonzero(open_)
            missing = at[~level.has(k1[at], k2[at])]
            out[missing] = level.number % 2 == 0
            open_[missing] = False
        out[open_] = len(self.levels) % 2 == 1
        return out

    def passed(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Keys that every level so far holds."""
        keep = np.ones(len(k1), bool)
        for level in self.levels:
            at = np.flatnonzero(keep)
            keep[at[~level.has(k1[at], k2[at])]] = False
        return keep

    @property
    def bytes(self) -> int:
        return sum(level.words.nbytes for level in self.levels)


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def build_cascade(universe: DataFrame, key: str, listed: Column, max_bytes: int = 64 << 20) -> Cascade:
    """universe: rows of keys, repeats allowed; listed: a condition on the key that says what the list holds.

    Two keys with equal 128-bit hashes count as one. Null keys are left out.
    """
    k1, k2 = key_hashes(F.col("key"))
    keys = settled(universe.select(F.col(key).alias("key"), listed.alias("listed")).where("key is not null").distinct().select(k1.alias("k1"), k2.alias("k2"), F.coalesce("listed", F.lit(False)).alias("listed")), "url-keys")
    cascade = Cascade([])
    number = 1
    while True:
        member = number % 2 == 1
        left = keys.where(F.col("listed") == member).mapInArrow(_survivors(keys.sparkSession.sparkContext.broadcast(Cascade([*cascade.levels]))), "k1 bigint, k2 bigint")
        n = left.count()
        if n == 0:
            return cascade
        hashes = max(1, round(-math.log2(FALSE)))
        bits = max(64, 64 * math.ceil(n * -math.log(FALSE) / math.log(2) ** 2 / 64))
        if cascade.bytes + bits // 8 > max_bytes:
            raise ValueError(f"the cascade needs over {max_bytes} bytes; split the list")
        level = Level(number, bits, hashes)
        rows = left.mapInArrow(_setter(level), "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        level.words = np.zeros(bits // 64, np.uint64)
        level.words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        cascade.levels.append(level)
        number += 1


def _two(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in names or ("k1", "k2"))


def _survivors(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["k1", "k2"]).filter(pa.array(shared.value.passed(*_two(b))))

    return run


def _setter(level: Level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(level.places(*_two(b)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.record_batch({"word": pa.array(word.astype(np.int64)), "bits": pa.array(bits.view(np.int64))})

    return run


def probe(df: DataFrame, key: str, cascade: Cascade, out: str = "listed") -> DataFrame:
    """df with a boolean column: whether the key is listed. Nulls are not listed."""
    k1, k2 = key_hashes(F.col(key))
    shared = df.sparkSession.sparkContext.broadcast(cascade)  # at most max_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = pa.array(shared.value.listed(*_two(b, "__k1", "__k2")))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], hit], names=[*b.schema.names[:-2], out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumns({"__k1": k1, "__k2": k2}).mapInArrow(run, f"{kinds}, `{out}` boolean")


def listed_host(host: Column, terms: Sequence[str] = LISTED_TERMS) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | host.contains(t)
    return hit


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, terms: Sequence[str] = LISTED_TERMS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page: the longest rule that fits, else whether the cascade lists the host."""
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cascade = build_cascade(hosts, "host", listed_host(F.col("host"), terms))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return probe(hosts, "host", cascade).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


ORACLE_SQL = r"""
with p as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as after from pages),
h as (select page_id, coalesce(translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') as path from p),
r as (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
  regexp_matches(host, 'casino|free-bets|cheap-pills|lottery|xxx|warez|payday') as listed from h)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
  when listed then 'block' else 'allow' end as verdict, listed from r
"""
