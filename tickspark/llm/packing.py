"""Packing token sequences by cutting-stock column generation.

Documents are tokenized where they are read; only (doc_id, start, length, crc) of their pieces move on. A document longer
than a sequence is cut into full sequences and a rest, and a rest longer than half a sequence is cut there; every other
document stays whole. The rests are packed: a linear program over the histogram of their lengths chooses how often to use each pattern of lengths that fits a sequence; a
knapsack dynamic program prices new patterns by the program's dual values until none is worth adding; the solution is
rounded down, its patterns are assigned to the documents ranked by length, and what is left goes by best fit into what
room there is.

Pieces are dealt by their place in the stored table into shards of about ``SHARD`` pieces, each with a program of its own, so
memory and time of a task are bounded and no length, source, document id or repeated row can make one task large. The price
is at most a few sequences a shard that are not full.

Nulls: a null or empty text is the end id alone. A null doc_id is kept as it is. Repeated rows are packed once each. An
empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .idcache import BYTES, ENCODERS, IdCache, content, slices, strings, trim

LENGTH = 4096
END = 2
SHARD = 1 << 16
#: Tokens in a class of the histogram: lengths count in these units, rounded up.
UNIT = 8
#: Pieces of at most so many tokens are left out of the program; they fill the room that is left.
FILLER = 64
#: Letters below this code point have one composed form and one lower case of one letter.
LATIN = "\u0180"
#: Which bytes are ASCII white space.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Column generation ends when the bound shows it within this share of the optimum.
GAP = 1e-3
#: Pivots for each class that may pass without the gap becoming a tenth smaller.
PATIENCE = 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts from the ids of their words.

    The tokenizer drops white space before anything else can cross it, so the ids of a text are those of its words, split
    at ASCII white space, one after the other. Words are encoded once by the tokenizer and kept.
    """

    def __init__(self, path: str, most: int = BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.cache = IdCache(self._words, most)

    def _each(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encode_batch(words, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin letters only, encoded as one text: each ends with the one id that ends a word."""
        ids = np.array(self.encode_batch([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cut = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
        if len(cut) != len(words):
            return self._each(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        plain = [w for w in words if w.isalpha() and w == w.lower() and max(w) < LATIN]
        known = dict(zip(plain, self._plain(plain), strict=True)) if plain else {}
        odd = [w for w in words if w not in known]
        if odd:
            known.update(zip(odd, self._each(odd), strict=True))
        return [known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, without end ids, and where each text ends. Each different word is looked up once."""
        words, ends = self._split(texts)
        flat, n = self.cache.ids(words.dictionary.to_pylist(), words.indices.to_numpy())
        return flat, np.r_[0, np.cumsum(n)][ends]

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many words, and how many ids without an end id, each text has."""
        words, ends = self._split(texts)
        n = self.cache.counts(strings(words.dictionary), words.indices.to_numpy())
        raw, offsets = content(texts.fill_null(""))
        word = np.r_[~SPACE[raw], False]
        start = word.copy()
        start[1:] &= ~word[:-1]
        start[offsets] = word[offsets]
        return np.diff(np.searchsorted(np.flatnonzero(start), offsets)), np.diff(np.r_[0, np.cumsum(n)][np.r_[0, ends]])

    @staticmethod
    def _split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts, and how many there are up to the end of each text.

        A-Z are lower-cased, as the tokenizer does, and a full stop or comma after a letter or digit of ASCII, which it always
        parts from the word, becomes a word of its own, so fewer different words have to be encoded. Texts that may hold a
        special token are left as they are.
        """
        texts = texts.fill_null("")
        fewer = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z0-9])([.,])([\x09-\x0D\x20]|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<"), texts, fewer))
        offsets = split.offsets.to_numpy()
        return split.flatten().dictionary_encode(), offsets[1:] - offsets[0]


@lru_cache(1)
def _encoder(path: str, most: int = BYTES) -> Encoder:
    """Kept from task to task of a worker. most: bytes that its words may take."""
    return Encoder(path, most)


ENCODERS.append(_encoder.cache_clear)


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document of n tokens."""
    full = n - n % length
    at = [*range(0, full + 1, length), *([full + length // 2] if n - full > length // 2 else []), *([n] if n > full else [])]
    return list(itertools.pairwise(at))


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, most: int = BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the pieces that every document is cut into. most: bytes of words a worker keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if most < BYTES:
            trim()
        encoder = _encoder(tokenizer, most)
        for b in batches:
            doc, start, size, crc, total = [], [], [], [], []
            for at, past in slices(b.column(1)):
                flat, ends = encoder.encode(b.column(1).slice(at, past - at))
                for k, (lo, hi) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
                    ids = np.append(flat[lo:hi], np.uint32(END)).astype("<u4")
                    raw = memoryview(ids.view(np.uint8))
                    for s, e in cuts(len(ids), length):
                        doc.append(at + k)
                        start.append(s)
                        size.append(e - s)
                        crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                        total.append(len(ids))
            longs = {n: pa.array(v, pa.int64()) for n, v in (("start", start), ("length", size), ("ids_crc32", crc), ("doc_tokens", total))}
            yield pa.record_batch({"doc_id": b.column(0).take(pa.array(doc, pa.int64()))} | longs)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def solve(width: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """The cutting-stock program by column generation: (uses, patterns), a pattern being a row of counts by class.

    width: ascending integers up to the capacity; demand: how many items each class has.
    """
    m = len(width)
    base = np.diag(capacity // width).astype(float)
    columns = base.copy()  # column k of the basis
    inverse = np.diag(1 / np.diag(base))
    uses = demand / np.diag(base)
    reach = np.searchsorted(width, np.arange(capacity + 1), side="right")
    bound, least, since = 0.0, math.inf, 0
    while True:
        # Each solution is refined by its residual in the basis itself, so the rounding errors of the inverse's updates do not add up.
        uses = np.maximum(uses + inverse @ (demand - columns @ uses), 0)
        dual = inverse.sum(axis=0)
        dual += (1 - dual @ columns) @ inverse
        best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c], item[c] = best[c - 1], -1
            if n := reach[c]:
                v = best[c - width[:n]] + dual[:n]
                k = int(v.argmax())
                if v[k] > best[c] + 1e-12:
                    best[c], item[c] = v[k], k
        # No solution needs fewer than the dual value over the best price of a pattern: near it, the program is solved. If so many
        # pivots no longer narrow the gap, as in degenerate programs, the solution in hand is taken; all pieces are packed either way.
        value = float(uses.sum())
        bound = max(bound, float(dual @ demand) / best[capacity])
        since += 1
        if value / bound - 1 < 0.9 * least:
            least, since = value / bound - 1, 0
        if best[capacity] <= 1 + 1e-9 or least <= gap or since > PATIENCE * m:
            break
        new, c = np.zeros(m), capacity
        while c > 0:
            if item[c] < 0:
                c -= 1
            else:
                new[item[c]] += 1
                c -= width[item[c]]
        move = inverse @ new
        move += inverse @ (new - columns @ move)
        ratio = np.where(move > 1e-9, uses / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        uses = np.maximum(uses - step * move, 0)
        uses[out] = step
        columns[:, out] = new
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    return uses, columns.T


def pack(size: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of items of these sizes, in the order given; the items should come ranked by size."""
    n = len(size)
    sequence, offset = np.full(n, -1), np.zeros(n, np.int64)
    full = np.flatnonzero(size == capacity)
    sequence[full] = np.arange(len(full))
    room: list[int] = [0] * len(full)
    left = np.flatnonzero(size <= FILLER)
    small = np.flatnonzero((size > FILLER) & (size < capacity))
    if len(small):
        cls = -(-size[small] // UNIT)
        width, at, demand = np.unique(cls, return_inverse=True, return_counts=True)
        by_class = np.split(small[np.argsort(at, kind="stable")], np.cumsum(demand)[:-1])
        taken = np.zeros(len(width), np.int64)
        uses, patterns = solve(width, demand, capacity // UNIT)
        for use, pattern in sorted(zip(np.floor(uses + 1e-9).astype(int), patterns.astype(int).tolist(), strict=True), key=lambda x: x[1]):
            held = [(i, c) for i, c in enumerate(pattern) if c]
            use = min([use, *((demand[i] - taken[i]) // c for i, c in held)])
            if use < 1:
                continue
            rows = np.concatenate([by_class[i][taken[i] : taken[i] + use * c].reshape(c, use) for i, c in held])
            for i, c in held:
                taken[i] += use * c
            offset[rows] = np.cumsum(size[rows], axis=0) - size[rows]
            sequence[rows] = len(room) + np.arange(use)[None, :]
            room += (capacity - size[rows].sum(axis=0)).tolist()
        left = np.concatenate([left, *(c[t:] for c, t in zip(by_class, taken, strict=True))])
    free = sorted((r, k) for k, r in enumerate(room) if r)
    for i in sorted(left.tolist(), key=lambda i: (-size[i], i)):
        s = int(size[i])
        k = bisect.bisect_left(free, (s, -1))
        r, q = free.pop(k) if k < len(free) else (capacity, len(room))
        if q == len(room):
            room.append(capacity)
        sequence[i], offset[i] = q, capacity - r
        if r > s:
            bisect.insort(free, (r - s, q))
    return sequence, offset


RESULT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    sequence, offset = pack(rows["length"].to_numpy(np.int64))
    return rows.assign(sequence_id=(int(key[0]) << 40) + sequence, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack_documents(docs: DataFrame, tokenizer: str | None = None, shard: int = SHARD, most: int = BYTES) -> DataFrame:
    """One row for each piece: where it starts in its document, its length and checksum, its sequence and offset there.

    most: bytes that the words a worker keeps may take, about; with fewer than the default, it also gives freed memory back.
    """
    cut = settled(pieces(docs, tokenizer or tokenizer_path(), most=most).withColumn("place", F.monotonically_increasing_id()), "pieces")
    shards = max(1, math.ceil(cut.count() / shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards))).drop("place")
    return dealt.groupBy("shard").applyInPandas(_pack_shard, RESULT)
