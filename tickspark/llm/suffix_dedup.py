"""Removal of text that an earlier document has too: every byte of a 50-byte string that also starts in a document with a
smaller doc_id. Judged on the input, so removals do not influence each other.

A suffix array of the whole corpus fits no task, so equal strings are first brought together:

1. Documents are dealt into buckets of about ``BUCKET`` bytes. In every 50-byte string the 16-byte gram with the lowest
   hash is its anchor, so equal strings have equal anchors. Of each anchor, a bucket sends one row to the reducer of its
   hash: where it is, and a hash of its context, the 84 bytes in which all strings with this anchor lie.
2. Equal contexts are whole duplicates of the one in the smallest document: decided in the bucket, or by the reducer.
   An anchor with different contexts in different documents is open, and the buckets that have it are told.
3. Open contexts are sent to the reducer of their anchor. Each is taken as the strings that start in a range of places; a
   range is halved, and its group parted by the longer gram that all its strings then share, until what is left are at
   most ``TEXTS`` different texts. Those make one text, and the suffix arrays of these (built by linear grouping,
   ``suffix_array``) put equal 50-byte strings side by side: those not in the smallest document go.
4. The spans found go back to the buckets, which apply them.

What a bucket repeats is merged before it is sent, so that an anchor, however common, reaches its reducer at most once
from each bucket, and a context once for each different text. Documents are shuffled once; the steps read that shuffle.

Nulls: a null text is empty; a row with a null doc_id keeps its text and is no source. Rows with the same doc_id do not
count as earlier than each other. An empty table gives an empty result. Other columns are ignored by ``duplicated_spans``
and kept by ``remove_duplicated``. Hashes of 64 bits decide equality of contexts within step 2.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .idcache import trim
from .suffix_array import _spans, suffix_arrays

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
#: Bytes of a context before and from its anchor on.
LEFT, WIDTH = WINDOW - 1, WINDOW - 1 + LENGTH
#: Different texts that are compared by one suffix array.
TEXTS = 48
#: Bits of an anchor's hash that travel; anchors that share them are compared in vain, no more.
SENT_BITS = 48
BUCKET = 8 << 20
#: Bytes hashed together, and characters in a batch of suffix arrays.
SLICE, BATCH = 1 << 20, 1 << 19
BASE = 0x100000001B3
NONE = np.uint64(2**64 - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 2**64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the 16-byte and 32-byte grams that start at each byte."""
    h, size = b.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        h = h[:-size] * _power(size) + h[size:] if len(h) > size else h[:0]
        size *= 2
    return h, (h[:-size] * _power(size) + h[size:] if len(h) > size else h[:0])


def _running(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every window of this width."""
    size, m = 1, a
    while 2 * size <= width:
        m = op(m[:-size], m[size:])
        size *= 2
    n = len(a) - width + 1
    return op(m[:n], m[width - size : width - size + n])


class Corpus:
    """The documents of a bucket, in order of (doc_id, hash of the text), as one run of bytes."""

    def __init__(self, table: pa.Table):
        real = table["_id"].is_valid().to_numpy()
        ids = table["_id"].fill_null(0).to_numpy()
        self.order = order = np.lexsort((table["_th"].to_numpy(), ids))
        texts = table["_text"].to_pylist()
        self.texts = [texts[i] or b"" for i in order]
        self.ids, self.real = ids[order], real[order]
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.size = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, side="right")

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Place, hash, context start and end of the anchors, and the context's hash; long documents in overlapping slices."""
        found, parted, k = [], False, 0
        while k < len(self.texts):
            if self.size[k] > SLICE:
                parted = True
                found += [self._anchors(k, k + 1, x) for x in range(int(self.start[k]), int(self.end[k]), SLICE)]
                k += 1
                continue
            lo, k2 = self.start[k], k + 1
            while k2 < len(self.texts) and self.end[k2] - lo <= SLICE:
                k2 += 1
            found.append(self._anchors(k, k2))
            k = k2
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = tuple(np.concatenate(x) for x in zip(*found, strict=True))
        if parted:  # an anchor may have been met in two slices
            one = np.unique(out[0], return_index=True)[1]
            out = tuple(x[one] for x in out)
        return out

    def _anchors(self, k: int, k2: int, begin: int | None = None) -> tuple[np.ndarray, ...]:
        """Anchors of the strings of some documents, or of those that start in the slice of one document at begin."""
        lo, hi = int(self.start[k]), int(self.end[k2 - 1])
        if begin is not None:
            lo, hi = max(lo, begin - LEFT), min(hi, begin + SLICE + WIDTH)
        b = self.bytes[lo:hi]
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        if len(b) < LENGTH:
            return none
        h16, h32 = gram_hashes(b)
        h = np.minimum(_mix(h16), NONE - np.uint64(1)) | np.uint64(1)
        low = _running(h, WINDOW, np.minimum)
        ok = np.zeros(len(low) + 1, np.int64)
        good = self.real[k:k2] & (self.size[k:k2] >= LENGTH)
        first, past = self.start[k:k2][good], self.end[k:k2][good] - LENGTH + 1
        if begin is not None:
            first, past = np.maximum(first, begin), np.minimum(past, begin + SLICE)
            first, past = first[first < past], past[first < past]
        np.add.at(ok, first - lo, 1)
        np.add.at(ok, past - lo, -1)
        low[np.cumsum(ok[:-1]) == 0] = 0  # strings that cross documents
        pad = np.zeros(WINDOW - 1, np.uint64)
        at = np.flatnonzero(_running(np.r_[pad, low, pad], WINDOW, np.maximum) == h)
        doc = self.doc(at + lo)
        s = np.maximum(at - (WINDOW - 1), self.start[doc] - lo)
        e = np.minimum(at + LENGTH, self.end[doc] - lo)
        # The first, the last and a middle 32 bytes cover a context, which has 50 to 84.
        ctx = h32[s] * _power(97) + h32[np.minimum(s + 25, e - 32)] * _power(41) + h32[e - 32]
        ctx = _mix(ctx + ((at - s) * 128 + (e - at)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return at + lo, h[at], s + lo, e + lo, ctx


def _pack(a: np.ndarray, delta: bool = False) -> bytes:
    """Compressed bytes of an integer array, byte planes apart; delta for sorted ones."""
    a = np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)) if delta else a)
    return pa.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def _unpack(raw: bytes, kind: str, n: int, delta: bool = False) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    a = np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()
    return np.cumsum(a, dtype=a.dtype) if delta else a


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True at the first of each run of equal rows of sorted keys."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


def _local(c: Corpus) -> dict[str, np.ndarray]:
    """The anchors of a bucket in order of (hash, context, place), with what the bucket can tell by itself.

    dup: an equal context lies in a smaller document of the bucket. rep: in the smallest document with its context. many: its anchor has
    different contexts in the bucket; open: and in different documents. lead: the first row of its anchor.
    """
    at, h, s, e, ctx = c.anchors()
    o = np.lexsort((at, ctx, h))
    at, h, s, e, ctx = at[o], h[o], s[o], e[o], ctx[o]
    ids = c.ids[c.doc(at)] if len(at) else np.zeros(0, np.int64)
    lead, same = _groups(h), _groups(h, ctx)
    g, gc = np.cumsum(lead) - 1, np.cumsum(same) - 1
    heads, chead = np.flatnonzero(lead), np.flatnonzero(same)
    if not len(at):
        empty = np.zeros(0, bool)
        return {"at": at, "h": h, "s": s, "e": e, "ctx": ctx, "ids": ids, "dup": empty, "rep": empty, "many": empty, "open": empty, "lead": empty}
    least = ids[chead][gc]  # documents are in order of their ids, so the first has the least
    many = np.add.reduceat(same.astype(np.int64), heads)[g] > 1
    apart = (np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads))[g]
    return {"at": at, "h": h, "s": s, "e": e, "ctx": ctx, "ids": ids, "dup": ids > least, "rep": ids == least, "many": many, "open": many & apart, "lead": lead}


MESSAGE = "r int, bucket long, n long, a binary, b binary, c binary, d binary, e binary"
_FIELDS = pa.schema([("r", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), *[(k, pa.binary()) for k in "abcde"]])


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS) if rows else _FIELDS.empty_table()


def _split(key: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    r = (key % np.uint64(parts)).astype(np.int64)
    o = np.argsort(r, kind="stable")
    cut = np.searchsorted(r[o], np.arange(parts + 1))
    return [(k, o[cut[k] : cut[k + 1]]) for k in range(parts) if cut[k] < cut[k + 1]]


def _anchor_rows(parts: int):
    """Step 1: a row for each anchor of a bucket; one with different contexts has 0 in place of a context."""

    def run(table: pa.Table) -> pa.Table:
        c = Corpus(table)
        a = _local(c)
        bucket = table["_bucket"][0].as_py()
        sent = np.flatnonzero(a["lead"])
        rows = []
        key = a["h"] >> np.uint64(64 - SENT_BITS)
        for r, k in _split(key[sent], parts):
            i = sent[k]
            rows.append((r, bucket, len(i), _pack(key[i], True), _pack(np.where(a["many"][i], np.uint64(0), a["ctx"][i])), _pack(a["ids"][i]), _pack(i.astype(np.uint32), True), b""))
        return _messages(rows)

    return run


def _anchor_verdicts(table: pa.Table) -> pa.Table:
    """Step 2: for each bucket, the anchors whose context is in a smaller document elsewhere, and the open ones."""
    rows = table.to_pylist()
    n = np.array([x["n"] for x in rows])
    h = np.concatenate([_unpack(x["a"], "<u8", x["n"], True) for x in rows])
    ctx = np.concatenate([_unpack(x["b"], "<u8", x["n"]) for x in rows])
    ids = np.concatenate([_unpack(x["c"], "<i8", x["n"]) for x in rows])
    place = np.concatenate([_unpack(x["d"], "<u4", x["n"], True) for x in rows])
    row = np.repeat(np.arange(len(rows)), n)
    o = np.lexsort((ids, h))
    h, ctx, ids, place, row = h[o], ctx[o], ids[o], place[o], row[o]
    heads = np.flatnonzero(_groups(h))
    g = np.cumsum(_groups(h)) - 1
    lone = np.diff(np.r_[heads, len(h)])[g] == 1
    open_ = ((np.minimum.reduceat(ctx, heads) != np.maximum.reduceat(ctx, heads)) | (np.minimum.reduceat(ctx, heads) == 0))[g] & ~lone
    open_ &= (np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads))[g] | (np.minimum.reduceat(ctx, heads) == 0)[g]
    dup = ~lone & ~open_ & (ids > ids[heads][g])
    out = []
    for r, k in _split(row.astype(np.uint64), len(rows)):
        d, p = place[k][dup[k]], place[k][open_[k]]
        if len(d) or len(p):
            out.append((0, rows[r]["bucket"], len(d), _pack(np.sort(d), True), _pack(np.sort(p), True), len(p).to_bytes(8, "little"), b"", b""))
    return _messages(out)


def _told(c: Corpus, told: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The anchors of a bucket with all verdicts: which are duplicates, and which have to be compared."""
    a = _local(c)
    dup, open_ = a["dup"].copy(), a["open"].copy()
    if len(a["at"]):
        g = np.cumsum(a["lead"]) - 1
        gone, wide = np.zeros(g[-1] + 1, bool), np.zeros(g[-1] + 1, bool)
        for x in told.to_pylist():
            gone[g[_unpack(x["a"], "<u4", x["n"], True)]] = True
            wide[g[_unpack(x["b"], "<u4", int.from_bytes(x["c"], "little"), True)]] = True
        # The lead of an anchor that is not open in its bucket stands for all rows of it.
        dup |= gone[g]
        open_ |= wide[g]
    return a, dup, open_ & a["rep"] & ~dup


def _context_rows(parts: int):
    """Step 3: the open contexts, to the reducers of their anchors; the spans that are decided, to the bucket's."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return _FIELDS.empty_table()
        c = Corpus(table)
        bucket = table["_bucket"][0].as_py()
        a, dup, open_ = _told(c, told)
        rows = []
        lo, hi = _merged(a["s"][dup], a["e"][dup])
        if len(lo):
            rows.append((bucket % parts, bucket, len(lo), _pack(lo, True), _pack(hi - lo), b"", b"", b"span"))
        k = np.flatnonzero(open_)
        key = a["h"][k] >> np.uint64(64 - SENT_BITS)
        for r, j in _split(key, parts):
            i = k[j]
            raw = pa.compress(c.bytes[_spans(a["s"][i], a["e"][i] - a["s"][i])].tobytes(), codec="zstd", asbytes=True)
            meta = np.stack([a["at"][i] - a["s"][i], a["e"][i] - a["at"][i]], axis=1).astype(np.uint8)
            rows.append((r, bucket, len(i), _pack(key[j], True), _pack(a["ids"][i]), _pack(a["at"][i].astype("<u4")), _pack(meta.view("<u2").ravel()), raw))
        return _messages(rows)

    return run


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, those that overlap or touch joined."""
    if not len(lo):
        return lo, hi
    o = np.argsort(lo, kind="stable")
    lo, hi = lo[o], np.maximum.accumulate(hi[o])
    first = np.r_[True, lo[1:] > hi[:-1]]
    return lo[first], hi[np.r_[np.flatnonzero(first)[1:] - 1, len(hi) - 1]]


def repeated_strings(raw: np.ndarray, size: np.ndarray, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(half, offset) of the strings of ``LENGTH`` that a half with a smaller id of the same group has too.

    raw: the halves one after the other; group: ascending, the text that each is part of.
    """
    first = np.flatnonzero(_groups(group))
    halves = np.diff(np.r_[first, len(group)])
    letters = np.add.reduceat(size + 1, first)
    order = np.argsort(letters, kind="stable")
    found: list[np.ndarray] = []
    off = np.cumsum(size) - size
    k = 0
    while k < len(order):
        n = max(1, int(np.searchsorted(np.cumsum(letters[order[k:]]), BATCH, side="right")))
        pick = order[k : k + n]
        k += n
        h = _spans(first[pick], halves[pick])
        s = size[h]
        begin = np.cumsum(s + 1) - (s + 1)
        text = np.ones(int((s + 1).sum()), np.int16)  # 1 parts halves, 0 ends a text
        text[_spans(begin, s)] = raw[_spans(off[h], s)].astype(np.int16) + 2
        total = letters[pick]
        text[np.cumsum(total) - 1] = 0
        sa = suffix_arrays(text, total)
        owner = np.repeat(np.arange(len(h)), s + 1)
        place = sa - begin[owner[sa]]
        keep = place <= s[owner[sa]] - LENGTH
        sa, place = sa[keep], place[keep]
        if not len(sa):
            continue
        own = owner[sa]
        txt = np.repeat(np.arange(len(pick)), halves[pick])[own]
        view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
        new = np.ones(len(sa), bool)
        for i in range(1, len(sa), 1 << 16):
            j = min(i + (1 << 16), len(sa))
            new[i:j] = (txt[i:j] != txt[i - 1 : j - 1]) | (view[sa[i:j]] != view[sa[i - 1 : j - 1]]).any(axis=1)
        head = np.flatnonzero(new)
        cls = np.cumsum(new) - 1
        doc = ids[h][own]
        dup = doc > np.minimum.reduceat(doc, head)[cls]
        found.append(np.stack([h[own[dup]], place[dup]]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _hash_rows(m: np.ndarray, *seeds: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a byte matrix, with numbers that count as part of them."""
    weight = np.array([pow(BASE, i + 1, 2**64) for i in range(m.shape[1])], np.uint64)
    out = np.concatenate([(m[i : i + (1 << 14)].astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) for i in range(0, len(m), 1 << 14)] or [np.zeros(0, np.uint64)])
    for k, x in enumerate(seeds):
        out += x.astype(np.uint64) * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 2**64))
    return _mix(out)


class Contexts:
    """Contexts side by side, their anchors in one column and zeros beyond their ends, and the spans found in them."""

    def __init__(self, rows: list[dict]):
        n = [x["n"] for x in rows]
        self.key = np.concatenate([_unpack(x["a"], "<u8", x["n"], True) for x in rows])
        self.ids = np.concatenate([_unpack(x["b"], "<i8", x["n"]) for x in rows])
        self.at = np.concatenate([_unpack(x["c"], "<u4", x["n"]) for x in rows]).astype(np.int64)
        meta = np.concatenate([_unpack(x["d"], "<u2", x["n"]) for x in rows]).view(np.uint8).reshape(-1, 2).astype(np.int16)
        self.before, self.after = meta[:, 0], meta[:, 1]
        self.row = np.repeat(np.arange(len(rows)), n)
        self.text = np.zeros((len(self.key), WIDTH), np.uint8)
        done = 0
        for x in rows:
            part = slice(done, done + x["n"])
            size = int((self.before[part] + self.after[part]).sum())
            raw = np.frombuffer(pa.decompress(x["e"], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
            col = np.arange(WIDTH)[None, :]
            self.text[part][(col >= LEFT - self.before[part, None]) & (col < LEFT + self.after[part, None])] = raw
            done += x["n"]
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take(self, i: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Notes spans, relative to the anchors, that go."""
        self.found.append((self.row[i], self.at[i] + start, self.at[i] + end))

    def range(self, i: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last start, within a..b relative to the anchor, of the strings that these contexts have."""
        return np.maximum(a, -self.before[i]).astype(np.int64), np.minimum(b, self.after[i] - LENGTH).astype(np.int64)

    def settle(self, i: np.ndarray, group: np.ndarray, a: int, b: int) -> None:
        """Compares the strings that start at a..b in the contexts i of each group."""
        first, last = self.range(i, a, b)
        i, group, first, last = (x[first <= last] for x in (i, group, first, last))
        if not len(i):
            return
        text = _hash_rows(self.text[i, LEFT + a : LEFT + b + LENGTH], first - a, b - last)
        o = np.lexsort((self.ids[i], text, group))
        i, group, first, last, text = i[o], group[o], first[o], last[o], text[o]
        ids = self.ids[i]
        lead, same = _groups(group), _groups(group, text)
        g, verdict = np.cumsum(lead) - 1, np.cumsum(same) - 1
        heads, one = np.flatnonzero(lead), np.flatnonzero(same)
        more = ids > ids[one][verdict]
        self.take(i[more], first[more], last[more] + LENGTH)
        kinds = np.add.reduceat(same.astype(np.int64), heads)
        apart = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
        left = ~more & ((kinds > 1) & apart)[g]
        # Groups of many texts, and all at first, are parted by the longer gram of half their strings.
        small = (kinds <= TEXTS)[g] & (b - a < LEFT)
        part = np.flatnonzero(left & ~small)
        if len(part):
            mid = (a + b) // 2
            for x, y in ((a, mid), (mid + 1, b)):
                # Bytes y to x + 50 lie in all strings that start at x..y.
                p = part[(np.maximum(first[part], x) <= np.minimum(last[part], y))]
                gram = _hash_rows(self.text[i[p], LEFT + y : LEFT + x + LENGTH], g[p])
                self.settle(i[p], np.unique(gram, return_inverse=True)[1], x, y)
        self.compare(i, g, first, last, verdict, left & small)

    def compare(self, i: np.ndarray, g: np.ndarray, first: np.ndarray, last: np.ndarray, verdict: np.ndarray, pick: np.ndarray) -> None:
        """Suffix arrays of the texts of each group; rows of one text and document get one verdict."""
        rows = np.flatnonzero(pick)
        if not len(rows):
            return
        lead = _groups(verdict[rows])
        one, alike = rows[lead], np.cumsum(lead) - 1
        step = max(1, BATCH // WIDTH)
        at = 0
        while at < len(one):
            end = min(at + step, len(one))
            while end < len(one) and g[one[end]] == g[one[end - 1]]:
                end += 1
            p = one[at:end]
            size = last[p] - first[p] + LENGTH
            col = np.arange(WIDTH)[None, :]
            raw = self.text[i[p]][(col >= LEFT + first[p, None]) & (col < LEFT + last[p, None] + LENGTH)]
            half, place = repeated_strings(raw, size, g[p], self.ids[i[p]])
            o = np.argsort(half, kind="stable")
            half, place = half[o] + at, place[o]
            these = np.flatnonzero((alike >= at) & (alike < end))
            lo, hi = np.searchsorted(half, alike[these]), np.searchsorted(half, alike[these], side="right")
            src = rows[np.repeat(these, hi - lo)]
            start = first[src] + place[_spans(lo, hi - lo)]
            self.take(i[src], start, start + LENGTH)
            at = end


def _compare(table: pa.Table) -> pa.Table:
    """Step 3 at the reducer: the spans of each bucket that a smaller document has too."""
    rows = table.to_pylist()
    out = [(0, x["bucket"], x["n"], x["a"], x["b"], b"", b"", b"") for x in rows if x["e"] == b"span"]
    rows = [x for x in rows if x["e"] != b"span"]
    if not rows:
        return _messages(out)
    c = Contexts(rows)
    c.settle(np.arange(len(c.key)), np.unique(c.key, return_inverse=True)[1], -LEFT, 0)
    if c.found:
        who, lo, hi = (np.concatenate(x) for x in zip(*c.found, strict=True))
        for r, j in _split(who.astype(np.uint64), len(rows)):
            a, b = _merged(lo[j], hi[j])
            out.append((0, rows[r]["bucket"], len(a), _pack(a, True), _pack(b - a), b"", b"", b""))
    return _messages(out)


def _removed(c: Corpus, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged spans of a bucket, and the document of each; spans of neighbours that touch stay apart."""
    spans = [(_unpack(x["a"], "<i8", x["n"], True), _unpack(x["b"], "<i8", x["n"])) for x in found.to_pylist()]
    lo = np.concatenate([a for a, _ in spans] + [np.zeros(0, np.int64)])
    hi = lo + np.concatenate([b for _, b in spans] + [np.zeros(0, np.int64)])
    # A merged span can run over the end of a document only where another one starts there; it is parted again.
    if not len(lo):
        return lo, hi, lo
    lo, hi = _merged(lo, hi)
    inner = c.start[c.size > 0]
    k = np.searchsorted(lo, inner, side="right") - 1
    inside = (k >= 0) & (inner < hi[np.maximum(k, 0)]) & (inner > lo[np.maximum(k, 0)])
    lo, hi = np.sort(np.r_[lo, inner[inside]]), np.sort(np.r_[hi, inner[inside]])
    return lo, hi, c.doc(lo)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _digest(table: pa.Table, found: pa.Table) -> pa.Table:
    """Step 4: what is removed from each document, and the digest of what is left."""
    c = Corpus(table)
    lo, hi, doc = _removed(c, found)
    cut = np.searchsorted(doc, np.arange(len(c.texts) + 1))
    gone, sha = np.zeros(len(c.texts), np.int64), []
    for k, text in enumerate(c.texts):
        d, at = hashlib.sha256(), 0
        for i in range(cut[k], cut[k + 1]):
            a, b = int(lo[i] - c.start[k]), int(hi[i] - c.start[k])
            d.update(text[at:a])
            gone[k] += b - a
            at = b
        d.update(text[at:])
        sha.append(d.hexdigest())
    ids = pa.array(c.ids, pa.int64(), mask=~c.real)
    return pa.table({"doc_id": ids, "n_bytes": c.size, "n_removed": gone, "n_spans": np.diff(cut), "kept_sha256": pa.array(sha, pa.string())})


def _kept(columns: list[str]):
    """Step 4: the rows of a bucket with what is left of their text; a character that loses a byte goes whole."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        trim()
        c = Corpus(table)
        lo, hi, doc = _removed(c, found)
        rows = table.take(pa.array(c.order))
        text = rows["_text"].to_pylist()
        cut = np.searchsorted(doc, np.arange(len(text) + 1))
        hit = np.flatnonzero(np.diff(cut))
        for k in hit.tolist():
            at, parts = 0, []
            for i in range(cut[k], cut[k + 1]):
                parts.append(text[k][at : int(lo[i] - c.start[k])])
                at = int(hi[i] - c.start[k])
            parts.append(text[k][at:])
            text[k] = b"".join(parts).decode(errors="ignore").encode()
        row = rows["__row"].combine_chunks()
        out = {n: row.field(n) for n in columns if n != "text"}
        if "n_chars" in out:
            n = out["n_chars"].to_pylist()
            for k in hit.tolist():
                n[k] = len(text[k].decode())
            out["n_chars"] = pa.array(n, out["n_chars"].type)
        out["text"] = pa.array(text, pa.binary()).cast(pa.string())
        out = {n: out[n] for n in columns}
        return pa.table(out)

    return run


def _dealt(docs: DataFrame) -> DataFrame:
    """docs with the id, the bytes and the hash of the text and the bucket, but without the text itself."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(others.alias("__row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"), F.xxhash64("text").alias("_th"))
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_th"), F.lit(max(1, math.ceil(total / BUCKET)))).cast("long"))


def _apply(dealt: DataFrame, last, kind: str) -> DataFrame:
    parts = shuffle_partitions(dealt.sparkSession)
    sent = dealt.groupBy("_bucket").applyInArrow(_anchor_rows(parts), MESSAGE)
    told = sent.groupBy("r").applyInArrow(_anchor_verdicts, MESSAGE)
    open_ = dealt.groupBy("_bucket").cogroup(told.groupBy("bucket")).applyInArrow(_context_rows(parts), MESSAGE)
    found = open_.groupBy("r").applyInArrow(_compare, MESSAGE)
    return dealt.groupBy("_bucket").cogroup(found.groupBy("bucket")).applyInArrow(last, kind)


def duplicated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return _apply(_dealt(docs).select("_id", "_text", "_th", "_bucket"), _digest, RESULT)


def remove_duplicated(docs: DataFrame) -> DataFrame:
    """docs without the bytes that an earlier document has too; the same columns."""
    return _apply(_dealt(docs), _kept(docs.columns), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
