"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model is compiled to three machines. The normaliser maps a space to the mark and every other character to itself, with a
mark in front of the text. The pieces are a trie of states and arcs over characters, whose final states give a piece. The
byte fallback is an arc for any single character that no piece spells; its output are the characters' bytes. Composed with
an input they are an acyclic lattice: an arc from position i to j for each piece that the input spells there. The encoding is
the shortest path through the lattice in the tropical semiring: distances are relaxed from left to right, all arcs into a
position, by min and +.

A unigram model's arcs weigh the negative score of their piece. A BPE model does not minimise a sum of scores: its result
is the one segmentation in which every two neighbours stay apart when merged on their own. That is a property of
neighbours, so it is a weight too: an arc weighs 0 after a piece that it stays apart from, and infinity after any other.
One path into each position is then finite. Whether two pieces stay apart is found by the merge rules and kept in a table of
fixed size, in which a pair may drive out another.

No piece continues over the mark that starts a word, so inputs are composed word by word. With byte fallback they are also cut
between two characters that stand side by side in no piece, such as a letter and a comma: no piece and no merge crosses
that place, and fewer different words are left. The ids of words are kept by each worker (``IdCache``). Words are composed and relaxed together, position by position, as arrays; a word of over ``LONG``
characters goes through the same steps alone. Models with a character map, user-defined pieces or pieces across words raise
ValueError.

Nulls: a null or empty text has no ids and decodes to an empty text. Repeated rows are encoded one by one. An empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .idcache import IdCache, content, slices, strings

MARK = "▁"
#: Characters of a word that is relaxed alone; cells (words times positions) that are relaxed together.
LONG, CELLS = 64, 1 << 17
#: Places of the table of pairs of pieces.
PAIRS = 1 << 21
#: Numbers of pieces end here; a larger number is that of a lone character, by its code point.
POINTS = 1 << 20
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Transducer:
    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.kind: list[int] = []
        self.score: list[float] = []
        self.type, self.prefix, charsmap, extra = UNIGRAM, True, b"", True
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.score.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kind.append(f.get(3, NORMAL))
            elif number == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                charsmap, self.prefix, extra = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        if charsmap or extra or USER in self.kind or self.type not in (UNIGRAM, BPE):
            raise ValueError("only models with the identity normaliser and no user-defined pieces are compiled")
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kind, strict=True)) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece continues over the start of a word")
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kind, strict=True)) if k == BYTE}
        self.unknown = self.kind.index(UNKNOWN)
        low = min((self.score[i] for i in self.id.values()), default=0.0)
        self.unknown_weight = 10.0 - low
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kind, strict=True)]
        self._compile()
        self.time = [-x for x in self.score]
        self.edges: dict[int, tuple[bool, list, list] | None] = {}
        self.pair_key, self.pair_apart = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.cache = IdCache(lambda words: self.shortest_of([self.normalise(w) for w in words]))

    def _compile(self) -> None:
        """The trie of the pieces: arcs as sorted (state, character) keys with their next states, and the piece of final states."""
        arcs: dict[tuple[int, str], int] = {}
        final = [-1]
        for piece, number in self.id.items():
            state = 0
            for x in piece:
                after = arcs.get((state, x))
                if after is None:
                    after = arcs[state, x] = len(final)
                    final.append(-1)
                state = after
            final[state] = number
        keys = np.array([s << 21 | ord(x) for s, x in arcs], np.int64)
        order = np.argsort(keys)
        self.arc_key, self.arc_to = np.r_[keys[order], 2**62], np.r_[np.array(list(arcs.values()), np.int64)[order], 0]
        self.final = np.array(final, np.int64)
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        # The first arc of every walk: by character, without a search.
        self.first = np.zeros(0x110000, np.int64)
        for (state, x), after in arcs.items():
            if state == 0:
                self.first[ord(x)] = after
        # What an arc weighs by its piece alone; lone characters that are no piece have the weight of the unknown piece.
        self.weight = np.array([-x for x in self.score]) if self.type == UNIGRAM else np.zeros(len(self.score))
        self.lone = self.unknown_weight if self.type == UNIGRAM else 0.0
        self.normal = ((" ", MARK),)
        # Which characters stand side by side in a piece: by classes, 0 for all characters that are in no longer piece.
        chars = sorted({x for p in self.id if len(p) > 1 for x in p} | {MARK})
        self.cls = np.zeros(0x110000, np.int32)
        self.cls[[ord(x) for x in chars]] = np.arange(1, len(chars) + 1)
        self.cls[[ord(x) for x, y in self.normal]] = self.cls[[ord(y) for x, y in self.normal]]
        mark = self.cls[ord(MARK)]
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        if self.byte:
            for p in self.id:
                at = self.cls[[ord(x) for x in p]]
                self.beside[at[:-1], at[1:]] = True
        else:
            # Characters that are no piece give the unknown piece once in a row, so a word stays whole.
            self.beside[:] = True
            self.beside[:, mark] = False
            self.beside[mark, mark] = True

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether the merge rules leave these two neighbours as they are: best score first, then leftmost."""
        s = list(left + right)
        if left + right in self.id:
            return False  # they would be merged
        while True:
            best = None
            for i in range(len(s) - 1):
                k = self.id.get(s[i] + s[i + 1])
                if k is not None and (best is None or self.score[k] > best[0]):
                    best = self.score[k], i
            if best is None:
                return s == [left, right]
            i = best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    def _edges(self, number: int) -> tuple[bool, list, list] | None:
        """What stands at both edges of a piece while the merge rules make it from its characters; None if they don't make it.

        Whether each merge is worse than the one before, and the parts that end the piece and that start it, as (part, when it
        is made, when it is merged), the time being the negative score of a merge.
        """
        found = self.edges.get(number, 0)
        if found != 0:
            return found
        s, now, steady = list(self._text(number)), -math.inf, True
        ends, starts = [[s[-1], now, math.inf]], [[s[0], now, math.inf]]
        found = steady, ends, starts
        while len(s) > 1:
            at, best = -1, -1
            for i in range(len(s) - 1):
                k = self.id.get(s[i] + s[i + 1])
                if k is not None and (at < 0 or self.score[k] > self.score[best]):
                    at, best = i, k
            if at < 0:
                found = None
                break
            time = self.time[best]
            found = steady, ends, starts = steady and time > now, ends, starts
            now = time
            for edge, here in ((ends, at == len(s) - 2), (starts, at == 0)):
                if here:
                    edge[-1][2] = time
                    edge.append([self.pieces[best], time, math.inf])
            s[at : at + 2] = [self.pieces[best]]
        if number < POINTS:
            self.edges[number] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merge rules leave these neighbours as they are, or make the piece alone at the start (-1).

        Only parts at their common border can be merged across it, and are, if they can before either goes into a merge of its
        own piece. At equal times the leftmost is first; then, and where merges do not get worse, the rules are gone through.
        """
        b = self._edges(right)
        if b is None or left < 0:
            return b is not None
        a = self._edges(left)
        if a is None:
            return False
        clear = a[0] and b[0]
        for x, made, gone in a[1] if clear else ():
            for y, made_too, gone_too in b[2]:
                k = self.id.get(x + y)
                if k is not None:
                    since, until = max(made, made_too, self.time[k]), min(gone, gone_too)
                    if since < until:
                        return False
                    clear = clear and since > until
        return clear or self.stay_apart(self._text(left), self._text(right))

    def _text(self, number: int) -> str:
        return chr(number - POINTS) if number >= POINTS else self.pieces[number]

    def _parted(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of pieces, whether the merge rules leave it; the start (-1) may be followed by any piece that they make."""
        key = (left + 1) << 22 | right
        place = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 21)).astype(np.int64)
        out = self.pair_apart[place]
        miss = np.flatnonzero(self.pair_key[place] != key)
        if len(miss):
            new, at = np.unique(key[miss], return_inverse=True)
            apart = np.fromiter((self._apart((k >> 22) - 1, k & 0x3FFFFF) for k in new.tolist()), bool, len(new))
            out[miss] = apart[at]
            first = place[miss]
            self.pair_apart[first], self.pair_key[first] = out[miss], -1
            # Pairs of one place: the last one written counts, for the key and then for its value.
            self.pair_key[first] = key[miss]
            self.pair_apart[first] = apart[np.searchsorted(new, self.pair_key[first])]
        return out

    def _relax(self, points: np.ndarray, size: np.ndarray) -> np.ndarray:
        """words x positions: the last piece of the shortest path to each position. Words come longest first; size is their lengths."""
        n, most = points.shape
        far = np.full((n, most + 1), np.inf)
        far[:, 0] = 0
        last = np.full((n, most + 1), -1, np.int64)
        into: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(most + 1)]
        live = np.searchsorted(-size, -np.arange(most + 1), side="left")  # words longer than a position
        for i in range(most + 1):
            for start, who, piece in into[i]:
                left = last[who, start]
                lone = piece >= POINTS
                weight = far[who, start] + np.where(lone, self.lone, self.weight[np.where(lone, 0, piece)])
                if self.type == BPE:
                    weight = np.where(self._parted(left, piece), weight, np.inf)
                near = weight < far[who, i]
                far[who[near], i], last[who[near], i] = weight[near], piece[near]
            into[i] = []
            if i == most or not live[i]:
                continue
            who = np.arange(live[i])
            state = self.first[points[who, i]]
            single = self.final[state]
            spelt = (state > 0) & (single >= 0)
            into[i + 1].append((i, who, np.where(spelt, single, POINTS + points[who, i].astype(np.int64))))
            for j in range(i + 1, most):
                go = (state > 0) & (who < live[j])
                who, state = who[go], state[go]
                if not len(who):
                    break
                key = state << 21 | points[who, j].astype(np.int64)
                at = np.searchsorted(self.arc_key, key)
                state = np.where(self.arc_key[at] == key, self.arc_to[at], 0)
                piece = self.final[state]
                hit = (state > 0) & (piece >= 0)
                if hit.any():
                    # Longer arcs into a position come first, so that of equal paths the one with the longer last piece stays.
                    into[j + 1].append((i, who[hit], piece[hit]))
        return last

    def _relax_long(self, unit: str) -> list[int]:
        """The same for one long word, arc by arc: the last piece of the shortest path to each position."""
        far, last = [0.0] + [math.inf] * len(unit), [-1] * (len(unit) + 1)
        apart: dict[tuple[int, int], bool] = {}
        keys, to, final = self.arc_key, self.arc_to, self.final
        step: dict[int, int] = {}
        for i in range(len(unit)):
            state, j, left = 0, i, last[i]
            while j < len(unit):
                key = state << 21 | ord(unit[j])
                state = step.get(key, -1)
                if state < 0:
                    at = int(np.searchsorted(keys, key))
                    state = step[key] = int(to[at]) if keys[at] == key else 0
                j += 1
                piece = int(final[state]) if state else -1
                if piece < 0 and j == i + 1:
                    piece = POINTS + ord(unit[i])
                if piece >= 0:
                    weight = far[i] + (self.lone if piece >= POINTS else float(self.weight[piece]))
                    if self.type == BPE:
                        free = apart.get((left, piece))
                        if free is None:
                            if len(apart) > PAIRS:
                                apart.clear()
                            free = apart[left, piece] = self._apart(left, piece)
                        weight = weight if free else math.inf
                    if weight < far[j]:
                        far[j], last[j] = weight, piece
                if not state:
                    break
        return last

    def shortest_of(self, units: list[str]) -> list[bytes]:
        """Ids along the shortest paths through the lattices of words."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        out: list[bytes] = [b""] * len(units)
        for k in np.flatnonzero(size > LONG).tolist():
            last, path, end = self._relax_long(units[k]), [], len(units[k])
            while end:
                path.append(last[end])
                end -= len(self._text(last[end]))
            out[k] = array("I", self._spelt(path[::-1])).tobytes()
        order = np.flatnonzero(size <= LONG)
        order = order[np.argsort(-size[order], kind="stable")]
        at = 0
        while at < len(order):
            most = max(1, int(size[order[at]]))
            part = order[at : at + max(1, CELLS // most)]
            at += len(part)
            points = np.zeros((len(part), most), np.uint32)
            inside = np.arange(most)[None, :] < size[part][:, None]
            points[inside] = np.frombuffer("".join([units[k] for k in part.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            last = self._relax(points, size[part])
            # Back along the paths; words are done when they are at their start.
            who, end, paths = np.arange(len(part)), size[part].copy(), []
            while len(who):
                who = who[end[who] > 0]
                piece = last[who, end[who]]
                paths.append((who, piece))
                end[who] -= np.where(piece >= POINTS, 1, self.length[np.where(piece >= POINTS, 0, piece)])
            word = np.concatenate([w for w, _ in paths][::-1])
            piece = np.concatenate([p for _, p in paths][::-1])
            o = np.argsort(word, kind="stable")
            word, piece = word[o], piece[o]
            ends = np.searchsorted(word, np.arange(len(part)), side="right")
            raw = piece.astype("<u4").tobytes()
            odd = np.zeros(len(part), bool)
            odd[word[piece >= POINTS]] = True
            for k, lo, hi, strange in zip(part.tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), odd.tolist(), strict=True):
                out[k] = array("I", self._spelt(piece[lo:hi].tolist())).tobytes() if strange else raw[4 * lo : 4 * hi]
        return out

    def shortest(self, unit: str) -> list[int]:
        return array("I", self.shortest_of([unit])[0]).tolist()

    def _spelt(self, path: list[int]) -> list[int]:
        """The output of a path: pieces as they are, lone characters by their bytes, or else the unknown piece once in a row."""
        out: list[int] = []
        for piece in path:
            if piece < POINTS:
                out.append(piece)
            elif self.byte:
                out += [self.byte[b] for b in chr(piece - POINTS).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def normalise(self, text: str) -> str:
        for x, y in self.normal:
            text = text.replace(x, y)
        return text

    def encode_all(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and where each text ends. Each different word is looked up once."""
        words, ends = self._split(texts)
        flat, n = self.cache.ids(strings(words.dictionary), words.indices.to_numpy())
        return flat, np.r_[0, np.cumsum(n)][ends]

    def counts(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        """How many ids each text has."""
        words, ends = self._split(texts)
        n = self.cache.counts(strings(words.dictionary), words.indices.to_numpy())
        return np.diff(np.r_[0, np.cumsum(n)][np.r_[0, ends]])

    def _split(self, texts: list[str | None] | pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts, not normalised yet, and how many there are up to the end of each text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        texts = texts.fill_null("")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        raw, offsets = content(texts)
        cls = self.cls[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        cut = np.zeros(len(raw) + 1, bool)
        cut[starts[1:][~self.beside[cls[:-1], cls[1:]]]] = True
        cut[offsets] = True
        at = np.flatnonzero(cut).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw)))
        return words.dictionary_encode(), np.searchsorted(at, offsets[1:])

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids))
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode(errors="replace")


@lru_cache(2)
def _compiled(raw: bytes) -> Transducer:
    return Transducer(raw)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, how many there are and how many of them are bytes, their checksum, and whether they decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(path or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(shared.value)
        is_byte = np.array([k == BYTE for k in fst.kind])
        for b in batches:
            for s, e in slices(b.column(1)):
                part = b.slice(s, e - s)
                texts = part.column(1).to_pylist()
                flat, ends = fst.encode_all(part.column(1))
                offsets = np.r_[0, ends]
                spans = list(zip(offsets.tolist(), ends.tolist(), strict=False))
                bytes_before = np.r_[0, np.cumsum(is_byte[flat])]
                raw, ids = memoryview(np.ascontiguousarray(flat, "<u4").view(np.uint8)), flat.tolist()
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n_ids": pa.array(np.diff(offsets)),
                        "n_byte_ids": pa.array(np.diff(bytes_before[offsets])),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in spans], pa.int64()),
                        "round_trip": pa.array([fst.decode(ids[lo:hi]) == (t or "") for (lo, hi), t in zip(spans, texts, strict=True)]),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32))),
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_ids bigint, n_byte_ids bigint, ids_crc32 bigint, round_trip boolean, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids decode to an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(_model(path or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(shared.value)
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "text": pa.array([fst.decode(x.as_py() or []) for x in b.column(1)], pa.string())})

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")
