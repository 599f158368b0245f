"""Ids of texts from the ids of their words, kept by each Python worker within a bound of bytes."""

from __future__ import annotations

import ctypes
import gc
import weakref
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the words of a worker may take, about; longer keys are not kept at all.
BYTES, KEY_LENGTH = 192 << 20, 48
#: Bytes that an entry takes besides its ids: key, value and place in a table.
ENTRY = 200
#: Words encoded together.
TOGETHER = 8192
#: Texts, and bytes of texts, that are encoded together; a longer text is encoded alone.
ROWS, ROW_BYTES = 512, 2 << 20


def slices(texts: pa.Array, rows: int = ROWS, most: int = ROW_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of at most so many rows and, but for a single longer text, bytes."""
    size = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(texts):
        past = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        yield at, (at := min(len(texts), at + rows, max(past, at + 1)))


def content(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, none null, one after the other, and where they start and the last ends."""
    texts = texts.cast(pa.string())  # Spark may be set to send large strings
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(words: pa.Array) -> list[str]:
    """to_pylist of words, none null, without a step of Python for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


#: The caches of this worker, and what drops the encoders that hold them.
_CACHES: weakref.WeakSet = weakref.WeakSet()
ENCODERS: list[Callable[[], None]] = []


def trim() -> None:
    """Gives back to the system what this worker has freed: earlier tasks, of other stages too, leave freed memory behind."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def release() -> None:
    """Gives back what earlier tasks of this worker keep for operators that encode words; Spark runs the tasks of every stage
    in the same workers."""
    if any(c.size or c.old for c in _CACHES):
        for c in _CACHES:
            c.clear()
        for drop in ENCODERS:
            drop()
        gc.collect()
    trim()


class IdCache:
    """encode_many gives the ids of each of a list of words, as the bytes of unsigned 32-bit numbers.

    Words are kept in two generations of half the bytes each. When the new one is full it becomes the old one and the old
    one goes; a word that is found in the old one moves to the new, so frequent words stay, whatever the others.
    """

    def __init__(self, encode_many: Callable[[list], Sequence[bytes]], limit: int = BYTES):
        self.encode_many, self.half = encode_many, limit // 2
        self.clear()
        _CACHES.add(self)

    def clear(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def _keep(self, words: list[str], ids: Sequence[bytes]) -> None:
        short = {w: x for w, x in zip(words, ids, strict=True) if len(w) <= KEY_LENGTH}
        self.new.update(short)
        self.size += ENTRY * len(short) + sum(map(len, short.values()))
        if self.size > self.half:
            self.old, self.new, self.size = self.new, {}, 0

    def get(self, words: list[str]) -> list[bytes]:
        """The ids of each of these different words."""
        out = list(map(self.new.get, words))
        gaps = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(gaps), TOGETHER):
            part = gaps[k : k + TOGETHER]
            names = [words[i] for i in part]
            again = list(map(self.old.get, names))
            missing = [i for i, x in enumerate(again) if x is None]
            for i, x in zip(missing, self.encode_many([names[i] for i in missing]) if missing else (), strict=True):
                again[i] = x
            for i, x in zip(part, again, strict=True):
                out[i] = x
            self._keep(names, again)
        return out

    def ids(self, words: list[str], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one after the other, and how many each has. words: all different."""
        found = self.get(words)
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        first, n = (np.cumsum(count) - count)[places], count[places]
        ends = np.cumsum(n)
        return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)], n

    def counts(self, words: list[str], places: np.ndarray) -> np.ndarray:
        """How many ids the words at these places have."""
        return np.fromiter(map(len, self.get(words)), np.int64, len(words))[places] // 4
