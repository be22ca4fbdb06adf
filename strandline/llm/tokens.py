"""Vectorised word hashing shared by the corpus operators.

A word is a maximal run of bytes other than space and \\x09-\\x0D, taken after
lower-casing A-Z, of the UTF-8 text.  Every word gets a 64-bit hash: its bytes are
read in lanes of eight, and each lane is put into the state and mixed by a bijection,
so words of equal length up to eight bytes never collide, and no sum or product over
places can cancel out.  Spans over LONG bytes are hashed by BLAKE2b.  All of it is
array arithmetic over a whole chunk of texts, so no Python object is made for a word.

Where equality of two spans decides a result, `distinct` compares their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: The bytes of a lane that a span of n bytes has.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SEED = _U(0x9E3779B97F4A7C15)

#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Longer spans than this are hashed one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of one buffer."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    if word[-1]:
        edge = np.concatenate((edge, [len(raw)]))
    return edge[0::2], edge[1::2]


class Hasher:
    """64-bit hashes of byte spans of one buffer, after lower-casing A-Z if fold; spans may overlap."""

    def __init__(self, raw: np.ndarray, fold: bool = True):
        padded = np.zeros((len(raw) // 8 + 2) * 8, np.uint8)
        padded[: len(raw)] = _LOWER[raw] if fold else raw
        self._raw, self._lanes = padded, padded.view("<u8")

    def _lane(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes from each place on, or as many as are left."""
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        lane = self._lanes[place] >> shift | (self._lanes[place + 1] << (_U(63) - shift)) << _U(1)
        return lane & _MASK[np.minimum(left, 8)]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = mix(mix(size.astype(np.uint64) + _SEED) ^ self._lane(starts, size))
        live = np.flatnonzero((size > 8) & (size <= LONG))
        for at in range(8, LONG, 8):
            if not len(live):
                break
            out[live] = mix(out[live] ^ self._lane(starts[live] + at, size[live] - at))
            live = live[size[live] > at + 8]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self._raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def same(self, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
        """Whether each span has the bytes of the span whose number `like` gives."""
        size = ends - starts
        if (size != size[like]).any():
            return False
        live, at = np.flatnonzero((size <= LONG) & (like != np.arange(len(like)))), 0
        while len(live):
            left = size[live] - at
            if (self._lane(starts[live] + at, left) != self._lane(starts[like[live]] + at, left)).any():
                return False
            at += 8
            live = live[left > 8]
        long = np.flatnonzero((size > LONG) & (like != np.arange(len(like)))).tolist()
        return all(np.array_equal(self._raw[starts[i] : ends[i]], self._raw[starts[like[i]] : ends[like[i]]]) for i in long)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    return Hasher(raw, fold)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first span of each different content, the content of each span).

    Spans are grouped by their hashes, then every one is held against the first of
    its group byte by byte; if any differs, all are told apart by their bytes.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hasher = Hasher(raw, fold)
    _, first, inverse = np.unique(hasher(starts, ends), return_index=True, return_inverse=True)
    if not hasher.same(starts, ends, first[inverse]):
        data, seen = (_LOWER[raw] if fold else raw).tobytes(), {}
        inverse = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        first = np.unique(inverse, return_index=True)[1]
    return first, inverse


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def joined(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of whole texts as (index of the first text, bytes, ends of the texts in bytes).

    A null counts as empty.  A line feed is put after every text, so that words
    never run from one text into the next.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    first, size, parts, ends = 0, 0, [], []
    for i, value in enumerate(texts):
        data = (value.as_buffer() if value.is_valid else b"") if texts.type != pa.null() else b""
        n = len(data) if isinstance(data, bytes) else data.size
        if parts and size + n > chunk_bytes:
            yield first, np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), np.array(ends)
            first, size, parts, ends = i, 0, [], []
        parts.append(data)
        size += n + 1
        ends.append(size)
    if parts:
        yield first, np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), np.array(ends)


def words(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks as (index of the first text, hashes of all words, offsets of each text's words, one more than texts)."""
    for first, raw, ends in joined(texts, chunk_bytes):
        starts, stops = word_spans(raw)
        yield first, span_hashes(raw, starts, stops), np.concatenate(([0], np.searchsorted(starts, ends)))
