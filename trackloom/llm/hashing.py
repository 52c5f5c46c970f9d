"""Word hashes of whole texts, made with numpy over the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULT = np.uint64(0x9E3779B97F4A7C15)
_C1 = np.uint64(0xBF58476D1CE4E5B9)
_C2 = np.uint64(0x94D049BB133111EB)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Space and ASCII punctuation: what separates runs of letters and digits.
BREAK = SPACE.copy()
BREAK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 steps)."""
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MULT)
_INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of ``MULT`` and of its inverse."""
    global _powers, _inverses
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * MULT)])
        _inverses = np.concatenate([_inverses, _inverses * (_inverses[-1:] * _INVERSE)])
    return _powers, _inverses


def slices(array: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(start, stop) of stretches of a string array with about ``most_bytes`` bytes each."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(array).to_numpy(zero_copy_only=False), float))
    part = (np.cumsum(sizes) // most_bytes).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(array)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets of each); null texts are empty."""
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a string array, text by text.

    ``hash``: one per word, with A-Z taken as a-z; ``at``: index of the first word of each
    text, and the total; ``start`` and ``size``: place and length of a word in ``data``, the bytes.
    """

    def __init__(self, array: pa.Array, breaks: np.ndarray = SPACE):
        raw, offsets = text_bytes(array)
        data = self.data = _LOWER[raw]
        inside = ~breaks[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        first[edge] |= inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.start = np.flatnonzero(first)
        self.size = np.flatnonzero(last) + 1 - self.start
        self.at = np.searchsorted(self.start, offsets)
        # a byte's value times a power by its place in all the data; the word's own first
        # place is divided out of the sum, so equal words have equal sums wherever they stand
        powers, inverses = _power_tables(len(data))
        value = np.where(inside, _BYTE[data], np.uint64(0)) * powers[: len(data)]
        self.hash = self._sum(value, self.size, inverses)

    def _sum(self, value: np.ndarray, size, inverses: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return mix(np.add.reduceat(value, self.start) * inverses[self.start] + np.asarray(size, np.uint64) * MULT)

    def stems(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the first ``length`` bytes, text number) of the words that have as many."""
        n = np.diff(self.at)
        keep = self.size >= length
        start = self.start[keep]
        h = np.zeros(len(start), np.uint64)
        for k in range(length):
            h += _BYTE[self.data[start + k]] * _power_tables(length)[0][k]
        return mix(mix(h + np.full(1, length, np.uint64) * MULT) + np.uint64(length)), np.repeat(np.arange(len(n)), n)[keep]


def ngrams(h: np.ndarray, at: np.ndarray, places: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at ``i + p`` for each ``p`` of ``places``, inside one text.

    Returns (hash, text number) for every ``i`` whose last place is in the same text.
    """
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    last = places[-1]
    if len(h) <= last:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = doc[last:] == doc[: len(doc) - last]
    total = np.zeros(len(h) - last, np.uint64)
    for k, p in enumerate(places):
        total += h[p : len(h) - last + p] * np.uint64(2 * k + 3) * MULT
        total = (total << np.uint64(13)) | (total >> np.uint64(51))
    return mix(total[keep] + np.uint64(len(places) * 131 + last)), doc[: len(doc) - last][keep]
