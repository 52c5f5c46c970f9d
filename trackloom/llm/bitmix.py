"""Online logistic context mixing over the bits of running text.

A text is a row of bytes: its words with one space between them, A-Z lowered, then ``END``.
Each bit has one predictor per order: the log odds that the last one to six bytes before its
byte, together with the bits of the byte so far, give it by exact counts over the training
texts. Contexts run on across words. A window, the six bytes and the byte that follows, is
one 64-bit key, so contexts are hashed for dealing them out but never share a counter.

A mixer adds the predictors' log odds with weights from the set that a gate picks (how often
the last six bytes, and the last three, were seen), trained online. A last table refines
the mixed probability by what came true at such probabilities before.

A bit's probability depends on its window alone, so a distinct window is learned and scored
once, with the weight of its occurrences. While the mixer learns, one occurrence is left
out of the counts it sees: a window seen once must be predicted as a new one will be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trackloom.llm import hashing

ORDERS = (1, 2, 3, 4, 5, 6)  # bytes of context
MOST = ORDERS[-1]
#: Orders up to this one have at most 256**2 entries and are known to every task.
LOW = 1
#: A context with more than this share of all distinct windows is heavy: there are fewer than its inverse of each length.
HEAVY_SHARE = 1 / 2000
END = 0xFF  # no byte of UTF-8
PRIOR = 0.3
LEVELS = 8  # of a context's count, for the gate
GATES = LEVELS * LEVELS
INPUTS = len(ORDERS)
GATE_ORDERS = (MOST, 3)
BUCKETS = 33
CHUNK = 4096
#: Windows of a block: what is in memory at once, but for a context that has more.
BLOCK = 65_536
RATE = 0.06


_SYMBOL = hashing._LOWER.copy()
_SYMBOL[hashing.SPACE] = 32


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(``MOST`` ends, the bytes of the first text, an end, ``MOST`` ends, ..., and where texts end)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    raw, _ = hashing.text_bytes(texts)
    if len(raw) and raw.max() == END:  # a string that is not UTF-8
        texts = pa.array([t.replace(b"\xff", b"\xfe") for t in texts.to_pylist()], pa.large_binary())
    marks = pa.scalar(b"\xff" * (MOST + 1), pa.large_binary())
    raw, _ = hashing.text_bytes(pc.binary_join_element_wise(texts, marks, pa.scalar(b"", pa.large_binary())))
    data = np.concatenate([np.full(MOST, END, np.uint8), _SYMBOL[raw]])
    space = data == 32
    keep = ~space
    keep[1:] |= ~space[:-1] & (data[:-1] != END)  # the first space after a word
    data = data[keep]
    keep = data != 32
    keep[:-1] |= data[1:] != END  # but not before the end
    data = data[keep]
    return data, np.flatnonzero(data == END)[MOST :: MOST + 1]


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows of all texts in order, number of windows of each text)."""
    data, ends = stream(texts)
    if not len(ends):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one = data.astype(np.uint64)
    two = (one[:-1] << np.uint64(8)) | one[1:]  # at i: the bytes i and i + 1
    four = (two[:-2] << np.uint64(16)) | two[2:]
    three = (two[:-1] << np.uint64(8)) | one[2:]
    w = (three[:-4] << np.uint64(32)) | four[3:]  # at i: the bytes from i to i + MOST
    keep = np.ones(len(w), bool)
    for k in range(1, MOST + 1):
        keep[(ends + k - MOST)[ends + k < len(data)]] = False
    return w[keep], np.diff(ends, prepend=-1) - MOST


def context(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of each window's context."""
    return (keys >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)


def suffix(keys: np.ndarray, order: int) -> np.ndarray:
    """That context and the byte that follows."""
    return keys & np.uint64((1 << 8 * (order + 1)) - 1)


def among(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


class Deal:
    """Which windows meet: those that agree in the last bytes of their contexts, two bytes or, where
    such a context is heavy, one more, and so on; all orders from there on are counted where they meet."""

    def __init__(self, heavy: dict[int, np.ndarray] | None = None):
        """``heavy``: contexts by length, in order."""
        self.heavy = heavy or {}

    def depth(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), LOW + 1)
        for order in range(LOW + 1, MOST):
            if len(self.heavy.get(order, ())):
                out[(out == order) & among(self.heavy[order], context(keys, order))] += 1
        return out

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Hash of what windows that meet have in common."""
        depth = self.depth(keys).astype(np.uint64)
        mask = (np.uint64(1) << (np.uint64(8) * depth)) - np.uint64(1)
        return hashing.mix(((keys >> np.uint64(8)) & mask) | (depth << np.uint64(56)))


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal keys begins."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))[: len(sorted_keys)]


class Tally:
    """Distinct keys in order with their counts, added up stretch by stretch.

    Counts of ``add`` take 32 bits: a task that counts has fewer than 2**31 places.
    """

    def __init__(self, most: int = 1_000_000):
        self.most, self._parts, self._n = most, [], 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        """Count each of ``keys`` ``weight`` times (0: it is known, without a count)."""
        keys = np.sort(keys)
        first = firsts(keys)
        self.merge(keys[first], (weight * np.diff(np.append(first, len(keys)))).astype(np.int32))

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._parts.append((keys, counts))
        self._n += len(keys)

    def full(self) -> bool:
        if self._n > 2 * self.most:
            self._parts = [self.totals()]
            self._n = len(self._parts[0][0])
        return self._n > self.most and len(self._parts) == 1

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self._parts) == 1:
            return self._parts[0]
        keys = np.concatenate([k for k, _ in self._parts])
        counts = np.concatenate([c for _, c in self._parts])
        self._parts = []
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        del order
        first = firsts(keys)
        return keys[first], np.add.reduceat(counts, first, dtype=counts.dtype) if len(first) else counts


def packed(n: np.ndarray) -> bytes:
    """64-bit numbers, their bytes in planes, squeezed."""
    n = n if n.dtype.itemsize == 8 else n.astype(np.int64)
    planes = np.ascontiguousarray(n).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys in ascending order, by their steps."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, np.uint64), dtype=np.uint64)


def path_totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(9 x keys) for sorted distinct ``keys`` with their ``counts``, all keys of a context included.

    Row 8 counts the key, row k < 8 what left the key's path at bit k.
    """
    out = np.empty((9, len(keys)), np.int64)
    if not len(keys):
        return out
    inner = out[8] = counts
    for k in range(7, -1, -1):
        prefix = keys >> np.uint64(8 - k)
        first = firsts(prefix)
        whole = np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(keys))))
        out[k] = whole - inner
        inner = whole
    return out


def _sides(totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own, other) side of each of the eight bits by key, from ``path_totals``."""
    whole = np.cumsum(totals[::-1], axis=0)[::-1]  # whole[k]: entries that share the first k bits
    return whole[1:].astype(np.float32), totals[:8].astype(np.float32)


@dataclass
class Mixer:
    """Weights by gate and the refining table; both start neutral."""

    weights: np.ndarray = field(default_factory=lambda: np.full((INPUTS, GATES), 0.3))
    squares: np.ndarray = field(default_factory=lambda: np.full((INPUTS, GATES), 1e-4))
    seen: np.ndarray = field(default_factory=lambda: np.zeros((256, BUCKETS, 2)))
    bytes: int = 0


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -16, 16)))


def _bucket(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)


class Scorer:
    """A frozen mixer: gated weights and refining table."""

    def __init__(self, mixer: Mixer):
        self.weights = mixer.weights.astype(np.float32)
        prior = _squash((np.arange(BUCKETS) - BUCKETS // 2) / 2)
        refined = (mixer.seen[..., 1] + 8 * prior) / (mixer.seen.sum(axis=-1) + 8)
        self.refine = np.log(refined / (1 - refined)).astype(np.float32)

    def log_of(self, bit: np.ndarray, node: np.ndarray, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Log of the probability of each bit that came."""
        z = np.zeros(len(gate), np.float32)
        for i in range(INPUTS):
            z += self.weights[i][gate] * x[i]
        z = (z + self.refine[node, _bucket(z)]) / 2
        return -np.log1p(np.exp(-np.clip(np.where(bit == 1, z, -z), -16, 16)))


class Shared:
    """What every task knows of all training texts: counts of the orders up to ``LOW`` and of the heavy contexts."""

    def __init__(self, deal: Deal, rows: dict[int, tuple[np.ndarray, np.ndarray]]):
        """``rows``: (suffixes in order, their counts) by order, all bytes that follow a context included."""
        self.deal = deal
        self.tables = {order: (some, _sides(path_totals(some, counts))) for order, (some, counts) in rows.items()}


class Block:
    """Windows with all others that meet them by ``Deal``."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shared: Shared):
        self.keys, self.counts = keys, counts
        self.at, self.sides = [], []
        depth = shared.deal.depth(keys)
        for order in ORDERS:
            last, far = suffix(keys, order), depth > order
            near = ~far
            some, at_near = np.unique(last[near], return_inverse=True)
            own, other = _sides(path_totals(some, np.bincount(at_near, counts[near], len(some)).astype(np.int64)))
            at = np.empty(len(keys), np.int64)
            at[near] = at_near
            if far.any():
                known, sides = shared.tables[order]
                used, at_far = np.unique(np.searchsorted(known, last[far]), return_inverse=True)
                at[far] = len(some) + at_far
                own, other = (np.concatenate([x, y[:, used]], axis=1) for x, y in zip((own, other), sides))
            self.at.append(at)
            self.sides.append((own, other))

    def _inputs(self, part: np.ndarray, k: int, out: int) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """(bit, node, log odds of each order, gate) of bit ``k`` of the windows at ``part``."""
        byte = self.keys[part] & np.uint64(255)
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
        node = ((1 << k) | (byte >> np.uint64(8 - k)).astype(np.int64)) & 255
        x, gate = [], 0
        sign = (2 * bit - 1).astype(np.float32)
        for order, at, (own, other) in zip(ORDERS, self.at, self.sides):
            at = at[part]
            a, o = np.maximum(own[k][at] - np.float32(out), 0), other[k][at]
            x.append(sign * np.log((a + np.float32(PRIOR)) / (o + np.float32(PRIOR))))
            if order in GATE_ORDERS:
                level = np.minimum(LEVELS - 1, np.log2(a + o + 1)).astype(np.int64)
                gate = gate + level * (LEVELS if order == MOST else 1)
        return bit, node, x, gate

    def learn(self, mixer: Mixer) -> None:
        """Online pass over the windows that have a count, in an order made from their keys."""
        taken = np.flatnonzero(self.counts)
        taken = taken[np.argsort(hashing.mix(self.keys[taken]), kind="stable")]
        for start in range(0, len(taken), CHUNK):
            part = taken[start : start + CHUNK]
            weight = self.counts[part].astype(np.float64)
            mixer.bytes += int(self.counts[part].sum())
            for k in range(8):
                bit, node, x, gate = self._inputs(part, k, 1)
                z = sum(mixer.weights[i][gate] * x[i] for i in range(INPUTS))
                error = (bit - _squash(z)) * weight
                total = np.bincount(gate, weight, GATES) + 1e-9
                for i in range(INPUTS):
                    g = np.bincount(gate, error * x[i], GATES) / total
                    mixer.squares[i] += g * g
                    mixer.weights[i] += RATE * g / np.sqrt(mixer.squares[i])
                cell = (node * BUCKETS + _bucket(z)) * 2 + bit
                mixer.seen += np.bincount(cell, weight, mixer.seen.size).reshape(mixer.seen.shape)

    def log10_probabilities(self, scorer: Scorer) -> np.ndarray:
        """log10 of the probability of each window's last byte after the six before it."""
        out = np.zeros(len(self.keys))
        for start in range(0, len(out), 4 * CHUNK):
            part = np.arange(start, min(start + 4 * CHUNK, len(out)))
            for k in range(8):
                out[part] += scorer.log_of(*self._inputs(part, k, 0))
        return out / np.log(10)


def blocks(keys: np.ndarray, counts: np.ndarray, shared: Shared) -> Iterator[tuple[np.ndarray, Block]]:
    """(places, block) of a shard's windows, cut between those that do not meet at about ``BLOCK`` windows."""
    place = shared.deal.place(keys)
    order = np.argsort(place, kind="stable")
    place = place[order]
    edges = firsts(place)
    starts = edges[np.flatnonzero(np.diff(edges // BLOCK, prepend=-1))]
    for a, b in zip(starts, np.append(starts[1:], len(keys))):
        yield order[a:b], Block(keys[order[a:b]], counts[order[a:b]], shared)
