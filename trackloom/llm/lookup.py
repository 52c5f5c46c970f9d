"""A hash table of fixed size over 64-bit keys, made and asked with numpy, and what fills it from Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import hashing
from trackloom.llm.common import release_memory


class Lookup:
    """Whole numbers by 64-bit key: every key is placed, one slot further on until one is free.

    Of ``counts`` only what is above zero is told. At most half of the slots are taken.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        kind = np.int32 if np.abs(values).max(initial=0) < 1 << 29 else np.int64
        self.free = kind(1 << 30) if kind is np.int32 else kind(1 << 62)
        self.values = np.full(1 << self.bits, self.free)  # the lowest bit: whether the key has a count
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            open_ = np.flatnonzero(self.values[slot] == self.free)
            at, first = np.unique(slot[open_], return_index=True)
            won = left[open_[first]]
            self.keys[at], self.values[at] = keys[won], 2 * values[won] + (counts[won] > 0)
            stay = np.ones(len(left), bool)
            stay[open_[first]] = False
            left, slot = left[stay], self._next(slot[stay])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * hashing.MULT >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, counted, value) of each key; 0 where it is not found."""
        slot = self._slots(keys)
        value = self.values[slot]
        left = np.flatnonzero((self.keys[slot] != keys) & (value != self.free))
        slot = slot[left]
        while len(left):
            slot = self._next(slot)
            value[left] = self.values[slot]
            on = (self.keys[slot] != keys[left]) & (value[left] != self.free)
            left, slot = left[on], slot[on]
        found = value != self.free
        value[~found] = 0
        return found, (value & 1).astype(bool), (value >> 1).astype(np.int64)


def frequent(rows: DataFrame, most: int, flag: str | None = None) -> Lookup:
    """The most counted of ``rows`` (``key, count, value``), at most ``most``, taken by levels of their counts.

    What the table tells beside the value: whether ``flag`` is above zero, or else the count.
    """
    level = F.floor(F.log2(F.col("count") + 1) * 8).cast("int")
    left, least = most, 1 << 30
    for r in rows.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred rows
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    got = rows.filter(level >= least).select("key", (F.col(flag or "count") > 0).cast("byte").alias("count"), "value").toArrow()
    arrays = [got[c].to_numpy() for c in ("key", "count", "value")]
    del got
    out = Lookup(arrays[0].view(np.uint64), *arrays[1:])
    del arrays
    release_memory()
    return out
