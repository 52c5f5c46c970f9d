"""Packing token ids into windows by minimum bin slack.

Documents longer than a window fill whole windows by themselves; what remains of each
is a piece shorter than a window. A group of pieces is packed as a multiset of lengths:
a bitset subset-sum pass picks the multiset that fills a window closest to its capacity,
and the chosen counts are read back from the bitsets passed on the way. A pattern is
used as often as its counts allow. Where no multiset fills a window, the longest piece
left is cut to fill it. Only the last window of a task can stay short: it is cut into
windows at powers of two, which need no padding.

Groups are bounded stretches of a scan partition, so packing needs no shuffle and a
worker holds the ids of one group. Work repeats exactly when a task is run again on the
same partition. Window ids are unique: partition number times 2**36 plus a count.

Defined results: a null or empty text is the end id alone; repeated rows are packed one
by one; null ids pass through; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trackloom.llm.common import take
from trackloom.llm.tokens import WordTokenizer, default_path
from trackloom.session import ship_package

WINDOW = 4096
END_ID = 2
#: Ids in the pieces of one group; more make fuller windows and need more memory.
GROUP_TOKENS = 2_000_000


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts``) whose sum is largest within ``capacity``.

    Bit ``s`` of a bitset says that sum ``s`` can be made. Counts are split into powers
    of two, so each length costs a logarithm of its count; the pass ends early once the
    capacity itself can be made. Longer lengths come first.
    """
    mask = (1 << (capacity + 1)) - 1
    made = 1
    steps: list[tuple[int, int, int]] = []  # length, copies, sums that could be made before
    full = 1 << capacity
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left and not made & full:
            take_ = min(part, left)
            steps.append((length, take_, made))
            made |= (made << (length * take_)) & mask
            left -= take_
            part *= 2
        if made & full:
            break
    total = made.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += copies
            total -= length * copies
    return dict(chosen)


def patterns(counts: dict[int, int], capacity: int = WINDOW) -> Iterator[tuple[list[int], int]]:
    """Fill windows from the multiset ``counts`` (changed in place).

    Yields (lengths in a window, slack); a positive slack is to be filled by cutting the
    longest length left, which the caller does and puts the rest back into ``counts``.
    """
    while counts:
        chosen = closest_fill(counts, capacity)
        size = sum(k * n for k, n in chosen.items())
        times = min(counts[k] // n for k, n in chosen.items()) if size == capacity else 1
        lengths = [k for k, n in chosen.items() for _ in range(n)]
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        for _ in range(times):
            yield lengths, capacity - size


class Packer:
    """Turns documents' ids into placed pieces; ``rows`` collects what is placed."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.next, self.rows = window, first_sequence, []
        self.waiting: dict[int, list[tuple]] = defaultdict(list)  # length -> pieces
        self.tokens = 0

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        for start in range(0, n - n % self.window, self.window):
            self._place([(doc, n, start, ids[4 * start : 4 * (start + self.window)])])
        if rest := n % self.window:
            self.waiting[rest].append((doc, n, n - rest, ids[4 * (n - rest) :]))
            self.tokens += rest

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, n, start, ids in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, n, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def _cut(self, length: int, size: int, counts: dict[int, int]) -> tuple:
        """The first ``size`` ids of a piece of ``length``; the rest waits again."""
        doc, n, start, ids = self.waiting[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        rest = length - size
        self.waiting[rest].append((doc, n, start + size, ids[4 * size :]))
        counts[rest] = counts.get(rest, 0) + 1
        return doc, n, start, ids[: 4 * size]

    def pack(self, last: bool = False) -> None:
        """Place the waiting pieces; unless ``last``, a short window goes on waiting."""
        counts = {k: len(v) for k, v in self.waiting.items() if v}
        for lengths, slack in patterns(counts, self.window):
            pieces = [self.waiting[k].pop() for k in lengths]
            if slack and counts:
                pieces.append(self._cut(max(counts), slack, counts))
                slack = 0
            if not slack:
                self._place(pieces)
            elif last:
                self._place_short(pieces)
            else:
                for p in pieces:
                    self.waiting[len(p[3]) // 4].append(p)
        self.waiting = defaultdict(list, {k: v for k, v in self.waiting.items() if v})
        self.tokens = sum(k * len(v) for k, v in self.waiting.items())

    def _place_short(self, pieces: list[tuple]) -> None:
        """Windows at powers of two that hold the last pieces, cut where windows end."""
        total = sum(len(p[3]) // 4 for p in pieces)
        todo = pieces[::-1]
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            window = []
            while room:
                doc, n, start, ids = todo.pop()
                size = min(room, len(ids) // 4)
                window.append((doc, n, start, ids[: 4 * size]))
                if size < len(ids) // 4:
                    todo.append((doc, n, start + size, ids[4 * size :]))
                room -= size
            self._place(window)


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces: ``doc_id, start, length, ids`` (32-bit little-endian), ``doc_tokens, sequence_id, offset``."""
    return _run(docs, path or default_path(), window, end_id, text, doc_id, crc=False)


def _run(docs: DataFrame, path: str, window: int, end_id: int, text: str, doc_id: str, crc: bool) -> DataFrame:
    df = take(docs, _id=doc_id, _text=text)
    df = df.select("_id", df["_text"].cast("string").alias("_text"))
    ship_package(docs.sparkSession)
    kind = df.schema["_id"].dataType
    end = end_id.to_bytes(4, "little")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = WordTokenizer.load(path)
        packer = Packer(TaskContext.get().partitionId() << 36, window)

        def flush() -> Iterator[pa.RecordBatch]:
            rows, packer.rows = packer.rows, []
            for at in range(0, len(rows), 4096):
                cols = list(zip(*rows[at : at + 4096]))
                data = pa.array([zlib.crc32(b) for b in cols[3]], pa.int64()) if crc else pa.array(cols[3], pa.binary())
                arrays = [pa.array(cols[0], id_type[0])] + [pa.array(c, pa.int64()) for c in cols[1:3]]
                arrays += [data] + [pa.array(c, pa.int64()) for c in cols[4:]]
                yield pa.RecordBatch.from_arrays(arrays, names)

        names = ["doc_id", "start", "length", "ids_crc32" if crc else "ids", "doc_tokens", "sequence_id", "offset"]
        id_type: list[pa.DataType] = []
        for batch in batches:
            id_type[:] = [batch.schema.field(0).type]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer.ids(part.column(1).to_pylist())):
                    packer.add(doc, ids + end)
                    if packer.tokens >= GROUP_TOKENS:
                        packer.pack()
                yield from flush()
        packer.pack(last=True)
        yield from flush()

    data = "ids_crc32 long" if crc else "ids binary"
    schema = f"doc_id {kind.simpleString()}, start long, length long, {data}, doc_tokens long, sequence_id long, offset long"
    return df.mapInArrow(place, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns of query op5; checksums are taken where the pieces are made."""
    return _run(docs, path or default_path(), WINDOW, END_ID, "text", "doc_id", crc=True)
