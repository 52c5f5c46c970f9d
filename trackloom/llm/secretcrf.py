"""Secret scans: patterns, and a linear-chain conditional random field for what no pattern knows.

Tokens (runs of letters and digits, every other sign by itself) are tagged outside, begin or inside of
a secret. Features are the token's shape, neighbouring words, and the file's shares of signs and
digits and its line lengths. The field learns from the patterns' own finds as labels: windows around
them, windows at places chosen by hash, and windows around runs of digits, which are no secrets.
At most ``TRAIN_WINDOWS`` windows of a kind are taken, those of least hash over all texts, whatever
the partitions; equal windows count once. One task fits the weights to that sample; they go to
every task as one array of fixed size.

Decoding is Viterbi over whole texts. A token whose score for outside exceeds the others by more
than all transitions could make up for is outside on every best path, so texts are cut at such
tokens and only what lies between is decoded step by step; the path is the same.

The field's spans of at least ``LEAST`` bytes that touch no pattern's span are added under the
kind ``crf``; spans of patterns always stay.

Defined results: null and empty texts have no spans; nulls in ``doc_id`` pass through; repeated rows
are scanned each; where no pattern finds anything there is nothing to learn and nothing is
added; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import hashing
from trackloom.llm.common import release_memory, take, written
from trackloom.session import ship_package

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
#: Texts without any of this have no span of a pattern.
HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
NUMBERS = re.compile(rb"[0-9][0-9 .+/-]{6,}[0-9]")
KINDS = ("assign", "access", "hex", "crf")

BITS = 18
TRAIN_WINDOWS = 3_000
#: Bytes on each side of what a window is about.
WINDOW = 160
LEAST = 8
STRETCH = 1 << 20
ROUNDS = 16
BATCH = 250
RATE = 0.2
MOST_SHOWN = 8
L2 = 1e-4
FIELDS = 13
#: Rounds take in turn the fields of randomness alone, those of the token, and all: a secret must be known in a new form and place too.
TURNS = (3, 3, 6, FIELDS)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWERS = np.zeros(256, bool)
_LOWERS[97:123] = True
_WORD = _DIGIT | _UPPER | _LOWERS
_WORD[128:] = True
_SIGN = ~_WORD & ~hashing.SPACE
_HEX = _DIGIT.copy()
_HEX[97:103] = True
_VOWEL = np.zeros(256, bool)
_VOWEL[[97, 101, 105, 111, 117, 121, 65, 69, 73, 79, 85, 89]] = True


# ---------------------------------------------------------------- patterns


def pattern_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(kind's number, start, end, start of the secret itself) of each pattern's finds, in bytes."""
    out = [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]


# ---------------------------------------------------------------- tokens and features


def file_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One small number per text from its shares of signs and digits and the length of its lines."""

    def sums(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    size = np.maximum(np.diff(offsets), 1)
    signs, digits = (np.minimum(20 * sums(m[raw]) // size, 5) for m in (_SIGN, _DIGIT))
    line = np.log2(size / (sums(raw == 10) + 1) + 1).astype(np.int64) // 2
    return ((signs * 6 + digits) * 8 + np.minimum(line, 7)).astype(np.int64)


@dataclass
class Tokens:
    """Tokens of texts laid end to end: places in bytes, and slots of their features."""

    start: np.ndarray
    size: np.ndarray
    at: np.ndarray  # first token of each text, and the number of all
    slots: np.ndarray  # FIELDS x tokens


def tokens(raw: np.ndarray, offsets: np.ndarray, file: np.ndarray) -> Tokens:
    word, sign = _WORD[raw], _SIGN[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    first[edge] |= word[edge]
    start = np.flatnonzero(first | sign)
    at = np.searchsorted(start, offsets)
    n = len(start)
    if not n:
        return Tokens(start, start, at, np.zeros((FIELDS, 0), np.int64))

    def sums(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, start, dtype=np.int32)

    size = sums(word | sign)
    low = hashing._LOWER[raw]
    powers, inverses = hashing._power_tables(len(raw))
    name = np.where(word | sign, hashing._BYTE[low], np.uint64(0)) * powers[: len(raw)]
    name = hashing.mix(np.add.reduceat(name, start) * inverses[start] + size.astype(np.uint64) * hashing.MULT)
    digit = _DIGIT[raw]
    digits, uppers, lowers = sums(digit), sums(_UPPER[raw]), sums(_LOWERS[raw])
    turns = digit.copy()
    turns[1:] ^= digit[:-1]
    turns &= word & ~first
    length = np.minimum(np.log2(size) * 2, 15).astype(np.int64)
    kind = (digits > 0) + 2 * (lowers > 0) + 4 * (uppers > 0) + 8 * (uppers > 1) + 16 * (sums(_HEX[raw]) == size) + 32 * (digits == size)
    shape = kind * 16 + length
    shape = np.where(sign[start], 4096 + raw[start].astype(np.int64), shape)
    changes, vowels = np.minimum(sums(turns), 7), np.minimum(8 * sums(_VOWEL[raw]) // size, 7)
    coarse = np.minimum(np.maximum(length - 4, 0) // 2, 3)  # below 8, below 16, below 32, longer
    apart = np.ones(n, np.int64)  # what is between a token and the one before
    apart[1:] = start[1:] > start[:-1] + size[:-1]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))

    def near(step: int, values: np.ndarray) -> np.ndarray:
        """The value ``step`` tokens on, in the same text, or 0."""
        out = np.zeros(n, values.dtype)
        if step > 0:
            same = doc[step:] == doc[:-step]
            out[:-step][same] = values[step:][same]
        else:
            same = doc[-step:] == doc[:step]
            out[-step:][same] = values[:step][same]
        return out

    # the last word before, over signs
    is_word = ~sign[start]
    seen = np.maximum.accumulate(np.where(is_word, np.arange(n), -1))
    seen = np.concatenate([[-1], seen[:-1]])
    known = (seen >= 0) & (seen >= at[doc])
    before = np.where(known, name[seen], np.uint64(0))
    own = np.zeros(n, np.int64), changes * 2 + (coarse > 0), ((vowels < 3) * 3 + (digits > 0) + (digits == size)) * 2 + (coarse > 0), shape, changes * 4 + coarse, kind * 4 + coarse
    one = np.uint64(1)
    long = coarse.astype(np.uint64) + one
    values = [
        *(x.astype(np.uint64) for x in (*own, (length * 2 + apart) * 2 + (changes > 1), file[doc] * 4 + coarse)),
        near(-1, name), near(-1, name) * long, near(1, shape).astype(np.uint64) * long, before * long, near(-2, name) ^ (near(-1, name) * np.uint64(3)),
    ]
    shift = np.uint64(64 - BITS)
    slots = np.empty((FIELDS, n), np.int64)
    for k, v in enumerate(values):  # multiplicative hashing, with another odd number for each field
        np.right_shift((v + one) * hashing.mix(np.uint64([k + 1]) | one)[0] * hashing.MULT, shift, out=slots[k].view(np.uint64))
    return Tokens(start, size, at, slots)


# ---------------------------------------------------------------- the field

O, B, I = 0, 1, 2


@dataclass
class Field:
    """Scores of begin and inside against outside by slot, of steps between tags, and of the first tag."""

    weights: np.ndarray  # slots x 2
    steps: np.ndarray  # 3 x 3
    first: np.ndarray  # 3

    @classmethod
    def blank(cls) -> "Field":
        return cls(np.zeros((1 << BITS, 2), np.float32), np.zeros((3, 3)), np.zeros(3))

    def scores(self, slots: np.ndarray) -> np.ndarray:
        """(tokens x 3) scores of each tag."""
        total = np.zeros((slots.shape[1], 2), np.float32)
        for row in slots:
            total += self.weights.take(row, axis=0)
        return np.concatenate([np.zeros((len(total), 1)), total], axis=1)


def gradients(field: Field, scores: np.ndarray, length: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the sequences' log loss by scores, steps and first tags (forward and backward sums in logarithms).

    ``scores`` is sequences x places x 3, ``length`` the places of each that count.
    """

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    n, most, _ = scores.shape
    inside = np.arange(most) < length[:, None]
    ahead = np.zeros_like(scores)
    ahead[:, 0] = field.first + scores[:, 0]
    for t in range(1, most):
        step = logsum(ahead[:, t - 1, :, None] + field.steps, 1) + scores[:, t]
        ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
    total = logsum(ahead[:, -1], 1)
    behind = np.zeros_like(scores)
    for t in range(most - 2, -1, -1):
        step = logsum(field.steps + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(inside[:, t + 1, None], step, 0)
    share = np.exp(ahead + behind - total[:, None, None]) * inside[..., None]
    own = np.zeros_like(share)
    np.put_along_axis(own, tags[..., None], 1, 2)
    by_score = share - own * inside[..., None]
    both = inside[:, 1:]
    pair = ahead[:, :-1, :, None] + field.steps + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
    by_step = (np.exp(np.where(both[..., None, None], pair, -np.inf))).sum(axis=(0, 1))
    by_step -= np.bincount((tags[:, :-1] * 3 + tags[:, 1:])[both], minlength=9).reshape(3, 3)
    by_first = (share[:, 0] - own[:, 0]).sum(axis=0)
    return by_score, by_step, by_first


def learned(windows: list[Tokens], tags: list[np.ndarray], rounds: int = ROUNDS) -> Field:
    """A field fitted by gradient steps with a rate of its own for each weight, ``BATCH`` windows at a time."""
    field = Field.blank()
    rich = [bool((t > 0).any()) for t in tags]
    if not any(rich):
        return field
    # windows with secrets are shown more often where they are few
    times = min(MOST_SHOWN, max(1, len(tags) // sum(rich)))
    shown = [(j, k) for k, t in enumerate(tags) if len(t) for j in range(times if rich[k] else 1)]
    some = [k for _, k in sorted(shown, key=lambda s: ((s[1] + s[0] * len(tags) // times) % len(tags), s))]
    squares = [np.full(x.shape, 1e-2) for x in (field.weights, field.steps, field.first)]
    for turn in range(rounds):
        fields = slice(TURNS[turn % len(TURNS)])
        for at in range(0, len(some), BATCH):
            part = some[at : at + BATCH]
            length = np.array([len(tags[k]) for k in part])
            inside = np.arange(length.max()) < length[:, None]
            slots = np.concatenate([windows[k].slots[fields] for k in part], axis=1)
            scores, tag = np.zeros((*inside.shape, 3)), np.zeros(inside.shape, np.int64)
            scores[inside] = field.scores(slots)
            tag[inside] = np.concatenate([tags[k] for k in part])
            by_score, by_step, by_first = gradients(field, scores, length, tag)
            flat, touched = slots.ravel(), np.unique(slots)
            values = np.tile(by_score[inside][:, 1:], (len(slots), 1))
            place = np.searchsorted(touched, flat)
            g = np.stack([np.bincount(place, values[:, c], len(touched)) for c in (0, 1)], axis=1) / len(part) + L2 * field.weights[touched]
            squares[0][touched] += g * g
            field.weights[touched] -= RATE * g / np.sqrt(squares[0][touched])
            for value, square, g in ((field.steps, squares[1], by_step), (field.first, squares[2], by_first)):
                g = g / len(part)
                square += g * g
                value -= RATE * g / np.sqrt(square)
    return field


def best_tags(field: Field, scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Viterbi tags of texts' tokens; ``at`` says where texts begin. Of equal paths one that has the lower tags last."""
    n = len(scores)
    out = np.zeros(n, np.int64)
    # what a tag other than outside can gain from the steps to it and from it
    into = np.max(np.concatenate([field.steps[:, 1:] - field.steps[:, :1], (field.first[1:] - field.first[:1])[None]]))
    out_of = max(0.0, np.max(field.steps[1:] - field.steps[:1]))
    open_ = np.flatnonzero(scores[:, 1:].max(axis=1, initial=-np.inf) + max(into, 0.0) + out_of + 1e-9 >= 0)
    if not len(open_):
        return out
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    cut = np.flatnonzero((np.diff(open_, prepend=-2) > 1) | begins[open_])
    runs = list(zip(open_[cut], np.append(open_[cut[1:] - 1], open_[-1]) + 1))
    runs.sort(key=lambda r: r[0] - r[1])
    a, b = np.array(runs).T
    size = b - a
    now = np.where(begins[a][:, None], field.first, field.steps[O]) + scores[a]
    back = []
    for t in range(1, size[0]):
        live = int(np.searchsorted(-size, -t, side="left"))  # runs longer than t
        way = now[:live, :, None] + field.steps
        back.append(way.argmax(axis=1))
        now[:live] = way.max(axis=1) + scores[a[:live] + t]
    closed = now + np.where(begins[b][:, None], 0.0, field.steps[:, O])
    tag = closed.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        out[a[:live] + t] = tag[:live]
        if t:
            tag[:live] = back[t - 1][np.arange(live), tag[:live]]
    return out


# ---------------------------------------------------------------- the sample

SAMPLE = "kind int, key long, window binary, file long, spans array<long>"


def _windows(text: bytes, spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(kind, start, end, secrets' starts and ends) of what a text offers to the sample: 1 secrets, 2 any place, 3 numbers."""

    def around(a: int, b: int) -> tuple[int, int]:
        a, b = max(0, a - WINDOW), min(len(text), b + WINDOW)
        while a and not hashing.SPACE[text[a - 1]] and a > 0 and not _SIGN[text[a - 1]]:
            a -= 1
            if b - a > 8 * WINDOW:
                break
        return a, b

    secrets = sorted((s, e) for _, _, e, s in spans)
    for s, e in secrets:
        if e - s <= 2 * WINDOW:
            yield 1, *around(s, e), secrets
    if text:
        place = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") % len(text)
        yield 2, *around(place, place), secrets
        m = NUMBERS.search(text, place) or NUMBERS.search(text)
        if m and m.end() - m.start() <= 2 * WINDOW:
            yield 3, *around(*m.span()), secrets


def candidates(df: DataFrame, most: int) -> DataFrame:
    """Of each task and kind the ``most`` windows of least hash, each once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: [], 3: []}
        known: dict[int, set[int]] = {1: set(), 2: set(), 3: set()}
        for batch in batches:
            for x, y in hashing.slices(batch.column(0), STRETCH):
                part = batch.column(0).slice(x, y - x)
                hint = pc.fill_null(pc.match_substring_regex(part, HINT), False).to_pylist()
                raw, offsets = hashing.text_bytes(part)
                file = file_features(raw, offsets)
                data = raw.tobytes()
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    text = data[a:b]
                    for kind, s, e, secrets in _windows(text, pattern_spans(text) if hint[k] else []):
                        window = text[s:e]
                        key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little") >> 1
                        heap = held[kind]
                        if key in known[kind] or (len(heap) == most and key > -heap[0][0]):
                            continue
                        inner = [v - s for p, q in secrets if p < e and q > s for v in (max(p, s), min(q, e))]
                        known[kind].add(key)
                        row = (-key, window, int(file[k]), inner)
                        known[kind].discard(-heapq.heappushpop(heap, row)[0]) if len(heap) == most else heapq.heappush(heap, row)
        rows = [(kind, -r[0], *r[1:]) for kind, heap in held.items() for r in heap]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["kind", "key", "window", "file", "spans"])
        release_memory()

    return df.select("_text").mapInArrow(find, SAMPLE)


def training_sample(df: DataFrame, most: int = TRAIN_WINDOWS) -> DataFrame:
    """At most ``most`` windows of each kind, of least hash over all texts."""
    rows = written(candidates(df, most), "secret-windows")
    level = F.floor(F.log2(F.col("key") + 1.0) * 64).cast("int")
    # equal windows of several tasks count once; a few thousand levels of counts
    counts = rows.select("kind", "key").distinct().groupBy("kind", level.alias("level")).count().orderBy("kind", "level").collect()
    bound: dict[int, int] = {}
    room = {k: most for k in (1, 2, 3)}
    for r in counts:
        room[r["kind"]] -= r["count"]
        if room[r["kind"]] >= 0:
            bound[r["kind"]] = r["level"]
    keep = F.lit(False)
    for kind, top in bound.items():
        keep = keep | ((F.col("kind") == kind) & (level <= top))
    return rows.filter(keep)


def _tags(t: Tokens, spans: list[int]) -> np.ndarray:
    out = np.zeros(len(t.start), np.int64)
    for s, e in zip(spans[::2], spans[1::2]):
        inside = np.flatnonzero((t.start < e) & (t.start + t.size > s))
        out[inside] = I
        out[inside[:1]] = B
    return out


def fit(df: DataFrame, most: int = TRAIN_WINDOWS, rounds: int = ROUNDS) -> Field:
    """The field learned in one task from the sample of ``_text``; one row per weight other than 0 comes to the driver."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows[row[:2]] = row
        windows, tags = [], []
        for row in sorted(rows.values(), key=lambda r: (r[1], r[0])):
            raw = np.frombuffer(row[2], np.uint8)
            t = tokens(raw, np.array([0, len(raw)]), np.array([row[3]]))
            windows.append(t)
            tags.append(_tags(t, row[4]))
        field = learned(windows, tags, rounds)
        flat = np.concatenate([field.weights.ravel(), field.steps.ravel(), field.first])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at].astype(np.float64))], ["cell", "value"])
        release_memory()

    got = training_sample(df, most).repartition(1).mapInArrow(train, "cell long, value double").toPandas()
    field = Field.blank()
    flat = np.zeros(field.weights.size + 12)
    flat[got["cell"].to_numpy()] = got["value"].to_numpy()
    cut = field.weights.size
    return Field(flat[:cut].reshape(field.weights.shape).astype(np.float32), flat[cut : cut + 9].reshape(3, 3), flat[cut + 9 :])


# ---------------------------------------------------------------- scanning


def found(texts: pa.Array, field: Field) -> list[list[tuple[int, int, int]]]:
    """Per text (kind's number, start, end) of all spans, in bytes, by start and kind."""
    raw, offsets = hashing.text_bytes(texts)
    hint = pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_numpy(zero_copy_only=False)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for k in np.flatnonzero(hint).tolist():
        out[k] = [s[:3] for s in pattern_spans(raw[offsets[k] : offsets[k + 1]].tobytes())]
    if field.weights.any():
        t = tokens(raw, offsets, file_features(raw, offsets))
        tag = best_tags(field, field.scores(t.slots), t.at)
        doc = np.repeat(np.arange(len(texts)), np.diff(t.at))
        inside = np.flatnonzero(tag)
    if field.weights.any() and len(inside):
        fresh = (tag[inside] == B) | (np.diff(inside, prepend=-2) > 1) | (np.diff(doc[inside], prepend=-1) > 0)
        cut = np.flatnonzero(fresh)
        last = np.append(cut[1:], len(inside)) - 1
        spans = zip(doc[inside[cut]].tolist(), t.start[inside[cut]].tolist(), (t.start + t.size)[inside[last]].tolist())
        for k, s, e in spans:
            s, e = s - offsets[k], e - offsets[k]
            if e - s >= LEAST and not any(s < q and e > p for kind, p, q in out[k] if kind < 3):
                out[k].append((3, int(s), int(e)))
    return [sorted(spans, key=lambda s: (s[1], s[0])) for spans in out]


def scanned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = TRAIN_WINDOWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``spans``, an array of (kind, start, end) in code points, by start and kind."""
    ship_package(docs.sparkSession)
    df = take(docs, _id=doc_id, _text=text).withColumn("_text", F.col("_text").cast("string"))
    model = docs.sparkSession.sparkContext.broadcast(fit(df, most))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in hashing.slices(batch.column(1), STRETCH):
                part = batch.column(1).slice(x, y - x)
                spans = found(part, model.value)
                rows = []
                for k, some in enumerate(spans):
                    if some:
                        raw = np.frombuffer(part[k].as_py().encode(), np.uint8)
                        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        some = [{"kind": KINDS[kind], "start": int(points[s]), "end": int(points[e])} for kind, s, e in some]
                    rows.append(some)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(rows, kind)], ["doc_id", "spans"])
        release_memory()

    kind = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(docs: DataFrame, most: int = TRAIN_WINDOWS) -> DataFrame:
    """The contract's columns of query op11."""

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned(docs, most=most).select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
