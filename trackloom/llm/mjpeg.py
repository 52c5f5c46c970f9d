"""Motion-JPEG in AVI: RIFF parsing by index, and baseline JPEG frames in numpy.

Frames are decoded side by side: one step reads the next block of every frame at once, so
the cost of a step is shared by all frames of a batch. A frame is baseline, 8 bit, one
scan, with or without restart intervals and Huffman tables of its own; of several components
the first (luma) is kept.

``write`` stores samples without loss: each sample is one 8x8 block of even brightness, so
only its DC coefficient is coded, and quantiser 8 makes that coefficient the sample.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

FPS = 25
#: Blocks in a stored frame: 16 across and 12 down.
ACROSS, DOWN = 16, 12
SAMPLES = ACROSS * DOWN

# The zigzag order of coefficients is generated, as the standard defines it.
ZIGZAG = np.array(
    sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)), np.int64
)


class BadMedia(ValueError):
    """Bytes that are not a readable AVI with baseline JPEG frames."""


# ---------------------------------------------------------------- Huffman tables


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For every 16-bit window: length * 256 + symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    for s, (code, length) in _codes(counts, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + s
    return table


DC_COUNTS, DC_SYMBOLS = [0, 0, 7, 1, 1] + [0] * 11, [1, 2, 3, 4, 5, 6, 7, 0, 8]
AC_COUNTS, AC_SYMBOLS = [1] + [0] * 15, [0]


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each difference -255..255 of a flat block, end of block included."""
    dc = _codes(DC_COUNTS, DC_SYMBOLS)
    code, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        head, length = dc[n]
        low = d if d >= 0 else d + (1 << n) - 1
        code[d + 255] = ((head << n) | low) << 1
        size[d + 255] = length + n + 1
    return code, size


_CODE, _SIZE = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([8] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, 8 * DOWN, 8 * ACROSS, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, bytes([0x00]) + bytes(DC_COUNTS) + bytes(DC_SYMBOLS))
    + _segment(0xC4, bytes([0x10]) + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)

# The tables of ITU-T T.81, annex K.3, which frames in an AVI may leave out. Lengths
# count the codes of 1 to 16 bits; the symbols of DC tables are 0 to 11 in order.
K3_DC_LUMA = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
K3_DC_CHROMA = [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
K3_AC_LUMA = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
K3_AC_CHROMA = [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]
# Symbols of fewer than 16 bits; those of 16 bits are all others, in order.
K3_AC_LUMA_SHORT = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")
K3_AC_CHROMA_SHORT = bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1")


def _all_symbols(short: bytes) -> list[int]:
    """The short codes' symbols, then every other pair of run (0-15) and size (1-10) in order."""
    every = [run << 4 | size for run in range(16) for size in range(1, 11)]
    return [*short, *[x for x in every if x not in short]]


@lru_cache(maxsize=1)
def default_tables() -> dict[int, np.ndarray]:
    return {
        0: _lookup(K3_DC_LUMA, list(range(12))),
        1: _lookup(K3_DC_CHROMA, list(range(12))),
        16: _lookup(K3_AC_LUMA, _all_symbols(K3_AC_LUMA_SHORT)),
        17: _lookup(K3_AC_CHROMA, _all_symbols(K3_AC_CHROMA_SHORT)),
    }


# ---------------------------------------------------------------- writing


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start..start+size-1 of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _scans(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of frames (n x samples) in a row, and the bytes of each."""
    n = len(frames)
    diff = np.diff(frames.astype(np.int64) - 128, axis=1, prepend=0) + 255
    code, size = _CODE[diff], _SIZE[diff]
    ends = np.cumsum(size, axis=1)
    n_bytes = (ends[:, -1] + 7) // 8
    base = np.concatenate([[0], np.cumsum(n_bytes)])
    at = (8 * base[:-1, None] + ends - size).ravel()
    value = (code.ravel() << (24 - (at & 7) - size.ravel())).astype(np.int64)
    first = at >> 3
    out = np.zeros(base[-1] + 2)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(first + k, (value >> shift) & 255, len(out))
    out = out[:-2].astype(np.uint8)
    out[base[1:] - 1] |= ((1 << (-ends[:, -1] % 8)) - 1).astype(np.uint8)  # ones fill the last byte
    stuffed = out == 0xFF
    where = np.arange(len(out)) + np.cumsum(stuffed) - stuffed
    total = np.zeros(len(out) + int(stuffed.sum()), np.uint8)
    total[where] = out
    return total, n_bytes + np.add.reduceat(stuffed.astype(np.int64), base[:-1])


def write(payloads: list[bytes]) -> list[bytes]:
    """An AVI of each payload; payloads are positive multiples of ``SAMPLES`` bytes."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SAMPLES)
    scans, sizes = _scans(samples)
    jpeg = len(HEAD) + sizes + 2
    chunk = 8 + jpeg + (jpeg & 1)
    at = np.concatenate([[0], np.cumsum(chunk)])
    movi = np.zeros(at[-1], np.uint8)
    lead = np.frombuffer(b"00dc\0\0\0\0" + HEAD, np.uint8)
    movi[at[:-1, None] + np.arange(len(lead))] = lead
    for k in range(4):
        movi[at[:-1] + 4 + k] = (jpeg >> (8 * k)) & 255
    movi[_ranges(at[:-1] + len(lead), sizes)] = scans
    movi[at[:-1] + 8 + jpeg - 2] = 0xFF
    movi[at[:-1] + 8 + jpeg - 1] = 0xD9
    first = np.concatenate([[0], np.cumsum([len(p) // SAMPLES for p in payloads])])
    index = np.zeros((len(samples), 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # key frame
    index[:, 3] = jpeg
    out = []
    for a, b in zip(first[:-1], first[1:]):
        index[a:b, 2] = at[a:b] - at[a] + 4
        out.append(_riff(movi[at[a] : at[b]].tobytes(), index[a:b].tobytes(), b - a))
    return out


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _riff(movi: bytes, index: bytes, n: int) -> bytes:
    w, h = 8 * ACROSS, 8 * DOWN
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, n, 0, -1, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", 3 * w * h, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body = b"AVI " + head + _list(b"movi", movi) + _chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(body)) + body


# ---------------------------------------------------------------- reading


@dataclass
class Avi:
    """What a file's headers and index say: frame rate and the (start, size) of key frames."""

    fps: float
    starts: np.ndarray
    sizes: np.ndarray


def _walk(data: bytes, at: int, end: int) -> list[tuple[int, int]]:
    """(start, size) of the video chunks of a movi list, in order, without its index."""
    found = []
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"LIST":
            found += _walk(data, at + 12, min(end, at + 8 + size))
        elif kind[2:] in (b"dc", b"db") and at + 8 + size <= end:
            found.append((at + 8, size))
        at += 8 + size + (size & 1)
    return found


def read_index(data: bytes) -> Avi:
    """Parse the RIFF structure; offsets are into ``data``.

    The first RIFF's frames come from its index, or from its movi list where it has none; further
    RIFFs of a large file (``AVIX``) are walked. Empty frames, which repeat the one before, go.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("not a RIFF AVI")
    fps, movi, entries = float(FPS), [], None
    first = min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    todo = [(12, first)]
    at = first + (first & 1)
    while at + 12 <= len(data) and data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] == b"AVIX":
        end = min(len(data), at + 8 + struct.unpack_from("<I", data, at + 4)[0])
        todo.insert(0, (at + 12, end))
        at = end + (end & 1)
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST":
                inner = data[at + 8 : at + 12]
                if inner == b"movi":
                    movi.append((at + 8, min(end, at + 8 + size)))
                elif inner in (b"hdrl", b"strl"):
                    todo.append((at + 12, min(end, at + 8 + size)))
            elif kind == b"strh" and data[at + 8 : at + 12] == b"vids" and size >= 32:
                scale, rate = struct.unpack_from("<II", data, at + 28)
                fps = rate / scale if scale and rate else fps
            elif kind == b"idx1" and at < first:
                entries = np.frombuffer(data, "<u4", min(size, len(data) - at - 8) // 16 * 4, at + 8).reshape(-1, 4)
            at += 8 + size + (size & 1)
    if not movi:
        raise BadMedia("no movi list")
    movi.sort()
    if entries is None or not len(entries):
        frames = np.array([f for a, b in movi for f in _walk(data, a + 4, b)], np.int64).reshape(-1, 2)
        starts, sizes = frames[:, 0], frames[:, 1]
    else:
        video = entries[(entries[:, 0] >> 16) == int.from_bytes(b"dc", "little")].astype(np.int64)
        starts, sizes = video[:, 2], video[:, 3]
        if len(starts) and data[starts[0] : starts[0] + 4][2:4] != b"dc":  # offsets from movi, not from the file
            starts = starts + movi[0][0]
        more = np.array([f for a, b in movi if a >= first for f in _walk(data, a + 4, b)], np.int64).reshape(-1, 2)
        starts, sizes = np.append(starts + 8, more[:, 0]), np.append(sizes, more[:, 1])
    if len(starts) and ((starts + sizes).max() > len(data) or starts.min() < 0):
        raise BadMedia("index points past the end")
    return Avi(fps, starts[sizes > 0], sizes[sizes > 0])


@dataclass
class Header:
    """Tables of a JPEG frame up to its scan."""

    size: int = 0
    height: int = 0
    width: int = 0
    restart: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table


def parse_header(jpeg: bytes) -> Header:
    h, at = Header(), 2
    if jpeg[:2] != b"\xff\xd8":
        raise BadMedia("no start of image")
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                h.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                h.tables[body[0]] = _lookup(list(body[1:17]), list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, h.height, h.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise BadMedia("samples are not 8 bit")
            h.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
            raise BadMedia("not a baseline frame")
        elif marker == 0xDD:
            h.restart = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            h.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            h.size = at + 2 + size
            h.tables = default_tables() | h.tables
            if not h.parts or any(t not in h.tables for _, d, a in h.scan for t in (d, 16 + a)):
                raise BadMedia("a table is missing")
            return h
        at += 2 + size
    raise BadMedia("no scan")


def _destuffed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and markers: (bytes, first byte and end of each scan)."""
    raw = data[_ranges(starts, sizes)]
    scan = np.repeat(np.arange(len(starts)), sizes)
    after = np.zeros(len(raw), bool)
    after[1:] = (raw[:-1] == 0xFF) & (raw[1:] == 0)
    ends = np.cumsum(np.bincount(scan[~after], minlength=len(starts)))
    return raw[~after], np.concatenate([[0], ends[:-1]]), ends


def _intervals(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the ``n`` restart intervals of every scan, frames x intervals."""
    out = np.empty((2, len(starts), n), np.int64)
    for f, (a, size) in enumerate(zip(starts, sizes)):
        scan = data[a : a + size]
        marks = np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] >= 0xD0) & (scan[1:] <= 0xD7))
        if len(marks) != n - 1:
            raise BadMedia("restart markers are missing")
        begin = np.concatenate([[0], marks + 2])
        out[0, f], out[1, f] = a + begin, np.append(marks, size) - begin
    return out[0], out[1]


def _extend(value, size):
    return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)


def _decode_units(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: Header, units: int, plan: list[int]) -> tuple[np.ndarray, dict]:
    """Blocks of the first component in ``units`` units of each scan: (DC by unit and block, all
    coefficients of the blocks that have some, by (unit, block)).

    ``plan`` names the component of each block of a unit. All scans move on together.
    """
    raw, first, ends = _destuffed(data, starts, sizes)
    n = len(starts)
    padded = np.concatenate([raw, np.full(8, 255, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(raw) + 1, np.uint64)
    for k in range(7):  # 56 bits from every byte on
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    words = words.astype(np.int64)
    bit, limit = first * 8, ends * 8
    last_word = len(words) - 1
    prediction = np.zeros((len(h.scan), n), np.int64)
    flat = np.zeros((n, units, plan.count(0)), np.int64)
    detail: dict[tuple[int, int], np.ndarray] = {}
    for unit in range(units):
        number = 0
        for k in plan:
            _, dc, ac = h.scan[k]
            window = words[np.minimum(bit >> 3, last_word)] << (bit & 7)  # 49 bits at least, from bit 55 on
            got = h.tables[dc][(window >> 40) & 0xFFFF]
            used, size = got >> 8, got & 255
            value = (window >> (56 - used - size)) & ((1 << size) - 1)
            used += size
            prediction[k] += _extend(value, size)
            got2 = h.tables[16 + ac][(window >> (40 - used)) & 0xFFFF]
            if not (got.all() and got2.all()):
                raise BadMedia("a code that no table has")
            bit = bit + used
            block = None
            if (got2 & 255).any():
                block = np.zeros((n, 64), np.int64)
                at, live = np.zeros(n, np.int64), np.arange(n)
                while len(live):
                    window = words[np.minimum(bit[live] >> 3, last_word)] << (bit[live] & 7)
                    got2 = h.tables[16 + ac][(window >> 40) & 0xFFFF]
                    if not got2.all():
                        raise BadMedia("a code that no table has")
                    used, symbol = got2 >> 8, got2 & 255
                    size, run = symbol & 15, symbol >> 4
                    value = _extend((window >> (56 - used - size)) & ((1 << size) - 1), size)
                    bit[live] += used + size
                    stop = (size == 0) & (run < 15)
                    at[live] += np.where(stop, 0, run + 1)
                    if (at[live] > 63).any():
                        raise BadMedia("too many coefficients")
                    some = size > 0
                    block[live[some], at[live[some]]] = value[some]
                    live = live[~stop & (at[live] < 63)]
            else:
                bit = bit + (got2 >> 8)
            if k == 0:
                flat[:, unit, number] = prediction[0]
                if block is not None:
                    detail[unit, number] = block
                number += 1
    if (bit > limit).any():
        raise BadMedia("a scan ends early")
    return flat, detail


def decode_luma(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: Header) -> np.ndarray:
    """First component of frames that share ``h``: (frame, block row, block column, 8, 8)
    pixels, or (frame, row, column, 1, 1) when all blocks of all frames are flat.

    ``starts`` and ``sizes`` are those of the scans. All frames move on together, block by
    block; restart intervals of a frame are scans of their own, side by side as well.
    """
    by_id = {p[0]: p for p in h.parts}
    most_x, most_y = max(p[1] for p in h.parts), max(p[2] for p in h.parts)
    lone = len(h.scan) == 1
    across, down = (-(-h.width // 8), -(-h.height // 8)) if lone else (-(-h.width // (8 * most_x)), -(-h.height // (8 * most_y)))
    plan = [k for k, (ident, _, _) in enumerate(h.scan) for _ in range(1 if lone else by_id[ident][1] * by_id[ident][2])]
    fx, fy = (1, 1) if lone else by_id[h.scan[0][0]][1:3]
    n, units = len(starts), across * down
    if not units or 0 not in plan or 2 * units * len(plan) > 8 * int(sizes.min()):  # a block takes two bits at least
        raise BadMedia("a scan is too short for its frame")
    step = min(h.restart or units, units)
    begin, length = _intervals(data, starts, sizes, -(-units // step)) if step < units else (starts[:, None], sizes[:, None])
    dc, detail = np.zeros((n, units, fx * fy), np.int64), {}
    for some, size in ((slice(0, units // step), step), (slice(units // step, None), units % step)):
        lanes = begin[:, some]
        if not size or not lanes.shape[1]:
            continue
        got, blocks = _decode_units(data, lanes.ravel(), length[:, some].ravel(), h, size, plan)
        unit = some.start * step
        dc[:, unit : unit + lanes.shape[1] * size] = got.reshape(n, -1, fx * fy)
        for (u, number), block in blocks.items():
            for j, one in enumerate(block.reshape(n, -1, 64).swapaxes(0, 1)):
                detail[unit + j * size + u, number] = one

    def grid(values: np.ndarray) -> np.ndarray:
        """(frame, unit, block, ...) to (frame, row, column, ...)."""
        tail = values.shape[3:]
        values = values.reshape(n, down, across, fy, fx, *tail)
        return values.swapaxes(2, 3).reshape(n, down * fy, across * fx, *tail)

    quant = h.quant[by_id[h.scan[0][0]][3]]
    if not detail:
        return np.clip(np.floor_divide(grid(dc) * quant[0] + 4, 8) + 128, 0, 255).astype(np.uint8)[..., None, None]
    coef = np.zeros((*dc.shape, 64), np.int64)
    for (unit, number), block in detail.items():
        coef[:, unit, number] = block
    coef[..., 0] = dc
    coef = grid(coef)
    square = np.zeros(coef.shape)
    square[..., ZIGZAG] = coef * quant
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    pixels = basis.T @ square.reshape(*coef.shape[:3], 8, 8) @ basis
    return np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8)


def read(files: list[bytes]) -> list[tuple[Avi, np.ndarray | None]]:
    """``_read``, where whatever damaged bytes lead to is ``BadMedia``."""
    try:
        return _read(files)
    except (struct.error, IndexError, KeyError, ValueError, OverflowError) as error:
        raise error if isinstance(error, BadMedia) else BadMedia(f"damaged: {error}") from error


def _read(files: list[bytes]) -> list[tuple[Avi, np.ndarray | None]]:
    """(index, luma blocks) of each file; frames with equal headers are decoded together.

    Luma is (frame, row, column, 8 or 1, 8 or 1); None where a file has no frames.
    """
    index = [read_index(f) for f in files]
    base = np.concatenate([[0], np.cumsum([len(f) for f in files])])
    data = np.frombuffer(b"".join(files), np.uint8)
    starts = np.concatenate([i.starts + b for i, b in zip(index, base)]) if files else np.zeros(0, np.int64)
    sizes = np.concatenate([i.sizes for i in index]) if files else starts
    owner = np.repeat(np.arange(len(files)), [len(i.starts) for i in index])
    left = np.arange(len(starts))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(left):
        a = starts[left[0]]
        h = parse_header(data[a : a + sizes[left[0]]].tobytes())
        head = data[a : a + h.size]
        same = np.flatnonzero(sizes[left] > h.size)
        same = same[(data[starts[left[same]][:, None] + np.arange(h.size)] == head).all(axis=1)]
        group = left[same]
        if not len(group):
            raise BadMedia("an empty frame")
        end = starts[group] + sizes[group]
        trail = np.where((data[end - 2] == 0xFF) & (data[end - 1] == 0xD9), 2, 0)
        done.append((group, decode_luma(data, starts[group] + h.size, sizes[group] - h.size - trail, h)))
        left = np.setdiff1d(left, group, assume_unique=True)
    out: list[tuple[Avi, np.ndarray | None]] = []
    if len(done) == 1:
        cuts = np.searchsorted(owner, np.arange(len(files) + 1))
        return [(i, done[0][1][a:b] if b > a else None) for i, a, b in zip(index, cuts, cuts[1:])]
    for k, i in enumerate(index):
        rows = [(f, luma[p]) for group, luma in done for p, f in enumerate(group) if owner[f] == k]
        rows.sort(key=lambda r: r[0])
        if len({r[1].shape for r in rows}) > 1:
            rows = [(f, np.broadcast_to(v, (*v.shape[:2], 8, 8))) for f, v in rows]
        out.append((i, np.stack([r[1] for r in rows]) if rows else None))
    return out
