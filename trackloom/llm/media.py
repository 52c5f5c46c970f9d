"""Media columns: AVI motion-JPEG to timed clip rows.

Frames are found by the RIFF index, decoded (``mjpeg``), and cut into shots where the
difference between the brightness histograms of neighbours stands out from the
differences around it: above their mean by several standard deviations and above a floor,
and not below either neighbour. Each stretch between cuts is a clip.

A map over rows: no shuffle; a worker holds a few megabytes of media at a time.

Defined results: null, empty or unreadable media have no clips (``clips``) and a file with
no frames has none either; repeated rows give repeated clips; extra columns are ignored.
In the query a null text is the empty text, stored as 192 spaces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import hashing, mjpeg
from trackloom.llm.common import take
from trackloom.session import ship_package

BINS = 16
#: Frames on either side whose differences set the threshold.
AROUND = 8
DEVIATIONS = 3.0
FLOOR = 0.2


def histograms(luma: np.ndarray) -> np.ndarray:
    """Share of each brightness bin per frame."""
    flat = luma.reshape(len(luma), -1).astype(np.int64) * BINS >> 8
    flat += np.arange(len(luma))[:, None] * BINS
    return np.bincount(flat.ravel(), minlength=len(luma) * BINS).reshape(-1, BINS) / flat.shape[1]


def shot_starts(hist: np.ndarray, file: np.ndarray) -> np.ndarray:
    """Frames that begin a shot; ``file`` is the (ascending) file number of each frame."""
    n = len(hist)
    begins = np.concatenate([[True], file[1:] != file[:-1]])
    d = np.zeros(n)
    d[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    d[begins] = 0
    start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    stop = np.append(np.flatnonzero(begins)[1:], n)[np.cumsum(begins) - 1]
    low = np.maximum(np.arange(n) - AROUND, start + 1)
    high = np.minimum(np.arange(n) + AROUND + 1, stop)
    total = np.concatenate([[0], np.cumsum(d)])
    square = np.concatenate([[0], np.cumsum(d * d)])
    others = np.maximum(high - low - 1, 1)
    mean = (total[high] - total[np.minimum(low, high)] - d) / others
    var = np.maximum((square[high] - square[np.minimum(low, high)] - d * d) / others - mean * mean, 0)
    peak = (d >= np.append(d[1:], 0)) & (d >= np.concatenate([[0], d[:-1]]))
    # rounded, so that the sums of a batch do not show in the result
    cut = (np.round(d - mean - DEVIATIONS * np.sqrt(var), 6) > 0) & (d > FLOOR) & peak
    return begins | cut


def clips(media: DataFrame, content: str = "content", media_id: str = "media_id") -> DataFrame:
    """Clip rows: ``media_id, clip, first_frame, n_frames, start_s, end_s``."""
    ship_package(media.sparkSession)
    df = take(media, _id=media_id, _content=content)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    ((avi, luma),) = mjpeg.read([data or b""])
                except mjpeg.BadMedia:
                    continue
                if luma is None:
                    continue
                first = np.flatnonzero(shot_starts(histograms(luma), np.zeros(len(luma), np.int64)))
                ends = np.append(first[1:], len(luma))
                rows += [(ident, k, int(a), int(b - a), a / avi.fps, b / avi.fps) for k, (a, b) in enumerate(zip(first, ends))]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            names = ["media_id", "clip", "first_frame", "n_frames", "start_s", "end_s"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    kind = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(cut, f"media_id {kind}, clip int, first_frame long, n_frames long, start_s double, end_s double")


def payload_of(text: bytes) -> bytes:
    """The bytes and spaces up to a positive multiple of a frame's samples."""
    return text.ljust(max(1, -(-len(text) // mjpeg.SAMPLES)) * mjpeg.SAMPLES, b" ")


def as_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``media_id`` and ``content``: each whole text stored as an AVI."""
    ship_package(docs.sparkSession)
    df = take(docs, _id=doc_id, _text=text).withColumn("_text", F.encode(F.coalesce(F.col("_text").cast("string"), F.lit("")), "UTF-8"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in hashing.slices(batch.column(1)):
                files = mjpeg.write([payload_of(t) for t in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(files, pa.binary())], ["media_id", "content"])

    return df.mapInArrow(store, f"media_id {df.schema['_id'].dataType.simpleString()}, content binary")


DIGEST = "doc_id {}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of query op4: store, read back, cut into shots.

    Both steps run in one map, so the stored bytes need not pass between processes.
    ``feature`` names the frame rate, the frames and the first frame of every clip.
    """
    ship_package(docs.sparkSession)
    df = take(docs, _id="doc_id", _text="text").withColumn("_text", F.encode(F.coalesce(F.col("_text").cast("string"), F.lit("")), "UTF-8"))
    names = [f.split()[0] for f in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in hashing.slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                files = mjpeg.write([payload_of(t) for t in texts])
                rows = [(len(t), *r) for t, r in zip(texts, _measured(files))]
                cols = [batch.column(0).slice(a, b - a), *[pa.array(c) for c in zip(*rows)]]
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, DIGEST.format(df.schema["_id"].dataType.simpleString()))


def _measured(files: list[bytes]) -> list[tuple]:
    """(payload bytes, its sha256, tail's crc32, media bytes, their sha256, feature) of stored texts."""
    found = mjpeg.read(files)
    lumas = [luma for _, luma in found]
    file = np.repeat(np.arange(len(files)), [len(v) for v in lumas])
    starts = shot_starts(histograms(np.concatenate(lumas)), file)
    at = np.searchsorted(file, np.arange(len(files) + 1))
    out = []
    for k, (data, (avi, luma)) in enumerate(zip(files, found)):
        payload = luma[..., 0, 0].tobytes()
        first = np.flatnonzero(starts[at[k] : at[k + 1]])
        feature = f"fps={avi.fps:g} frames={len(luma)} clips={len(first)} starts={','.join(map(str, first))}"
        out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
    return out
