"""Segments and features: overlapping windows, PCM decoding, level and log-mel features."""

from __future__ import annotations

import io
import time
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.session import ship_package

# Fixed values of the feature set.
RATE = 32000
SIZE_S, HOP_S, TAIL_S = 3.0, 1.5, 1.0
BINS, FRAMES, N_FFT, HOP = 128, 300, 1024, 320
LOG_OFFSET, SILENT_STD = 1e-9, 1e-7
#: Feature rows in one batch of a task's output.
OUT_ROWS = 64


def windows(df: DataFrame, length: str, size: int = int(SIZE_S * RATE), hop: int = int(HOP_S * RATE), tail: int = int(TAIL_S * RATE)) -> DataFrame:
    """Rows exploded to windows: ``segment_idx, start, stop, padding, is_last``; closed form, no loop."""
    n = F.col(length)
    full = F.when(n >= size, F.floor((n - size) / hop) + 1).otherwise(0)
    count = full + F.when(n - full * hop > tail, 1).otherwise(0)
    df = df.withColumn("_count", F.coalesce(count, F.lit(0)).cast("int"))
    out = df.filter("_count > 0").withColumn("segment_idx", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    start = F.col("segment_idx").cast("long") * hop
    stop = F.least(start + size, n)
    return out.withColumns({"start": start, "stop": stop, "padding": size - (stop - start), "is_last": F.col("segment_idx") == F.col("_count") - 1}).drop("_count")


def decode_pcm(data: bytes) -> tuple[np.ndarray, int]:
    """(mono float32 samples, rate) of a PCM WAV of 1, 2 or 4 bytes a sample."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    kinds = {1: (np.uint8, 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}
    if width not in kinds:
        raise ValueError(f"sample width {width}")
    kind, zero, scale = kinds[width]
    x = (np.frombuffer(raw, kind).astype(np.float32) - zero) / scale
    return (x.reshape(-1, channels).mean(axis=1) if channels > 1 else x).astype(np.float32), rate


def encode_pcm(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono WAV; samples are clipped to [-1, 1]."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.rint(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def rms(samples: np.ndarray) -> float:
    x = samples.astype(np.float32)
    return float(np.sqrt(np.mean(np.square(x), dtype=np.float64))) if x.size else 0.0


def rms_db(samples: np.ndarray) -> float:
    level = rms(samples)
    return 20 * float(np.log10(level)) if level >= 1e-10 else float("-inf")


@lru_cache(maxsize=1)
def mel_filters() -> np.ndarray:
    """(bins x frequencies) triangles on the slaney scale, each of equal area."""
    step, corner = 200 / 3, 1000.0
    log_step = np.log(6.4) / 27
    to_mel = lambda f: np.where(f < corner, f / step, corner / step + np.log(np.maximum(f, 1e-9) / corner) / log_step)
    to_hz = lambda m: np.where(m < corner / step, m * step, corner * np.exp(log_step * (m - corner / step)))
    edges = to_hz(np.linspace(to_mel(np.array(0.0)), to_mel(np.array(RATE / 2)), BINS + 2))
    f = np.linspace(0, RATE / 2, N_FFT // 2 + 1)
    up = (f[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray) -> np.ndarray:
    """(bins x frames) of log power, cut or padded to ``FRAMES``."""
    x = np.pad(samples.astype(np.float64), N_FFT // 2, mode="reflect") if len(samples) > N_FFT // 2 else np.pad(samples.astype(np.float64), N_FFT // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    mel = np.log(power @ mel_filters().T + LOG_OFFSET).T
    return np.pad(mel[:, :FRAMES], ((0, 0), (0, max(0, FRAMES - mel.shape[1]))), constant_values=0.0)


FEATURES = "rms double, silent_flag boolean, mel_bins int, mel_frames int, mel_means array<double>, sample_rate int, duration_s double, processing_ms double, error string"


def features(segments: DataFrame, content: str = "content") -> DataFrame:
    """Segment rows with features of their WAV bytes; a row that cannot be read has ``error``.

    A row is one segment of at most ``SIZE_S``: the mel frames end there. ``rms`` is in dB with -60 in
    place of minus infinity. One map over Arrow batches; the mel
    table is made once per worker. A task holds one Arrow batch, which Spark bounds in bytes, one
    decoded segment, and ``OUT_ROWS`` rows of features.
    """
    ship_package(segments.sparkSession)
    rest = [c for c in segments.columns if c != content]
    src = segments.select(*rest, content)

    def row_of(data: bytes | None) -> tuple:
        began = time.perf_counter()
        try:
            x, rate = decode_pcm(data or b"")
            mel = log_mel(x)
            db = rms_db(x)
            silent = bool(np.std(mel, ddof=1) < SILENT_STD)
            return (db if np.isfinite(db) else -60.0, silent, *mel.shape, mel.mean(axis=1).tolist(), rate, len(x) / rate, 1000 * (time.perf_counter() - began), None)
        except (ValueError, EOFError, wave.Error) as e:
            return (None,) * 8 + (str(e) or type(e).__name__,)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.float64(), pa.string()]
        names = [f.split()[0] for f in FEATURES.split(", ")]
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(start, OUT_ROWS)
                cols = list(zip(*[row_of(data.as_py()) for data in part.column(part.num_columns - 1)]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(c, k) for c, k in zip(cols, kinds)]], [*rest, *names])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(compute, f"{head}, {FEATURES}")


def cut_segments(tracks: DataFrame, content: str = "content") -> DataFrame:
    """Whole WAV tracks to segment rows: ``segment_idx, content`` (WAV), ``is_last_segment``, digest, ``cut_error``.

    Every window is cut where its track's bytes are; no shuffle. A track that is null, damaged or of
    another rate makes one row without content that tells its ``cut_error``.
    """
    ship_package(tracks.sparkSession)
    rest = [c for c in tracks.columns if c != content]
    src = tracks.select(*rest, content)
    size, hop, tail = (int(s * RATE) for s in (SIZE_S, HOP_S, TAIL_S))

    def parts_of(data: bytes | None) -> list[bytes]:
        x, rate = decode_pcm(data or b"")
        if rate != RATE:
            raise ValueError(f"sample rate {rate}, not {RATE}")
        full = (len(x) - size) // hop + 1 if len(x) >= size else 0
        n = full + (len(x) - full * hop > tail)
        parts = [x[i * hop : i * hop + size] for i in range(n)]
        return [encode_pcm(np.pad(p, (0, size - len(p)))) for p in parts]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                try:
                    wavs, error = parts_of(batch.column(batch.num_columns - 1)[row].as_py()), None
                except (ValueError, EOFError, wave.Error) as e:
                    wavs, error = [None], str(e) or type(e).__name__
                n = len(wavs)
                cols = [pa.array([c[row].as_py()] * n, c.type) for c in batch.columns[:-1]]
                numbers = pa.array([None] if error else range(n), pa.int32())
                cols += [numbers, pa.array(wavs, pa.binary()), pa.array([i == n - 1 and not error for i in range(n)], pa.bool_()), pa.array([error] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [*rest, "segment_idx", "content", "is_last_segment", "cut_error"])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    out = src.mapInArrow(cut, f"{head}segment_idx int, content binary, is_last_segment boolean, cut_error string")
    return out.withColumn("checksum", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
