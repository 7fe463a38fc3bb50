"""Audio columns: texts as 8-bit WAV, and time-coded spectral fingerprints of what was stored.

A payload is written and read by the ``wave`` module. A short-time Fourier transform of the samples that were read back
gives the strongest peaks of each frame; pairs of a peak and a later one are packed with their time.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regspan.llm.common import map_rows

FRAME = 192
WINDOW = 2 * FRAME
RATE = 8000
#: A peak is paired with the strongest peaks of this many following frames.
FAN_OUT = 3
_HANN = np.hanning(WINDOW).astype(np.float32)
#: Frames transformed at once.
_RUN = 4096


def padded(raw: bytes, unit: int = FRAME) -> bytes:
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit WAV whose samples are the bytes of ``payload``."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequency bins (frame, 2) of the two strongest local maxima per frame, and their magnitudes; no peak is bin 0."""
    body = np.concatenate([samples.astype(np.float32) - 128.0, np.zeros(WINDOW - FRAME, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(body, WINDOW)[::FRAME]
    bins, sizes = [], []
    for lo in range(0, len(frames), _RUN):
        part = frames[lo:lo + _RUN]
        x = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _HANN, axis=1))
        inner = x[:, 1:-1]
        top = np.where((inner > x[:, :-2]) & (inner >= x[:, 2:]), inner, 0.0)
        two = np.stack([np.argmax(top, axis=1), np.zeros(len(top), np.int64)], axis=1)
        rows = np.arange(len(top))
        first = top[rows, two[:, 0]].copy()
        top[rows, two[:, 0]] = 0.0
        two[:, 1] = np.argmax(top, axis=1)
        size = np.stack([first, top[rows, two[:, 1]]], axis=1)
        bins.append(np.where(size > 1e-3, two + 1, 0))
        sizes.append(size)
    return np.concatenate(bins), np.concatenate(sizes)


def pair_codes(bins: np.ndarray) -> np.ndarray:
    """Sorted codes time << 24 | first bin << 13 | second bin << 2 | gap, one per pair of peaks.

    The anchor is the strongest peak of a frame; it meets its own second peak (gap 0) and the strongest peak of the next
    ``FAN_OUT`` frames. Frames without a peak give none.
    """
    anchor, second, t = bins[:, 0].astype(np.int64), bins[:, 1].astype(np.int64), np.arange(len(bins), dtype=np.int64)
    out = [((t << 24 | anchor << 13 | second << 2))[(anchor > 0) & (second > 0)]]
    for gap in range(1, FAN_OUT + 1):
        a, b = anchor[:-gap], anchor[gap:]
        out.append((t[:-gap] << 24 | a << 13 | b << 2 | gap)[(a > 0) & (b > 0)])
    return np.sort(np.concatenate(out))


def with_media(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, n_bytes, media (a WAV file).

    Null texts count as empty and give one block of blanks. Rows that repeat and null doc_ids are kept, equal texts have equal
    files, a very long text makes one long file, other columns are ignored, and an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            raw = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(padded(x)) for x in raw], pa.binary())],
                ["doc_id", "n_bytes", "media"])

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, n_bytes bigint, media binary")


def features(media: DataFrame) -> DataFrame:
    """What is read back from each ``media`` file: payload (binary) and pairs (array of time-coded peak pairs).

    A null file is an error, as nothing could be read from it.
    """

    def run(batches):
        for b in batches:
            payload = [from_wav(m) for m in b.column("media").to_pylist()]
            pairs = [pair_codes(peaks(np.frombuffer(p, np.uint8))[0]) for p in payload]
            at = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
            flat = np.concatenate([*pairs, np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), b.column("media"), pa.array(payload, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "n_bytes", "media", "payload", "pairs"])

    return map_rows(media, run, "doc_id bigint, n_bytes bigint, media binary, payload binary, pairs array<bigint>")
