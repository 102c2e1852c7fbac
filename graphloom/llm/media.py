"""Media columns: payloads as WAV, with spectral-peak pair fingerprints.

``store`` wraps bytes as the samples of an 8-bit mono WAV file by the ``wave`` module.
``fingerprint`` reads the samples back, takes short-time Fourier transforms, keeps the strongest
bin of each frequency band of a frame that stands above the frame's mean, and pairs each peak with
the peaks of the next frames.  A fingerprint is two arrays of equal length: the pair's code
(frequency, other frequency, distance) and its time, the frame of the first peak.

Defined results: a null text is an empty one, whose payload is one block of padding.  Texts of any
length are read in slices of frames, so the memory for the transforms is bounded; the arrays of a
text grow with its length.  Equal texts give equal values, repeated rows included.  An empty table
gives an empty result.  Existing columns of the same name are replaced.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import append_columns, texts

BLOCK = 576
RATE = 8000
HOP = BLOCK // 2
#: Edges of the bands, in bins of the transform.
BANDS = (2, 12, 28, 60, 124, 289)
REACH = 3
SLICE = 2048
_WINDOW = np.hanning(BLOCK).astype(np.float32)


def payload_of(text: bytes) -> bytes:
    """Pad with bytes 255 up to a positive multiple of the block."""
    return text + b"\xff" * ((-len(text)) % BLOCK if text else BLOCK)


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Strongest bin of each band by frame, or -1: one row per frame."""
    signal = np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128.0
    frames = np.lib.stride_tricks.sliding_window_view(signal, BLOCK)[::HOP]
    out = np.empty((len(frames), len(BANDS) - 1), dtype=np.int16)
    for i in range(0, len(frames), SLICE):
        power = np.abs(np.fft.rfft(frames[i : i + SLICE] * _WINDOW, axis=1))
        mean = power[:, BANDS[0] :].mean(axis=1)
        for b, (lo, hi) in enumerate(zip(BANDS, BANDS[1:])):
            top = power[:, lo:hi].argmax(axis=1)
            high = power[np.arange(len(power)), lo + top] > mean
            out[i : i + SLICE, b] = np.where(high, lo + top, -1)
    return out


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and times of all peak pairs at most REACH frames apart, ordered by time then code."""
    codes, times = [], []
    n = len(found)
    for d in range(1, REACH + 1):
        if n <= d:
            break
        a, b = found[: n - d, :, None].astype(np.int32), found[d:, None, :].astype(np.int32)
        at, i, j = np.nonzero((a >= 0) & (b >= 0))
        codes.append((a[at, i, 0] << 11) | (b[at, 0, j] << 2) | d)
        times.append(at.astype(np.int32))
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    code, time = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((code, time))
    return code[order], time[order]


def fingerprint(media: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    found = peaks(read_back(media))
    return (*pairs(found), int((found >= 0).sum()))


def media_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the stored media and its fingerprint to every row."""

    def make():
        def compute(column: pa.Array):
            media = [store(payload_of(t)) for t in texts(column)]
            prints = [fingerprint(m) for m in media]
            return [media, [p[0] for p in prints], [p[1] for p in prints], [p[2] for p in prints]]

        return compute

    return append_columns(docs, [text_col], "media binary, codes array<int>, times array<int>, n_peaks bigint", make)


def media_digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Digests of the media columns, worked out batch by batch so that no media leave the task.

    ``payload_*`` and ``tail_crc32`` are of the bytes read back from the stored form; ``feature``
    is ``frames:peaks:pairs:crc32`` of the codes and times, which are the fingerprint itself.
    """
    outputs = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codes array<int>, times array<int>"

    def one(text: bytes) -> tuple:
        media = store(payload_of(text))
        payload = read_back(media)
        found = peaks(payload)
        codes, times = pairs(found)
        mark = zlib.crc32(times.astype("<i4").tobytes(), zlib.crc32(codes.astype("<i4").tobytes()))
        feature = f"{len(found)}:{int((found >= 0).sum())}:{len(codes)}:{mark:08x}"
        return (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, codes, times)

    def make():
        def compute(column: pa.Array):
            return list(zip(*map(one, texts(column))))

        return compute

    return append_columns(docs, [text_col], outputs, make)
