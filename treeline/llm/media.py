"""Media columns: WAV in a binary column, short-time Fourier transforms, and spectral-peak pair fingerprints.

A fingerprint pairs each spectral peak with the next ones in time: (time of the first, its bin, the second's bin,
frames between), stored as time-coded arrays. Equal sounds have equal fingerprints. The WAV column is written to the
shared folder and read again; everything else is computed from what was read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import map_arrow, stash

FRAME, HOP, RATE = 256, 128, 8000
#: A peak is the largest of (2 * NEAR_FRAMES + 1) x (2 * NEAR_BINS + 1) values; each is paired with the FAN next peaks.
NEAR_FRAMES, NEAR_BINS, FAN = 2, 8, 2
#: Frames that are transformed at once: bounds memory for sounds of any length.
BLOCK = 4096
_WINDOW = np.hanning(FRAME + 1)[:FRAME]


def to_wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit WAV expected")
        return w.readframes(w.getnframes())


def spectrogram(samples: np.ndarray, first: int, frames: int) -> np.ndarray:
    """Magnitudes of ``frames`` frames from frame ``first`` on; samples past the end are silence (128)."""
    start, length = first * HOP, (frames - 1) * HOP + FRAME
    part = samples[start : start + length].astype(np.float32) - 128.0
    if len(part) < length:
        part = np.concatenate([part, np.zeros(length - len(part), np.float32)])
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _WINDOW, axis=1))


def _local_max(x: np.ndarray, near: int, axis: int) -> np.ndarray:
    out = x.copy()
    for d in range(1, near + 1):
        low = [slice(None)] * 2
        high = [slice(None)] * 2
        low[axis], high[axis] = slice(None, -d), slice(d, None)
        if x.shape[axis] > d:
            np.maximum(out[tuple(low)], x[tuple(high)], out=out[tuple(low)])
            np.maximum(out[tuple(high)], x[tuple(low)], out=out[tuple(high)])
    return out


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): for each pair the frame of its first peak, and bin1 << 40 | bin2 << 32 | frames between."""
    samples = np.frombuffer(payload, np.uint8)
    total = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    times, bins = [], []
    for first in range(0, total, BLOCK):
        lo, hi = max(0, first - NEAR_FRAMES), min(total, first + BLOCK + NEAR_FRAMES)
        mag = spectrogram(samples, lo, hi - lo)
        top = _local_max(_local_max(mag, NEAR_BINS, 1), NEAR_FRAMES, 0)
        t, b = np.nonzero((mag == top) & (mag > 1.0))
        inside = (t + lo >= first) & (t + lo < first + BLOCK)
        times.append(t[inside] + lo)
        bins.append(b[inside])
    t, b = np.concatenate(times), np.concatenate(bins)
    out_t, out_c = [], []
    for k in range(1, FAN + 1):
        out_t.append(t[:-k])
        out_c.append(b[:-k] << 40 | b[k:] << 32 | (t[k:] - t[:-k]))
    t, c = np.concatenate(out_t), np.concatenate(out_c)
    order = np.lexsort((c, t))
    return t[order], c[order]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with zeros up to a positive multiple of 64, and their number without the zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


_FEATURES = pa.schema([
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("times", pa.list_(pa.int64())), ("codes", pa.list_(pa.int64())),
])
_FEATURES_DDL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<long>, codes array<long>"
#: Bytes of sound that are worked on at once; a longer one is alone.
HELD = 8 << 20


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of values of about HELD bytes."""
    first = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if held + n > HELD and i > first:
            yield first, i
            first, held = i, 0
        held += n
    if len(column) > first:
        yield first, len(column)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end in _runs(batch.column(1)):
            some = batch.slice(first, end - first)
            payloads = [payload_of(t.as_py()) for t in some.column(1)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([n for _, n in payloads], pa.int64()), pa.array([to_wav(p) for p, _ in payloads], pa.binary())], names=["key", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch], keep_media: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end in _runs(batch.column(2)):
            some = batch.slice(first, end - first)
            rows = []
            for stored in some.column(2):
                media = stored.as_py()
                back = from_wav(media)
                t, c = fingerprint(back)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), t, c))
            found = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FEATURES, strict=True)]
            yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(3 if keep_media else 2)), *found], names=[*some.schema.names[: 3 if keep_media else 2], *_FEATURES.names])


def store_and_fingerprint(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, times, codes[, media]) for each row.

    All values but the key and n_bytes come from the stored WAV file as read back. Row by row: nothing is shuffled, and
    a lost task is done again alone.

    Defined cases: null and empty texts are 64 zero samples; null keys stay null; equal texts have equal values;
    repeated rows stay; an empty table gives no rows; other columns are left out. Sounds without a peak above
    silence have empty arrays.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    stored = stash(map_arrow(rows, _encode, "key long, n_bytes long, media binary"), "media", compression="zstd")
    done = map_arrow(stored, lambda it: _features(it, keep_media), f"key long, n_bytes long, {'media binary, ' if keep_media else ''}{_FEATURES_DDL}")
    return done.select(F.col("key").alias(key), *(c for c in done.columns if c not in ("key", "media")), *(["media"] if keep_media else []))
