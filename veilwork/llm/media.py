"""Media columns: WAV files in a binary column, their short-time Fourier transforms and spectral-peak fingerprints.

A payload is kept as 8-bit mono samples by the wave module. Fingerprints pair each frame's strongest spectral peaks with
one another and with those of the following frames; a pair's code holds both frequencies and the time between them, and
is stored with the time of its first peak.

Defined results: null text counts as empty, and an empty payload is padded to one unit; equal payloads give equal
fingerprints; other columns are not read; texts of any length are used whole, by blocks of frames; bytes that are no
UTF-8 are kept as they are.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilwork.llm.common import map_arrow, table, utf8

UNIT, RATE = 576, 8000
FRAME, HOP = 576, 288
#: Bands of the spectrum, peaks kept in each frame, and frames ahead in which a peak finds partners.
BANDS, PEAKS, AHEAD = 6, 2, 2
_WINDOW = np.hanning(FRAME).astype(np.float32)
_BLOCK = 4096


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise wave.Error("8-bit mono samples are read here")
        return r.readframes(r.getnframes())


def padded(data: bytes) -> bytes:
    units = max(1, -(-len(data) // UNIT))
    return data + b"\xff" * (units * UNIT - len(data))


def peaks(samples: bytes) -> np.ndarray:
    """The PEAKS strongest bins of each frame, one from a band at most, strongest first."""
    wave_ = np.frombuffer(samples, np.uint8).astype(np.float32) / 128 - 1
    if len(wave_) < FRAME:
        wave_ = np.pad(wave_, (0, FRAME - len(wave_)))
    frames = np.lib.stride_tricks.sliding_window_view(wave_, FRAME)[::HOP]
    found = []
    for low in range(0, len(frames), _BLOCK):
        spectrum = np.fft.rfft(frames[low : low + _BLOCK] * _WINDOW, axis=1)[:, 1:]
        power = (spectrum.real**2 + spectrum.imag**2).reshape(len(spectrum), BANDS, -1)
        best = power.argmax(2)
        height = np.take_along_axis(power, best[:, :, None], 2)[:, :, 0]
        order = np.argsort(-height, axis=1, kind="stable")[:, :PEAKS]
        found.append(np.take_along_axis(best, order, 1) + order * power.shape[2] + 1)
    return np.concatenate(found)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (in frames) and codes of all pairs of peaks: f1 << 16 | f2 << 4 | frames between."""
    p = peaks(samples).astype(np.int32)
    times, codes = [np.arange(len(p), dtype=np.int32)], [p[:, 0] << 16 | p[:, 1] << 4]
    for gap in range(1, min(AHEAD, len(p) - 1) + 1):
        for a in range(PEAKS):
            for b in range(PEAKS):
                times.append(times[0][:-gap])
                codes.append(p[:-gap, a] << 16 | p[gap:, b] << 4 | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        n = np.diff(offsets)
        media = (to_wav(padded(data[offsets[i] : offsets[i + 1]].tobytes())) for i in range(len(n)))
        step: list[bytes] = []
        low, size = 0, 0
        for i, m in enumerate(media):
            step.append(m)
            size += len(m)
            if size > 4 << 20 or i == len(n) - 1:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(step)), pa.array(n[low : i + 1], pa.int64()), pa.array(step, pa.binary())], ["doc_id", "n_bytes", "media"])
                step, low, size = [], i + 1, 0


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text of each document as the samples of a WAV file."""
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), _store, "doc_id long, n_bytes long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "codes"]
    for batch in batches:
        rows: list[tuple] = []
        for m in batch.column(2):
            media = m.as_py()
            samples = from_wav(media)
            t, c = fingerprint(samples)
            feature = hashlib.sha256(t.astype("<i4").tobytes() + c.astype("<i4").tobytes()).hexdigest()
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, t, c))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def fingerprints(media: DataFrame) -> DataFrame:
    """What is read back from a column of WAV files: digests, and the pairs of peaks as arrays of times and codes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"
    return map_arrow(media.select("doc_id", "n_bytes", "media"), _features, schema)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(media_column(table(spark, sf_dir, "documents")))
