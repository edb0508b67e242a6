"""Media columns: texts as 8-bit audio, and features of the audio.

A payload is stored losslessly as the samples of an 8-bit mono WAV file.  The
stored bytes are read back; from the samples come

* a polyphase resampling by ``UP / DOWN`` with a windowed-sinc low-pass,
* log-mel energies of overlapped, windowed frames, as fixed-shape Arrow tensors
  of ``TENSOR_FRAMES`` x ``MELS`` (the last one is padded with the floor), and
* time spans by hysteresis: a span starts where the frame energy rises over the
  upper threshold and reaches to both sides as long as it stays over the lower.

All is computed document by document and in bounded segments, so equal
payloads give equal values whatever shares their batch.

Cases: a null or empty text is 64 zero bytes, one silent span-free recording.
A very long text is computed in segments, as if whole.  Repeated rows and ties
give equal values.  Columns besides the text are not read, and may have any
names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE, UP, DOWN, TAPS = 16_000, 2, 5, 16
FRAME, HOP, MELS, TENSOR_FRAMES = 256, 128, 24, 32
UPPER_DB, LOWER_DB, FLOOR = 3.0, 1.0, 1e-8
PAD = 64
SEGMENT_FRAMES = 4096


def _filter_bank() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The polyphase filters (UP x TAPS), the frame window and the mel weights."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    low = np.sinc(t / DOWN) / DOWN * np.hanning(n + 2)[1:-1]
    phases = (UP * low / low.sum()).reshape(TAPS, UP).T[:, ::-1]
    rate = RATE * UP / DOWN
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    rise = (bins[:, None] - points[:-2]) / (points[1:-1] - points[:-2])
    fall = (points[2:] - bins[:, None]) / (points[2:] - points[1:-1])
    weights = np.maximum(0, np.minimum(rise, fall))
    return phases.astype(np.float32), np.hanning(FRAME).astype(np.float32), weights.astype(np.float32)


PHASES, WINDOW, WEIGHTS = _filter_bank()


def payload(text: str | None) -> bytes:
    """UTF-8, with zero bytes up to a positive multiple of PAD."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % PAD if data else PAD)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def resampled(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Outputs first..last (exclusive; first a multiple of UP) of the polyphase resampling of 8-bit samples."""
    groups = -(-(last - first) // UP)
    start = first // UP * DOWN - TAPS // 2
    need = (groups - 1) * DOWN + (UP - 1) * DOWN // UP + TAPS
    x = np.zeros(need, np.float32)
    a, b = max(0, start), min(len(samples), start + need)
    if b > a:
        x[a - start : b - start] = (samples[a:b].astype(np.float32) - 128) / 128
    views = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    out = np.empty((groups, UP), np.float32)
    for phase in range(UP):
        out[:, phase] = np.ascontiguousarray(views[phase * DOWN // UP :: DOWN][:groups]) @ PHASES[phase * DOWN % UP]
    return out.reshape(-1)[: last - first]


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Frames x MELS, in dB; the end is filled up with silence."""
    total = max(1, len(samples) * UP // DOWN)
    frames = 1 + max(0, -(-(total - FRAME) // HOP))
    out = np.empty((frames, MELS), np.float32)
    for a in range(0, frames, SEGMENT_FRAMES):
        b = min(frames, a + SEGMENT_FRAMES)
        y = resampled(samples, a * HOP, (b - 1) * HOP + FRAME)
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * WINDOW)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[a:b] = 10 * np.log10(power @ WEIGHTS + FLOOR)
    return np.round(out, 2)


def active_spans(mel: np.ndarray) -> list[tuple[float, float]]:
    """Seconds from and to of each span, by hysteresis around the median frame energy."""
    energy = mel.mean(axis=1, dtype=np.float64)
    level = float(np.median(energy))
    low = np.concatenate([[False], energy > level + LOWER_DB, [False]])
    edges = np.flatnonzero(low[1:] != low[:-1]).reshape(-1, 2)
    risen = np.concatenate([[0], np.cumsum(energy > level + UPPER_DB)])
    seconds = HOP / (RATE * UP / DOWN)
    return [(round(a * seconds, 2), round(b * seconds, 2)) for a, b in edges.tolist() if risen[b] > risen[a]]


def tensors(mel: np.ndarray) -> bytes:
    """The frames as an Arrow stream of one fixed-shape tensor column, with the start second of each tensor."""
    padded = np.full((-(-len(mel) // TENSOR_FRAMES) * TENSOR_FRAMES, MELS), 10 * np.log10(FLOOR), np.float32)
    padded[: len(mel)] = mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(-1, TENSOR_FRAMES, MELS))
    starts = pa.array(np.arange(len(column)) * TENSOR_FRAMES * HOP / (RATE * UP / DOWN))
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([column, starts], names=["log_mel", "start_s"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def audio_column(text: Column) -> Column:
    """A struct of the media and its features: WAV bytes, tensors and time spans."""

    @F.pandas_udf("media binary, log_mel binary, frames long, spans array<struct<start_s:double,end_s:double>>")
    def make(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            media = to_wav(payload(text))
            mel = log_mel(np.frombuffer(from_wav(media), np.uint8))
            rows.append((media, tensors(mel), len(mel), [{"start_s": a, "end_s": b} for a, b in active_spans(mel)]))
        return pd.DataFrame(rows, columns=["media", "log_mel", "frames", "spans"])

    return make(text)


def audio_digest(text: Column) -> Column:
    """The same work told by sizes, hashes and one string; the media and tensors themselves are not returned."""
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    @F.pandas_udf("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def make(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            media = to_wav(payload(text))
            back = from_wav(media)
            mel = log_mel(np.frombuffer(back, np.uint8))
            spans = active_spans(mel)
            told = ",".join(f"{v:.1f}" for v in mel.mean(axis=0, dtype=np.float64))
            feature = f"frames={len(mel)};mel={told};tensor_crc32={zlib.crc32(tensors(mel)):08x};spans=" + ",".join(f"{a:.2f}-{b:.2f}" for a, b in spans)
            size = len((text or "").encode("utf-8", "surrogatepass"))
            rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        return pd.DataFrame(rows, columns=names)

    return make(text)
