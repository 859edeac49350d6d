"""Media columns: texts stored as 8-bit audio, and audio features.

A payload is written as a mono 8-bit PCM WAV file and read back. Features: polyphase resampling by a rational factor (UP / DOWN, UP phases),
overlapped log-mel filterbanks, and segments by energy with hysteresis (a segment opens above ``high`` and closes below
``low``, both relative to the clip's energy range). Each clip gives a tensor of fixed shape (FRAMES, MELS), pooled over its segments, with time spans.
``tensor_bytes`` packs clips into Arrow streams with a fixed-shape tensor column, ``media_digests`` stores these and derives its rows from what it reads back.

Defined cases: a null text is empty, and an empty text is one unit of 576 bytes 255; a clip without a segment has one that
spans it all; equal texts give equal values; repeated rows are each returned; an empty table gives an empty result; other
columns are ignored. Samples are resampled and filtered in stretches, so a long clip takes memory for its bytes, its log-mel frames and one stretch.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

UNIT, RATE = 576, 16_000
UP, DOWN = 5, 8
N_FFT, HOP, MELS = 256, 128, 32
FRAMES = 16
#: Frames that are worked on at once; rows and bytes of clips that go into one Arrow stream, or a single larger clip.
STRETCH = 1 << 12
STREAM_ROWS, STREAM_BYTES = 512, 1 << 22


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes and the length without padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(data)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes())


@lru_cache
def _taps(up: int, down: int) -> np.ndarray:
    """A windowed-sinc low-pass, as one row of taps per output phase."""
    width = 8 * max(up, down)
    t = np.arange(-width, width + 1)
    h = np.sinc(t / max(up, down)) * np.hamming(len(t))
    h *= up / h.sum()
    h = np.append(h, np.zeros(-len(h) % up))
    return h.reshape(-1, up).T


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Polyphase: each phase of the output is a short filter over the input, at its own stride. Outputs from first on, before stop; bytes are samples around 128."""
    taps = _taps(up, down)
    half, size = (taps.size - 1) // 2, taps.shape[1]
    n = -(-len(x) * up // down)
    stop = n if stop is None else min(stop, n)
    if first >= stop:
        return np.empty(0)
    low, high = (first * down + half) // up + 1 - size, ((stop - 1) * down + half) // up + 1
    inner = x[max(low, 0) : high]
    if inner.dtype == np.uint8:
        inner = (inner.astype(np.float32) - 128) / 128
    part = np.zeros(high - low, dtype=inner.dtype)
    part[max(-low, 0) : max(-low, 0) + len(inner)] = inner
    views = np.lib.stride_tricks.sliding_window_view(part, size)
    out = np.empty(stop - first, dtype=inner.dtype)
    for k in range(first, min(first + up, stop)):  # outputs k, k + up, ... share a phase
        at = k * down + half
        out[k - first :: up] = views[at // up + 1 - size - low :: down][: len(out[k - first :: up])] @ taps[at % up][::-1].astype(inner.dtype)
    return out


@lru_cache
def _mel_bank(rate: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(N_FFT, 1 / rate)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, MELS); frames overlap by half, the last is padded."""
    n = max(1, 1 + -(-(len(x) - N_FFT) // HOP))
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + N_FFT - len(x)))])
    frames = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP]
    out = np.empty((n, MELS), dtype=np.float32)
    for s in range(0, n, STRETCH):
        power = np.abs(np.fft.rfft(frames[s : s + STRETCH] * np.hanning(N_FFT), axis=1)) ** 2
        out[s : s + STRETCH] = np.log(power @ _mel_bank(rate) + 1e-6)
    return out


def clip_mel(samples: np.ndarray, rate: int) -> np.ndarray:
    """log_mel of the resampled bytes, stretch by stretch."""
    n_out = -(-len(samples) * UP // DOWN)
    n = max(1, 1 + -(-(n_out - N_FFT) // HOP))
    out = np.empty((n, MELS), dtype=np.float32)
    for s in range(0, n, STRETCH):
        rows = min(STRETCH, n - s)
        out[s : s + rows] = log_mel(resample(samples, UP, DOWN, s * HOP, (s + rows - 1) * HOP + N_FFT), rate)
    return out


def segments(mel: np.ndarray, high: float = 0.6, low: float = 0.4) -> list[tuple[int, int]]:
    """[first, last) frames of high energy."""
    energy = mel.mean(axis=1)
    floor, top = float(energy.min()), float(energy.max())
    if top <= floor:
        return [(0, len(mel))]
    e = (energy - floor) / (top - floor)
    # The state at a frame is that of the last frame that was above high or below low.
    decided = np.where(e >= high, 1, np.where(e < low, -1, 0))
    last = np.maximum.accumulate(np.where(decided != 0, np.arange(len(e)), -1))
    on = (last >= 0) & (decided[np.maximum(last, 0)] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist())) or [(0, len(mel))]


def features(samples: bytes, rate: int = RATE) -> tuple[list[tuple[float, float]], np.ndarray]:
    """Time spans of the segments in seconds, and the clip's tensor (FRAMES, MELS): the voiced frames, pooled evenly."""
    new_rate = rate * UP // DOWN
    mel = clip_mel(np.frombuffer(samples, dtype=np.uint8), new_rate)
    spans = segments(mel)
    voiced = np.concatenate([mel[a:b] for a, b in spans])
    cuts = np.linspace(0, len(voiced), FRAMES + 1).astype(int)
    tensor = np.stack([voiced[min(a, len(voiced) - 1) : max(b, a + 1)].mean(axis=0) for a, b in zip(cuts, cuts[1:])])
    at = HOP / new_rate
    return [(a * at, b * at) for a, b in spans], tensor.astype(np.float32)


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """[first, stop) of rows that go together."""
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if k > first and (held + size > STREAM_BYTES or k - first >= STREAM_ROWS):
            yield first, k
            first, held = k, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def _clip(doc_id, text):
    data, n = payload(text)
    media = to_wav(data)
    spans, tensor = features(from_wav(media))
    return doc_id, n, media, [s for s, _ in spans], [e for _, e in spans], tensor.ravel()


def clips(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (WAV), span starts and ends in seconds, and the tensor's FRAMES x MELS values of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("starts", pa.list_(pa.float64())), ("ends", pa.list_(pa.float64())), ("tensor", pa.list_(pa.float32()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop in _slices(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
                rows = [_clip(i, t) for i, t in zip(b.column(0)[first:stop].to_pylist(), b.column(1)[first:stop].to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id long, n_bytes long, media binary, starts array<double>, ends array<double>, tensor array<float>")


def as_tensors(batch: pa.RecordBatch) -> pa.Table:
    """A batch of clips() with a fixed-shape tensor column (FRAMES, MELS) of 16-bit floats."""
    kind = pa.fixed_shape_tensor(pa.float16(), [FRAMES, MELS])
    values = pa.array(np.asarray(batch.column("tensor").flatten(), dtype=np.float32).astype(np.float16))
    tensor = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(values, FRAMES * MELS))
    return pa.table({**{c: batch.column(c) for c in ("doc_id", "n_bytes", "media", "starts", "ends")}, "tensor": tensor})


def tensor_bytes(clip_rows: DataFrame) -> DataFrame:
    """Compressed Arrow IPC streams of clips with fixed-shape tensors, one row (doc_ids, stream) for some STREAM_ROWS clips."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            for first, stop in _slices(pc.binary_length(b.column("media")).to_pylist()):
                t, out = as_tensors(b.slice(first, stop - first)), io.BytesIO()
                with pa.ipc.new_stream(out, t.schema, options=options) as w:
                    w.write_table(t)
                yield pa.RecordBatch.from_arrays([pa.array([t.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([out.getvalue()], pa.binary())], ["doc_ids", "stream"])

    return clip_rows.select("doc_id", "n_bytes", "media", "starts", "ends", "tensor").mapInArrow(packed, "doc_ids array<long>, stream binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(starts: list[float], ends: list[float], tensor: np.ndarray) -> str:
    """Number of spans; outer ends; CRC-32 of all spans in milliseconds; mean of the tensor in each band, rounded far above the float error."""
    each = ",".join(f"{a:.3f}-{b:.3f}" for a, b in zip(starts, ends))
    means = np.round(tensor.astype(np.float64).mean(axis=0), 1) + 0.0
    return ";".join([f"{len(starts)}", f"{starts[0]:.3f}-{ends[-1]:.3f}", f"{zlib.crc32(each.encode()):08x}", ",".join(f"{v:.1f}" for v in means)])


def _digest(doc_id, n_bytes, media, starts, ends, tensor) -> tuple:
    back = from_wav(media)
    return doc_id, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(starts, ends, tensor)


def digests(streams: DataFrame) -> DataFrame:
    """DIGEST of each clip in streams (stream)."""
    types = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in DIGEST.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream in b.column(0):
                t = pa.ipc.open_stream(stream.as_buffer()).read_all().combine_chunks()
                tensors = t.column("tensor").chunk(0).to_numpy_ndarray()
                rows = [_digest(*row, x) for *row, x in zip(*(t.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "starts", "ends")), tensors)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return streams.select("stream").mapInArrow(read, DIGEST)


def media_digests(docs: DataFrame) -> DataFrame:
    """DIGEST of each document, from its stored clip."""
    return digests(stored(tensor_bytes(clips(docs)), "clips"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
